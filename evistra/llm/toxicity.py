"""Toxicity by a weighted finite-state grammar over clauses.

A lexical transducer reads words as symbols: insults with a weight, threats, targets, negations, reporting verbs, or
anything else. Insults are learnt from the training labels: words, stems and word pairs much likelier in toxic texts,
weighed by their log odds. Over symbols stand five small transducers with weighted arcs (negation, reported speech, a
target behind, an object before a threat, a target ahead); the four that read from left to right are composed into one table, the last one reads
its output from right to left. A symbol's weight is the product of the arcs it passes; a clause's weight is the sum over
its insults and threats; states run through the whole clause. A text's score is a logistic function of its clauses'
weights, fitted on the training labels.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evistra.llm._common import materialize, slices, text_column
from evistra.llm.learning import labelled_sample, logistic, sigmoid

#: Labelled rows that the lexicon and the weights are fitted on at most; with MIN_TEXTS they bound the lexicon, too.
SAMPLE_ROWS = 20_000
#: An entry is learnt with this log odds and so many standard errors of it (more for a pair, of which there are many),
#: seen in so many toxic texts; a stem needs so many different words with it there, none of them in over half its texts.
MIN_ODDS, MIN_SIGMA, PAIR_SIGMA, MIN_TEXTS, MIN_FORMS = 2.0, 4.0, 5.0, 5, 5
#: Letters of a stem; candidates that are given to every worker, beyond which they are joined.
STEM, BROADCAST_CANDIDATES = range(3, 11), 200_000
#: Words of the transducers in English, German, French and Spanish.
THREATS = frozenset(
    "kill hurt destroy burn beat stab shoot murder crush attack strangle töten umbringen verletzen schlagen vernichten verbrennen "
    "erschießen tuer blesser frapper détruire brûler égorger matar herir golpear destruir quemar disparar".split()
)
TARGETS = frozenset(
    "you your yours u ur he she they them him her his their everyone people these those du dein ihr euer sie er ihn ihm "
    "tu toi ton votre il elle ils elles lui leur tú ella él ellos ellas vosotros".split()
)
#: Persons as the object of a verb that may follow them, as it does in German, French and Spanish.
OBJECTS = frozenset("dich dir euch te vous os ti usted ustedes".split())
NEGATIONS = frozenset(
    "not never no without isn't aren't wasn't don't doesn't didn't won't can't neither nor nicht nie niemals kein keine keinen ohne weder "
    "ne pas jamais sans ni aucun aucune nunca jamás sin tampoco ningún ninguna".split()
)
REPORTS = frozenset(
    "said says wrote writes called calls quoted reported claimed alleged according condemned sagte sagt schrieb nannte zitierte behauptete laut "
    "dit écrit appelé cité affirmé selon dijo dice escribió llamó citó afirmó según".split()
)
OTHER, INSULT, AIMED, THREAT, TARGET, OBJECT, NEGATION, REPORT = "other", "insult", "aimed", "threat", "target", "object", "negation", "report"
SYMBOLS = (OTHER, INSULT, AIMED, THREAT, TARGET, OBJECT, NEGATION, REPORT)
#: Words between an insult and its target, words that a negation reaches, words from an object to a threat behind it, and
#: from a threat to its target ahead: "kill all of you", but not "kill the lights for you".
NEAR, SCOPE, BEFORE, AFTER = 4, 3, 3, 3
_RAISED, _NEGATED, _REPORTED, _THREAT = 1.3, 0.3, 0.4, 3.0
_CUT = re.compile(r"[.!?;\n]")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


def training(doc_id: Column) -> Column:
    """Rows whose labels may be learnt: crc32 of doc_id as text, mod 5, isn't 0 (nor is doc_id null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


# --- transducers -------------------------------------------------------------------------------------------------------


@dataclass
class Transducer:
    """Deterministic: arcs (state, symbol) -> (state, symbol, weight); it begins in state 0."""

    arcs: dict[tuple[int, str], tuple[int, str, float]] = field(default_factory=dict)

    def run(self, symbols: list[str], weights: list[float]) -> tuple[list[str], list[float]]:
        state, out, got = 0, [], []
        for x, w in zip(symbols, weights):
            state, y, by = self.arcs[state, x]
            out.append(y)
            got.append(w * by)
        return out, got


def compose(a: Transducer, b: Transducer) -> Transducer:
    """b reads what a writes; states are the reachable pairs, weights multiply."""
    number, todo, out = {(0, 0): 0}, [(0, 0)], Transducer()
    while todo:
        p, q = todo.pop()
        for x in SYMBOLS:
            p2, y, v = a.arcs[p, x]
            q2, z, w = b.arcs[q, y]
            if (p2, q2) not in number:
                number[p2, q2] = len(number)
                todo.append((p2, q2))
            out.arcs[number[p, q], x] = (number[p2, q2], z, v * w)
    return out


def countdown(triggers: tuple[str, ...], reach: int, changes: dict[str, tuple[str, float]], otherwise: dict[str, tuple[str, float]] | None = None) -> Transducer:
    """For `reach` words after a trigger, the symbols in changes are rewritten and weighed; at other times those in otherwise."""
    out = Transducer()
    for state in range(reach + 1):
        for x in SYMBOLS:
            y, w = (changes if state else otherwise or {}).get(x, (x, 1.0))
            out.arcs[state, x] = (reach if x in triggers else max(0, state - 1), y, w)
    return out


def reported() -> Transducer:
    """After a reporting verb, to the end of the clause."""
    out = Transducer()
    for state in (0, 1):
        for x in SYMBOLS:
            out.arcs[state, x] = (1 if state or x == REPORT else 0, x, _REPORTED if state and x in (INSULT, THREAT) else 1.0)
    return out


NEGATED = countdown((NEGATION,), SCOPE, {INSULT: (INSULT, _NEGATED), THREAT: (THREAT, _NEGATED)})
BEHIND = countdown((TARGET, OBJECT), NEAR, {INSULT: (AIMED, _RAISED)})
#: A threat behind its object is aimed at it.
OBJECTED = countdown((OBJECT,), BEFORE, {THREAT: (AIMED, 1.0)})
#: From right to left: a threat that isn't aimed yet counts only where a target follows.
AHEAD = countdown((TARGET, OBJECT), NEAR, {INSULT: (AIMED, _RAISED)})
FOLLOWED = countdown((TARGET, OBJECT), AFTER, {}, {THREAT: (OTHER, 0.0)})
FORWARD = compose(compose(compose(NEGATED, reported()), BEHIND), OBJECTED)
BACKWARD = compose(AHEAD, FOLLOWED)


# --- the grammar -------------------------------------------------------------------------------------------------------


class Grammar:
    """Reads words as symbols, finds the clauses with insults or threats, and weighs them.

    Entries of the lexicon are whole words, stems (`stem*`, for longer words) and pairs (`one two`); the longest counts.
    """

    def __init__(self, lexicon: dict[str, float]):
        self.words = {w: x for w, x in lexicon.items() if not w.endswith("*") and " " not in w}
        self.stems = {w[:-1]: x for w, x in lexicon.items() if w.endswith("*")}
        self.pairs = {tuple(w.split(" ")): x for w, x in lexicon.items() if " " in w}
        self.sizes = sorted({len(w) for w in self.stems}, reverse=True)
        self.memo: dict[str, tuple[str, float]] = {}
        self.find = ahocorasick.Automaton()
        for w in {*self.words, *self.stems, *THREATS, *(b for _, b in self.pairs)}:
            self.find.add_word(w, len(w))
        self.find.make_automaton()

    def symbol(self, word: str) -> tuple[str, float]:
        """The lexical transducer's arc for a word."""
        if word in self.words:
            return INSULT, self.words[word]
        for k in self.sizes:
            if len(word) > k and word[:k] in self.stems:
                return INSULT, self.stems[word[:k]]
        for words, symbol in ((THREATS, THREAT), (TARGETS, TARGET), (OBJECTS, OBJECT), (NEGATIONS, NEGATION), (REPORTS, REPORT)):
            if word in words:
                return symbol, _THREAT if symbol == THREAT else 1.0
        return OTHER, 0.0

    def clause_weight(self, words: list[str]) -> float:
        symbols, weights, before = [], [], ""
        for w in words:
            got = self.memo.get(w)
            if got is None:
                if len(self.memo) > 100_000:
                    self.memo.clear()
                self.memo[w] = got = self.symbol(w)
            if self.pairs and (before, w) in self.pairs and got[0] != INSULT:
                got = INSULT, self.pairs[before, w]
            symbols.append(got[0])
            weights.append(got[1])
            before = w
        if INSULT not in symbols and THREAT not in symbols:
            return 0.0
        symbols, weights = FORWARD.run(symbols, weights)
        symbols, weights = BACKWARD.run(symbols[::-1], weights[::-1])
        return sum(w for x, w in zip(symbols, weights) if x in (INSULT, AIMED, THREAT))

    def clauses(self, text: str) -> list[float]:
        """Weights of the clauses that hold something of the grammar, in order; each clause is read once, as a whole."""
        low, out, done = text.lower(), [], 0
        for end, size in self.find.iter(low):
            start = end - size + 1
            if start < done or (start and low[start - 1].isalpha()):
                continue
            begin = max((low.rfind(c, done, start) for c in ".!?;\n"), default=-1) + 1
            m = _CUT.search(low, end + 1)
            stop = m.start() if m else len(low)
            if weight := self.clause_weight(_WORD.findall(low[max(begin, done) : stop])):
                out.append(weight)
            done = stop
        return out

    def features(self, text: str) -> tuple[float, float, float]:
        w = self.clauses(text)
        return (max(w), float(np.log1p(sum(w))), float(np.log1p(len(w)))) if w else (0.0, 0.0, 0.0)


# --- learning ----------------------------------------------------------------------------------------------------------


def entries_of(text: str) -> set[str]:
    """What a lexicon could hold of a text: words, stems of words, and pairs of words."""
    words = _WORD.findall(text.lower())
    different = set(words)
    return different | {f"{w[:k]}*" for w in different for k in STEM if len(w) > k} | {f"{a} {b}" for a, b in zip(words, words[1:])}


def distinct_texts(sample: DataFrame) -> DataFrame:
    """(text, label) with near copies counted once: of the texts with the same least shingle hash, the least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            marks = []
            for text in b.column(0).to_pylist():
                words = _WORD.findall(text.lower())
                marks.append(min(xxhash.xxh64_intdigest(" ".join(words[i : i + 4])) for i in range(max(1, len(words) - 3))) >> 1)
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), b.column(0), b.column(1)], names=["mark", "text", "label"])

    rows = sample.select("text", F.col("label").cast("int")).mapInArrow(run, "mark long, text string, label int")
    return materialize(rows.groupBy("mark", "label").agg(F.min("text").alias("text")).select("text", "label"), "toxic-sample")


def text_counts(texts: DataFrame, wanted: set[str] | None = None) -> DataFrame:
    """(entry, n): in how many texts each entry occurs, summed in the task before the shuffle; with wanted, only those."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["entry", "n"])

        only, seen = shared.value, Counter()
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                seen.update(entries_of(text) if only is None else only & entries_of(text))
                if len(seen) > 300_000:
                    yield flush()
                    seen = Counter()
        if seen:
            yield flush()

    return texts.select("text").mapInArrow(run, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Entries and weights from (text, label) rows: first those of enough toxic texts, then how many others hold them."""
    texts = distinct_texts(sample)
    size = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    good, bad = size.get(0, 0), size.get(1, 0)
    bad_counts = materialize(text_counts(texts.filter("label = 1")), "toxic-counts")
    frequent = bad_counts.filter(F.col("n") >= MIN_TEXTS).withColumnRenamed("n", "a")
    words = bad_counts.filter(~F.col("entry").contains(" ") & ~F.col("entry").endswith("*") & (F.length("entry") > STEM[0]))
    starts = F.transform(F.sequence(F.lit(STEM[0]), F.least(F.length("entry") - 1, F.lit(STEM[-1]))), lambda k: F.concat(F.left("entry", k), F.lit("*")))
    forms = words.select(F.explode(starts).alias("entry"), "n").groupBy("entry").agg(F.count(F.lit(1)).alias("forms"), F.max("n").alias("top"))
    sound = ~F.col("entry").endswith("*") | ((F.col("forms") >= MIN_FORMS) & (2 * F.col("top") <= F.col("a")))
    some = materialize(frequent.join(forms, "entry", "left").filter(sound).select("entry", "a"), "toxic-entries")
    few = some.count() <= BROADCAST_CANDIDATES
    others = text_counts(texts.filter("label = 0"), {r.entry for r in some.select("entry").collect()} if few else None)
    both = some.join(others, "entry", "left").withColumn("b", F.coalesce("n", F.lit(0)))
    odds = F.log((F.col("a") + 0.5) / (bad + 1.0)) - F.log((F.col("b") + 0.5) / (good + 1.0))
    sigma = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    both = both.withColumn("odds", odds).withColumn("z", F.col("odds") / sigma)
    both = both.filter((F.col("odds") >= MIN_ODDS) & (F.col("z") >= F.when(F.col("entry").contains(" "), PAIR_SIGMA).otherwise(MIN_SIGMA)))
    found = {r.entry: float(r.odds) for r in both.orderBy(F.desc("z"), "entry").collect()}  # of the bounded sample
    # a pair adds nothing where one of its words is an entry itself, nor a word or stem where a shorter stem weighs as much
    plain = Grammar({e: w for e, w in found.items() if " " not in e})
    held = {}
    for e, w in found.items():
        if " " in e:
            if any(plain.symbol(x)[0] == INSULT for x in e.split(" ")):
                continue
        elif any(found.get(f"{e.rstrip('*')[:k]}*", 0.0) >= w for k in STEM if k < len(e.rstrip("*"))):
            continue
        held[e] = w
    return held


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    A null text is empty and scores like any text without a match; a very long clause is read as a whole. Only rows
    whose labels may be learnt are read from labels; without any, all scores are equal. Rows with a null doc_id count as
    not held out but train nothing. Repeated rows score alike. An empty table gives no rows.
    """
    spark = docs.sparkSession
    sample = materialize(labelled_sample(docs, labels.filter(training(labels["doc_id"])), "toxic", SAMPLE_ROWS), "toxic-labelled")
    shared = spark.sparkContext.broadcast(learn_lexicon(sample))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(shared.value)
        for b in batches:
            x = [grammar.features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in x], pa.float64()) for i in range(3))], names=["key", "x0", "x1", "x2"])

    fit = sample.select(F.col("label").cast("long").alias("key"), "text").mapInArrow(measure, "key long, x0 double, x1 double, x2 double").groupBy("key", "x0", "x1", "x2").count()
    fit = fit.orderBy("key", "x0", "x1", "x2").toPandas()
    weights = logistic(fit[["x0", "x1", "x2"]].to_numpy(), fit["key"].to_numpy(), fit["count"].to_numpy())
    shared_weights = spark.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, w = Grammar(shared.value), shared_weights.value
        for b in slices(batches):
            x = np.array([grammar.features(t) for t in b.column(1).to_pylist()]).reshape(-1, 3)
            p = sigmoid(w[0] + x @ w[1:])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = docs.select(F.col("doc_id").cast("long"), text_column(docs).alias("text")).mapInArrow(score, "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(~training(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
