"""The quality classifier's posteriors and the toxicity grammar against plain versions of their rules."""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from evistra.llm import quality_classifier, toxicity
from evistra.llm._common import table


def plain_strength(sites):
    """sites: (n, s, prior) of each; how many documents a prior is worth, by the method of moments."""
    total = sum(n for n, _, _ in sites)
    mean = sum(n * m for n, _, m in sites) / total
    spread = sum(n * (s / n - m) ** 2 for n, s, m in sites) / total
    within = mean * (1 - mean)
    between = max(spread - within * len(sites) / total, within / 1e6, 1e-9)
    return min(max(within / between - 1, 5.0), 1e6)


def test_posteriors_are_those_of_plain_sums(spark, sf):
    docs = table(spark, sf, "documents")
    docs = docs.union(docs.limit(3)).union(spark.createDataFrame([(-1, "words without a source", None, None, 3)], docs.schema))
    got = quality_classifier.classify(docs, table(spark, sf, "labels")).collect()
    assert len(got) == docs.count()
    paths, hosts = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for r in got:
        for at in (paths[r.row.source, r.row.lang], hosts[r.row.source]):
            at[0] += 1
            at[1] += r.evidence
    share = sum(s for _, s in hosts.values()) / len(got)
    host = plain_strength([(n, s, share) for n, s in hosts.values()])
    mixed = lambda s, n, prior, k: (s + k * prior) / (n + k)
    path = plain_strength([(n, s, mixed(hosts[h][1], hosts[h][0], share, host)) for (h, _), (n, s) in paths.items()])
    logit = lambda p: math.log(p / (1 - p))
    clip = lambda p: min(max(p, 1e-6), 1 - 1e-6)
    for r in got:
        (n, s), (hn, hs) = paths[r.row.source, r.row.lang], hosts[r.row.source]
        site = mixed(s - r.evidence, n - 1, mixed(hs - r.evidence, hn - 1, share, host), path)
        z = logit(clip(r.evidence)) + logit(clip(site)) - logit(clip(share))
        assert r.site == pytest.approx(site) and r.probability == pytest.approx(1 / (1 + math.exp(-z))) and r.accepted == (r.probability >= 0.5)


LEXICON = {"idiot": 2.0, "dumb ox": 3.0, "stup*": 1.5}


def plain_clause(words):
    """What each insult and threat of a clause weighs, by looking around it."""
    kind, weight = [], []
    for i, w in enumerate(words):
        found = LEXICON.get(w) or (1.5 if len(w) > 4 and w.startswith("stup") else None)
        if found is None and i and f"{words[i - 1]} {w}" in LEXICON and w not in LEXICON:
            found = LEXICON[f"{words[i - 1]} {w}"]
        sets = ((toxicity.THREATS, "threat"), (toxicity.TARGETS, "target"), (toxicity.OBJECTS, "object"), (toxicity.NEGATIONS, "no"), (toxicity.REPORTS, "report"))
        kind.append("insult" if found else next((k for words_, k in sets if w in words_), ""))
        weight.append(found or (3.0 if kind[-1] == "threat" else 0.0))
    total = 0.0
    for i, k in enumerate(kind):
        if k not in ("insult", "threat"):
            continue
        w = weight[i] * (0.3 if "no" in kind[max(0, i - 3) : i] else 1.0) * (0.4 if "report" in kind[:i] else 1.0)
        persons = lambda part: any(x in ("target", "object") for x in part)
        if k == "insult":
            w *= 1.3 if persons(kind[max(0, i - 4) : i]) or persons(kind[i + 1 : i + 5]) else 1.0
        elif "object" not in kind[max(0, i - 3) : i] and not persons(kind[i + 1 : i + 4]):
            w = 0.0
        total += w
    return total


def test_grammar_is_that_of_looking_around_each_word(spark, sf):
    grammar, pick = toxicity.Grammar(LEXICON), random.Random(11)
    some = ["idiot", "dumb", "ox", "stupidly", "stup", "kill", "matar", "you", "dich", "te", "not", "pas", "said", "word", "the", "rain", "he"]
    for _ in range(3000):
        words = [pick.choice(some) for _ in range(pick.randrange(14))]
        assert grammar.clause_weight(words) == pytest.approx(plain_clause(words))
    texts = [r.text or "" for r in table(spark, sf, "documents").select("text").collect()]
    for text in texts[:120]:
        words = text.split()
        for _ in range(len(words) // 40 + 1):
            words.insert(pick.randrange(len(words) + 1), pick.choice(some[:13]))
        text = " ".join(words)
        want = [w for c in re.split(r"[.!?;\n]", text.lower()) if (w := plain_clause(re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", c)))]
        got = grammar.features(text)
        assert got == pytest.approx((max(want), np.log1p(sum(want)), np.log1p(len(want))) if want else (0.0, 0.0, 0.0))
