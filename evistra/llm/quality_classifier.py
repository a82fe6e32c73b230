"""Quality by hierarchical empirical Bayes.

A logistic regression on a text's surface (fitted on a bounded sample of labelled rows) gives each document's own
evidence, once, kept beside the rows. Grouped sums of that evidence over all documents give each host and each path under
it a posterior: a path is shrunk towards its host and a host towards the whole corpus, by strengths estimated from how
much sites differ. A document's final probability shifts its own log odds by how far its path's stand from the corpus',
where the sums of its path and host are taken without itself, so that no evidence counts twice.

Documents carry no address; their source stands for the host and their language for the path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from evistra.llm._common import materialize, slices
from evistra.llm.learning import labelled_sample, logistic, sigmoid

SAMPLE_ROWS = 20_000
#: Site rows that are broadcast at most; more are joined by a shuffle.
BROADCAST_SITES = 100_000
_SYMBOL = re.compile(rb"[#*$%&|<>]")
_SHOUT = re.compile(rb"[!?]{2,}")
_UPPER = re.compile(rb"[A-Z]{2,}")
_DIGIT = re.compile(rb"[0-9]")
N_FEATURES = 10


def surface(text: bytes) -> tuple[float, ...]:
    """What the regression sees of a text; all zero without words."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * N_FEATURES
    lines = [x for x in text.split(b"\n") if x.strip()]
    size = max(1, sum(map(len, words)))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    same = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:], words[2:])))
    per_word = lambda p: len(p.findall(text)) / n
    return (
        1.0, float(np.log1p(n)), min(2.0, per_word(_SYMBOL)), min(2.0, per_word(_SHOUT)), sum(map(len, _UPPER.findall(text))) / size, len(_DIGIT.findall(text)) / size,
        1 - len(set(lines)) / max(1, len(lines)), same / n, 1 - pairs / max(1, n - 2) if n > 2 else 0.0, (max(counts.values()) - 1) / n,
    )


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights of the regression, from a bounded sample of the labelled documents."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [surface(t) for t in b.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "label"])

    sample = labelled_sample(docs, labels, "quality", SAMPLE_ROWS).select("text", "label").mapInArrow(measure, "x array<double>, label int").toPandas()
    x = np.array(sample["x"].tolist(), dtype=np.float64).reshape(-1, N_FEATURES)
    return logistic(x, sample["label"].to_numpy(), np.ones(len(x)))


def evidence(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """rows with `evidence`, the probability that a document is good by its own text, in place of `text`."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    others = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in slices(batches):
            x = np.array([surface(t or b"") for t in b.column("text").cast(pa.binary()).to_pylist()]).reshape(-1, N_FEATURES)
            got = pa.array(sigmoid(w[0] + x @ w[1:]))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in others), got], names=[*(f.name for f in others), "evidence"])

    return rows.mapInArrow(run, StructType([*others, StructField("evidence", DoubleType())]))


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, prior: Column) -> float:
    """How many documents a site's prior is worth, by the method of moments; sites: (n, s, and what prior needs)."""
    m = sites.select("n", (F.col("s") / F.col("n")).alias("r"), prior.alias("m"))
    row = m.agg(
        (F.sum(F.col("n") * (F.col("r") - F.col("m")) ** 2) / F.sum("n")).alias("spread"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), (F.count(F.lit(1)) / F.sum("n")).alias("inverse"),
    ).first()
    if row["mean"] is None:
        return 1.0
    within = row["mean"] * (1 - row["mean"])
    between = max(row["spread"] - within * row["inverse"], within / 1e6, 1e-9)
    return float(np.clip(within / between - 1, 5.0, 1e6))


def site_sums(scored: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """(host, path, n, s, host_n, host_s): documents and evidence of each path and of its host; and the corpus' own share
    `all`, with how many documents it is worth for a host (`host`) and a host for its paths (`path`)."""
    paths = materialize(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("evidence").alias("s")), "sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    all_ = float(hosts.agg((F.sum("s") / F.sum("n")).alias("m")).first()["m"] or 0.5)
    both = paths.join(hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s")), "host")
    known = {"all": all_, "host": _strength(hosts, F.lit(all_))}
    return both, known | {"path": _strength(both, shrunk(F.col("host_s"), F.col("host_n"), F.lit(all_), known["host"]))}


def shrunk(s: Column, n: Column, prior: Column, strength: float) -> Column:
    return (s + strength * prior) / (n + strength)


def posterior(known: dict[str, float], own: Column | None = None) -> Column:
    """A path's posterior share of good documents from its row of site_sums; with own, without that document's evidence."""
    less, one = (F.lit(0.0), 0) if own is None else (own, 1)
    host = shrunk(F.col("host_s") - less, F.col("host_n") - one, F.lit(known["all"]), known["host"])
    return shrunk(F.col("s") - less, F.col("n") - one, host, known["path"])


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, site): each path's posterior share of good documents; and the corpus' own share."""
    sums, known = site_sums(scored)
    return sums.select("host", "path", posterior(known).alias("site")), known["all"]


def classify(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(row, evidence, site, probability, accepted); row is the document with all its columns, or those named.

    Documents have a source for their host and a language for their path; null is a site of its own. A null text is
    empty. Without labels every document's evidence is a half and all are accepted. Repeated rows count as documents
    of their site and are judged alike. An empty table gives no rows.
    """
    known = lambda c: F.coalesce(F.concat(F.lit("="), docs[c].cast("string")), F.lit("null"))
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in columns or docs.columns)).alias("row"), "text", known("source").alias("host"), known("lang").alias("path"))
    scored = materialize(evidence(rows, fit(docs, labels)), "evidence")
    sites, known_sites = site_sums(scored.select("host", "path", "evidence"))
    if sites.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES:
        sites = F.broadcast(sites)
    out = scored.join(sites, ["host", "path"]).withColumn("site", posterior(known_sites, F.col("evidence")))
    z = _logit(F.col("evidence")) + _logit(F.col("site")) - _logit(F.lit(known_sites["all"]))
    out = out.withColumn("probability", 1 / (1 + F.exp(-z)))
    return out.select("row", "evidence", "site", "probability", (F.col("probability") >= 0.5).alias("accepted"))


def classifier_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, evidence, site, probability, accepted) of every document."""
    return classify(docs, labels, ["doc_id"]).select("row.doc_id", "evidence", "site", "probability", "accepted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't rejected, with their columns; null and empty texts are judged as texts without words.

    Repeated rows stay or go together; without labels all stay.
    """
    return classify(docs, labels).filter("accepted").select("row.*")
