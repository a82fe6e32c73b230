"""Small models fitted on bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evistra.llm._common import text_column


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the constant first) of a logistic regression by Newton steps; zeros without rows."""
    a = np.concatenate((np.ones((len(x), 1)), x.astype(np.float64)), axis=1)
    w = np.zeros(a.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (a.shape[1] - 1)])
    for _ in range(30):
        p = sigmoid(a @ w)
        step = np.linalg.solve((a * (times * p * (1 - p))[:, None]).T @ a + penalty, a.T @ (times * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(text, label) of at most `rows` labelled doc_ids, those with the least hashes.

    The chosen ids are few enough to broadcast. A doc_id with several labels takes the largest; of a repeated doc_id
    one text (the least) counts.
    """
    clean = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    chosen = clean.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long"), text_column(docs).alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).drop("doc_id")
