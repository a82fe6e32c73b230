"""Every query of the registry against its SQL on the same tables."""

from __future__ import annotations

import datetime
import math

import duckdb
import pytest

from evistra import registry
from evistra.plans import retrieval

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.6g}")
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    try:
        return float(f"{float(x):.6g}")
    except (TypeError, ValueError):
        return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in registry.ORACLE_SQL:
        assert len(df.columns) == len(set(df.columns))
        return
    want = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows_of(names, want.fetchall())


def test_texts_of_parents_without_evidence_are_not_shuffled(spark, sf):
    evidence = spark.createDataFrame([("D0", 3), ("D1", 0), ("D1", 0)], "doc string, parent_seq long")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        kids = retrieval._children(spark, sf, evidence)
        assert sorted((r.doc, r.parent_seq, r.chunk_index) for r in kids.collect()) == [(d, s, i) for d, s in (("D0", 3), ("D1", 0)) for i in range(4)]
        assert "hashpartitioning" not in kids._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_entry_imports_and_names_everything():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())
