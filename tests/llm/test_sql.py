"""The corpus operators that SQL can express against DuckDB, on whole tables."""

from __future__ import annotations

import duckdb
import pytest

from evistra.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_same_rows(spark, name, size):
    folder = f"/root/testdata/sf{size}"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.fetchall())
