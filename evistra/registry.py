"""Named queries of the engine and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Which inventory rows each query covers.
COVERS: dict[str, str] = {}
FLAGSHIP = "eligibility_rollup"


def query(covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the inventory rows it covers and the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        name = f.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name], COVERS[name] = f, covers
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


from evistra.plans import decisions, evaluation, functions, monitoring, retrieval, scoring, texts, validation  # noqa: E402, F401
from evistra.streaming import plans as _streaming  # noqa: E402, F401
