"""Files that a dated search opens, and table functions against their DataFrame forms."""

from __future__ import annotations

import glob

from pyspark.sql import functions as F

from evistra import registry  # noqa: F401
from evistra.operators import chunking, tables
from evistra.plans.retrieval import chunks_view
from evistra.sources import collection


def test_a_dated_search_opens_few_files(spark, tmp_path):
    where = f"{tmp_path}/chunks"
    spark.range(700).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    chunks = chunks_view(spark, str(tmp_path))
    collection.write(chunks, where, file_rows=10)
    every = glob.glob(f"{where}/*/*/*.parquet")
    rows = collection.read(spark, where, ["law"], "2023-06-30")
    want = chunks.filter("layer = 'law' and effective_date <= '2023-06-30' and expire_date > '2023-06-30'")
    assert sorted(r.chunk_id for r in rows.collect()) == sorted(r.chunk_id for r in want.collect())
    opened = {r[0] for r in rows.select(F.input_file_name()).collect()}
    assert all("layer=law/from_year=2023" in f for f in opened) and 0 < len(opened) < len([f for f in every if "layer=law" in f]) < len(every)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "from_year" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "LessThanOrEqual(effective_date" in plan.split("PushedFilters")[1]


def test_rows_without_a_layer_or_date_stay(spark, tmp_path):
    rows = [(1, None, "2023-01-01", "9999-12-31"), (2, "law", None, None), (3, "law", "2023-01-01", "9999-12-31")]
    collection.write(spark.createDataFrame(rows, "chunk_id long, layer string, effective_date string, expire_date string"), f"{tmp_path}/c")
    assert sorted(r.chunk_id for r in collection.read(spark, f"{tmp_path}/c").collect()) == [1, 2, 3]
    assert [r.chunk_id for r in collection.read(spark, f"{tmp_path}/c", ["law"], "2024-01-01").collect()] == [3]


def test_table_functions_give_the_rows_of_the_plain_ones(spark):
    tables.register(spark)
    bodies = ["intro\n\n## A\none\n\n~~~\n# no\n\n```\n~~~\ntwo\n| a |\n| b |\n\n### B\nc", "", None, "```\nopen\n\nto the end", "x\n```\na\n```\n```\nb\n```"]
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, body string")
    got = spark.sql("SELECT d.doc_id, s.* FROM {docs} AS d, LATERAL text_sections(d.body) AS s ORDER BY doc_id, section", docs=docs).collect()
    assert [tuple(r) for r in got] == [(i, n, path, text) for i, b in enumerate(bodies) for n, (path, text) in enumerate(chunking.sections(b or ""))]
    lines = docs.select("doc_id", F.posexplode(F.split("body", "\n")).alias("line", "text"))
    got = spark.sql("SELECT * FROM line_blocks(TABLE(SELECT doc_id, line, text FROM {lines}) PARTITION BY doc_id ORDER BY line) ORDER BY doc_id, block", lines=lines).collect()
    want = [(i, n, kind, text.count("\n") + 1) for i, b in enumerate(bodies) for n, (kind, text) in enumerate(chunking.blocks(b or ""))]
    assert [(r.doc_id, r.block, r.kind, r.n_lines) for r in got] == want
