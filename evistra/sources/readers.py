"""Readers and sinks: Markdown with frontmatter, JSON objects of objects, JSON lines, keyed upserts, stores and spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructType

from evistra.functions.text import mask

FRONTMATTER_KEYS = ("doc_id", "title", "layer", "effective_date", "expire_date")


def markdown(spark: SparkSession, root: str) -> DataFrame:
    """(path, raw) of all Markdown files under root but README.md, newlines normalised."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    raw = F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?|\x0b|\x0c| | |\x85", "\n")
    return files.filter(F.element_at(F.split("path", "/"), -1) != "README.md").select("path", raw.alias("raw"))


def frontmatter(docs: DataFrame) -> DataFrame:
    """docs with meta (key to value, as text) and body; a missing required key or block stops the query with its path."""
    block = F.regexp_extract("raw", r"\A---\n([\s\S]*?)\n---\n?", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: x.contains(":") & ~x.startswith("#"))
    strip = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), "^[\"'](.*)[\"']$", "$1")
    meta = F.map_from_entries(F.transform(pairs, lambda x: F.struct(strip(F.substring_index(x, ":", 1)), strip(F.regexp_extract(x, ":([\\s\\S]*)", 1)))))
    out = docs.withColumn("meta", meta).withColumn("body", F.regexp_replace("raw", r"\A---\n[\s\S]*?\n---\n?", ""))
    missing = F.filter(F.array(*map(F.lit, FRONTMATTER_KEYS)), lambda k: F.coalesce(F.element_at(F.col("meta"), k), F.lit("")) == "")
    problem = F.concat(F.lit("frontmatter of "), F.col("path"), F.lit(" lacks "), F.array_join(missing, ", "))
    return out.withColumn("meta", F.when(F.size(missing) == 0, F.col("meta")).otherwise(F.raise_error(problem).cast("map<string,string>")))


def tags(value: F.Column) -> F.Column:
    """A list from a comma-separated or bracketed tag line, trimmed, without empty entries."""
    return F.filter(F.transform(F.split(F.regexp_replace(value, r"^\[|\]$", ""), ","), lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")), lambda t: t != "")


def json_objects(spark: SparkSession, path: str, row: StructType) -> DataFrame:
    """Rows of a file holding an object of objects: key and the row's fields; other entries (`_note`) are dropped."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", MapType(StringType(), StringType()))).alias("key", "json"))
    return entries.filter(~F.col("key").startswith("_")).select("key", F.from_json("json", row).alias("row")).select("key", "row.*")


def json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped, a malformed one stops the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those with the same key; the last of several in new by `version`."""
    w = Window.partitionBy(key).orderBy(F.desc("version"))
    last = new.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return old.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def seed(tables: dict[str, DataFrame], folder: str, rules: dict[str, dict[str, Column]] | None = None) -> None:
    """Reset a store: write each table anew under folder, whatever was there, after its rules held for all of its rows.

    A broken rule stops the seeding of that table before anything of it is written.
    """
    for name, df in tables.items():
        checked = df
        for rule, ok in (rules or {}).get(name, {}).items():
            checked = checked.filter(F.assert_true(F.coalesce(ok, F.lit(False)), F.lit(f"{name} breaks {rule}")).isNull())
        checked.write.mode("overwrite").parquet(f"{folder}/{name}")


SPANS = "trace_id string, span_id string, parent_id string, name string, kind string, started timestamp, ended timestamp, input string, output string"


def append_spans(spans: DataFrame, folder: str) -> None:
    """Append spans (SPANS, times as they are) to a table, a batch or a stream's batch at a time; their texts are masked first."""
    fields = StructType.fromDDL(SPANS).fields
    masked = spans.withColumns({c: mask(F.col(c)) for c in ("input", "output")})
    masked.select(*(F.col(f.name).cast(f.dataType) for f in fields)).write.mode("append").parquet(folder)
