"""Catalog scan.

The catalog file is one JSON document ``{"entries": [...]}``; array
position is semantic (ties in every ordering fall back to it), so it is kept
as ``ord``. A whole-file JSON document is read by one task, so it is
converted once to parquet (``to_parquet``) and worked from there. As JSON
Lines (an entry a line, with its ``ord``) the catalog is split among tasks
like any text; a line without ``ord`` or that is no JSON object is reported,
not dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY_SCHEMA = (
    "id string, type string, title string, authors array<string>, year int, month int, "
    "venue string, abstract string, url string, doi string, pdf_url string, categories array<string>, "
    "framework_mappings map<string,array<string>>, tags array<string>, added_date string, "
    "added_by string, source_api string, "
    "external_ids struct<arxiv_id:string,semantic_scholar_id:string,doi:string>, "
    "citation_count bigint, open_access boolean, reviewed boolean")


def read_catalog_json(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(_file_schema()).option("multiLine", True).json(path)
    e = raw.select(F.posexplode("entries").alias("ord", "e"))
    return e.select(F.col("ord").cast("bigint"), "e.*").withColumn(
        "added_date", F.expr("try_cast(added_date AS DATE)"))


def read_catalog_raw(spark: SparkSession, path: str) -> DataFrame:
    """Entries as raw JSON text with ``ord`` (input of the V1 validator):
    the file is parsed as a variant so no value is coerced."""
    raw = spark.read.text(path, wholetext=True)
    v = raw.select(F.parse_json("value").alias("v"))
    arr = v.select(F.try_variant_get("v", "$.entries", "array<variant>").alias("a"))
    return arr.select(F.posexplode("a").alias("ord", "x")).select(
        F.col("ord").cast("bigint"), F.to_json("x").alias("raw"))


def write_catalog_lines(df: DataFrame, path: str) -> None:
    """The catalog as JSON Lines; absent fields are left out."""
    df.select("ord", *[c for c in _names() if c in df.columns]).write.mode("errorifexists").json(path)


def read_catalog_lines(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON Lines catalog; fails on a line that has no place."""
    lines = spark.read.schema(f"ord bigint, {ENTRY_SCHEMA}, _bad string").option(
        "columnNameOfCorruptRecord", "_bad").json(path)
    why = F.concat(F.lit("catalog line without a place: "), F.substring(F.coalesce("_bad", "id", F.lit("")), 1, 80))
    return (lines.withColumn("ord", F.when(F.col("ord").isNull() | F.col("_bad").isNotNull(), F.raise_error(why))
                             .otherwise(F.col("ord")))
            .drop("_bad").withColumn("added_date", F.expr("try_cast(added_date AS DATE)")))


def _names() -> list[str]:
    return [f.split(":")[0] for f in _struct_fields(ENTRY_SCHEMA).split(", ")]


def _file_schema() -> str:
    return f"entries array<struct<{_struct_fields(ENTRY_SCHEMA)}>>"


def _struct_fields(schema: str) -> str:
    # "a string, b int" -> "a: string, b: int" (struct DDL)
    out, depth, cur = [], 0, ""
    for ch in schema:
        if ch == "<":
            depth += 1
        elif ch == ">":
            depth -= 1
        if ch == "," and depth == 0:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    out.append(cur.strip())
    return ", ".join(f"{f.split(' ', 1)[0]}: {f.split(' ', 1)[1]}" for f in out)


def to_parquet(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)
