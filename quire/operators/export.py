"""Served projections: BibTeX records (H13) and entry cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text


def _line(label: str, c: Column) -> Column:
    return F.concat(F.lit(f"  {label} = {{"), c, F.lit("},"))


def bibtex(df: DataFrame) -> Column:
    """Always ``@article``; key = id without dashes; authors joined by
    " and "; journal, doi and url lines only when non-empty."""
    opt = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", _line(label, c))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("@article{"), F.regexp_replace("id", "-", ""), F.lit(",")),
        _line("title", F.col("title")),
        _line("author", F.array_join("authors", " and ")),
        _line("year", F.col("year").cast("string")),
        opt("journal", F.col("venue")),
        opt("doi", F.col("doi")),
        opt("url", F.col("url")),
        F.lit("}"))


def framework_badges(m: Column) -> Column:
    """``framework:control`` for every listed control, in map order."""
    return F.flatten(F.transform(F.map_entries(m), lambda e: F.transform(
        F.coalesce(e["value"], F.array().cast("array<string>")),
        lambda x: F.concat(e["key"], F.lit(":"), x))))


def cards(df: DataFrame) -> DataFrame:
    """One served card per entry, combining H14-H17."""
    ext = text.external_id_rows("external_ids")
    badges = framework_badges(F.col("framework_mappings"))
    return df.select(
        "ord", "id", "type",
        text.year_month("year", "month").alias("published"),
        text.authors_short("authors").alias("authors_short"),
        F.array_join(text.category_labels("categories"), ", ").alias("category_labels"),
        F.when(F.col("citation_count") > 0, F.concat(F.col("citation_count").cast("string"), F.lit(" citations")))
        .alias("citations"),
        text.or_manual("added_by").alias("added_by"),
        text.or_manual("source_api").alias("source"),
        F.array_join(F.transform(ext, lambda p: F.concat(p["key"], F.lit("="), p["value"])), ";").alias("external_ids"),
        F.array_join(badges, ",").alias("frameworks"),
        (F.coalesce(F.size(badges), F.lit(0)) > 0).alias("show_mappings"),
    )
