"""Ingest-side operators over landed hits: keep-first dedup across queries
(A1-A3), recency filters (P3-P5), hits per query (A15)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators.common import ordered_rank


def arxiv_key() -> Column:
    """A1 key: the arXiv id."""
    return F.col("arxiv_id")


def s2_key() -> Column:
    """A2 key: S2 id, else DOI, else lower-cased title (one namespace)."""
    return text.first_non_empty("semantic_scholar_id", "doi", F.lower("title"))


def crossref_key() -> Column:
    """A3 key: DOI (case kept), else lower-cased title."""
    return text.first_non_empty("doi", F.lower("title"))


def keep_first(df: DataFrame, key: Column, order: list[str] = ("query_ord", "pos")) -> DataFrame:
    """A1-A3: keep the first row per key in (query, position) order.

    Written as ``min_by`` over a struct, which Spark aggregates partially on
    the map side: a key holding a third of all rows is reduced in parallel
    before the shuffle, unlike a window that sorts the whole group in one
    task. ``dropDuplicates`` is not used (it keeps an arbitrary row).
    """
    cols = [c for c in df.columns]
    ordering = F.struct(*[F.col(c) for c in order])
    return (df.withColumn("_key", key)
            .groupBy("_key").agg(F.min_by(F.struct(*cols), ordering).alias("_r"))
            .select("_r.*"))


def number_positions(df: DataFrame, order: list[str] = ("query_ord", "pos")) -> DataFrame:
    """Give the rows of one source their place in one list over all its
    queries: ``pos`` becomes the dense rank (from 0) in (query, position)
    order. Run after keep-first and the recency filter, before K1."""
    ranked = ordered_rank(df, [], [F.col(c) for c in order], out="_p")
    return ranked.withColumn("pos", F.col("_p") - 1).drop("_p")


def _day_literal(df: DataFrame, date_col: str, y: int, m: int) -> Column:
    """Midnight of y-m-01 in the column's own type (cast from text, so the
    Python process time zone plays no part)."""
    return F.lit(f"{y:04d}-{m:02d}-01 00:00:00").cast(df.schema[date_col].dataType)


def month_cutoff(as_of: _dt.date, days: int) -> tuple[int, int]:
    c = as_of - _dt.timedelta(days=days)
    return c.year, c.month


def recent_by_month(df: DataFrame, as_of: _dt.date, days: int = 365, date_col: str | None = None) -> DataFrame:
    """Keep whole months from the cutoff month on (month 0 in the cutoff
    year is not recent). Not packed into year*12+month: month can be 0.

    When year and month come from a date/timestamp column, pass it as
    ``date_col``: the same test is then ``date >= first day of the cutoff
    month``, which reaches the parquet scan as a pushed filter."""
    cy, cm = month_cutoff(as_of, days)
    if date_col is not None:
        return df.filter(F.col(date_col) >= _day_literal(df, date_col, cy, cm))
    y, m = F.col("year"), F.col("month")
    return df.filter((y > cy) | ((y == cy) & (m >= cm)))


def recent_or_cited(df: DataFrame, as_of: _dt.date, days: int = 180, min_citations: int = 3) -> DataFrame:
    """Drop year 0/null; keep recent rows (month grain) or rows with at
    least ``min_citations`` citations."""
    cy, cm = month_cutoff(as_of, days)
    y, m = F.col("year"), F.coalesce(F.col("month"), F.lit(0))
    recent = (y > cy) | ((y == cy) & (m >= cm))
    cited = F.coalesce(F.col("citation_count"), F.lit(0)) >= min_citations
    return df.filter(y.isNotNull() & (y != 0) & (recent | cited))


def year_floor(df: DataFrame, floor: int = 2023, date_col: str | None = None) -> DataFrame:
    """P5 (``date_col``: the pushable form, ``date >= floor-01-01``)."""
    if date_col is not None:
        return df.filter(F.col(date_col) >= _day_literal(df, date_col, floor, 1))
    return df.filter(F.col("year") >= floor)


def hits_per_query(df: DataFrame, key: Column) -> DataFrame:
    """Per query, rows found, keys first seen there, and the running
    unique total. The running sum is a window over the small per-query
    table (one row per query)."""
    k = df.withColumn("_key", key)
    found = k.groupBy("query_ord").agg(F.count(F.lit(1)).alias("found"))
    first = (k.groupBy("_key").agg(F.min("query_ord").alias("query_ord"))
             .groupBy("query_ord").agg(F.count(F.lit(1)).alias("new_unique")))
    per = found.join(first, "query_ord", "left").withColumn(
        "new_unique", F.coalesce("new_unique", F.lit(0)).cast("bigint"))
    w = Window.orderBy("query_ord").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("unique_total", F.sum("new_unique").over(w).cast("bigint"))
