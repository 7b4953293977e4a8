"""Catalog analytics: counts, coverage, ranked and top-k lists, facets
(A6-A10, A13, A14, W1-W7, J5, J6, P8-P10).

Input is a catalog DataFrame with the entry schema (see
``quire.sources.catalog``), including ``ord`` (position in the catalog file). Dims (taxonomy,
frameworks) are tiny and broadcast after a size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.common import ordered_rank, salted_top_k
from quire.sources.dims import checked_broadcast


def catalog_order_cols() -> list[Column]:
    """Year desc, citations desc (missing = 0), then file order (the
    upstream sort is stable)."""
    return [F.col("year").desc_nulls_last(),
            F.coalesce(F.col("citation_count"), F.lit(0)).desc(),
            F.col("ord").asc()]


def most_recent(df: DataFrame, k: int = 5) -> DataFrame:
    """Top-k in catalog order (TakeOrderedAndProject, no full sort)."""
    return df.orderBy(*catalog_order_cols()).limit(k)


def most_cited(df: DataFrame, k: int = 5) -> DataFrame:
    """Top-k by citations; null and 0 are excluded."""
    return (df.filter(F.col("citation_count") > 0)
            .orderBy(F.col("citation_count").desc(), F.col("ord").asc()).limit(k))


def category_occurrences(df: DataFrame) -> DataFrame:
    """(ord, pos, category_id) for every listed category occurrence."""
    # the _outer form keeps Catalyst from inferring a size(categories) > 0
    # filter and pushing it (with the whole tagging expression) below the
    # projection, where it would be evaluated twice
    return (df.select("ord", F.posexplode_outer("categories").alias("pos", "category_id"))
            .filter(F.col("category_id").isNotNull()))


def category_counts(df: DataFrame) -> DataFrame:
    """Occurrences per category plus first-seen position (for ties)."""
    return (category_occurrences(df).groupBy("category_id")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.min(F.struct("ord", "pos")).alias("first_seen")))


def top_categories(df: DataFrame, k: int = 10) -> DataFrame:
    """The k most used categories; ties in first-seen order."""
    return (category_counts(df)
            .orderBy(F.col("n").desc(), F.col("first_seen").asc()).limit(k)
            .select("category_id", "n", F.col("first_seen.ord").alias("first_ord"),
                    F.col("first_seen.pos").alias("first_pos")))


def taxonomy_tree_counts(df: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Every taxonomy category with its count (0 if unused), plus a
    per-domain rollup row (``category_id`` null) and a grand total."""
    counts = category_counts(df).select("category_id", "n")
    tree = (taxonomy.select("domain_id", "domain_ord", "category_id", "category_ord")
            .join(counts, "category_id", "left")
            .withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint")))
    return (tree.rollup("domain_id", "category_id")
            .agg(F.sum("n").cast("bigint").alias("n"),
                 F.min("domain_ord").alias("domain_ord"),
                 F.min("category_ord").alias("category_ord")))


def catalog_stats(df: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Total, reviewed, categories (from the taxonomy), types, year range."""
    s = df.agg(F.count(F.lit(1)).alias("total_entries"),
               F.count_if(F.col("reviewed") == F.lit(True)).alias("reviewed_count"),
               F.count_distinct("type").alias("type_count"),
               F.min("year").alias("year_min"), F.max("year").alias("year_max"))
    n_cat = taxonomy.select(F.count(F.lit(1))).scalar()  # scalar subquery
    return s.select(
        "total_entries", "reviewed_count", n_cat.alias("category_count"), "type_count",
        F.concat(F.col("year_min").cast("string"), F.lit("-"),
                 F.col("year_max").cast("string")).alias("year_range"))


def framework_links(df: DataFrame) -> DataFrame:
    """(ord, id, framework_id, control_id), one row per distinct link of an
    entry (a control listed twice is one link: duplicates are inside a row)."""
    m = df.select("ord", "id", F.explode("framework_mappings").alias("framework_id", "ids"))
    return m.select("ord", "id", "framework_id", F.explode(F.array_distinct("ids")).alias("control_id"))


def framework_coverage(df: DataFrame, frameworks: DataFrame) -> DataFrame:
    """Entries with at least one control listed, per framework (0 if none)."""
    m = df.select("ord", F.explode("framework_mappings").alias("framework_id", "ids"))
    # one map entry per framework and catalog entry: a plain count
    per = m.filter(F.size("ids") > 0).groupBy("framework_id").agg(F.count(F.lit(1)).alias("n_entries"))
    fws = frameworks.select("framework_id", "framework_ord").dropDuplicates(["framework_id"])
    return (checked_broadcast(fws).join(per, "framework_id", "left")
            .select("framework_id", "framework_ord",
                    F.coalesce("n_entries", F.lit(0)).cast("bigint").alias("n_entries")))


def control_entries(df: DataFrame, frameworks: DataFrame, k: int = 5) -> DataFrame:
    """J6 + A10 + W6: per control, the entry count, the first k entries in
    catalog file order (not W1), and the overflow count. Counting is a
    partial/final aggregate and the top-k is salted, so a control linked to a
    third of the catalog is never handled by one task alone."""
    links = framework_links(df)
    counts = links.groupBy("framework_id", "control_id").agg(F.count(F.lit(1)).alias("n_entries"))
    top = salted_top_k(links, ["framework_id", "control_id"], [F.col("ord")], k, "ord")
    tops = top.groupBy("framework_id", "control_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("top"))
    ctl = frameworks.select("framework_id", "control_id", "control_ord")
    return (checked_broadcast(ctl).join(counts, ["framework_id", "control_id"], "left")
            .join(tops, ["framework_id", "control_id"], "left")
            .select("framework_id", "control_id", "control_ord",
                    F.coalesce("n_entries", F.lit(0)).cast("bigint").alias("n_entries"),
                    F.coalesce(F.array_join(F.transform("top", lambda x: x["id"]), ","), F.lit(""))
                    .alias("top_ids"),
                    F.greatest(F.coalesce("n_entries", F.lit(0)) - k, F.lit(0)).cast("bigint")
                    .alias("more")))


def category_domains(df: DataFrame, taxonomy: DataFrame, default: str = "other") -> DataFrame:
    """Category -> domain for every occurrence; unknown ids get ``default``."""
    tax = checked_broadcast(taxonomy.select("category_id", "domain_id"))
    return (category_occurrences(df).join(tax, "category_id", "left")
            .withColumn("domain_id", F.coalesce("domain_id", F.lit(default))))


def category_listing(df: DataFrame, category_id: str | None = None) -> DataFrame:
    """P9 + W5: ranked entries inside every category, in one pass.

    An entry counts once per category even if it repeats the id.
    """
    occ = df.select("ord", "id", "year", "citation_count",
                    F.explode_outer(F.array_distinct("categories")).alias("category_id")) \
        .filter(F.col("category_id").isNotNull())
    if category_id is not None:
        occ = occ.filter(F.col("category_id") == category_id)
    # range-sorted ranking: a category used by a third of the catalog is
    # spread over many tasks (see ordered_rank)
    return ordered_rank(occ, ["category_id"], catalog_order_cols())


def lookup(df: DataFrame, entry_id: str, ord_: int | None = None) -> DataFrame:
    """P10: point lookup by id. A stored id is filtered in the scan, which
    opens one row group of a table laid out by ``sinks.write_by_id``. Where
    ids are numbered by position, the position ``ord_`` that the id stands
    for is filtered as well, which reaches the scan even if ids are computed."""
    if ord_ is not None:
        df = df.filter(F.col("ord") == ord_)
    return df.filter(F.col("id") == entry_id)


def facet_filter(df: DataFrame, type_: str = "all", year="all", reviewed="all") -> DataFrame:
    """ANDed facet filters; ``all`` switches one off. A null ``reviewed``
    matches neither true nor false."""
    if type_ != "all":
        df = df.filter(F.col("type") == type_)
    if year != "all":
        df = df.filter(F.col("year") == int(year))
    if reviewed != "all":
        want = reviewed in (True, "true")
        df = df.filter(F.col("reviewed") == F.lit(want))
    return df


def facet_values(df: DataFrame) -> DataFrame:
    """Distinct years (desc) and types (asc), with counts."""
    facets = F.array(
        F.struct(F.lit("year").alias("facet"), F.col("year").cast("string").alias("value"),
                 (-F.col("year")).cast("bigint").alias("sort_key")),
        F.struct(F.lit("type").alias("facet"), F.col("type").alias("value"), F.lit(0).cast("bigint").alias("sort_key")))
    # both facets from one scan
    return (df.select(F.explode(facets).alias("f")).groupBy("f.facet", "f.value", "f.sort_key")
            .agg(F.count(F.lit(1)).alias("n")).select("facet", "value", "n", "sort_key"))


def taxonomy_totals(taxonomy: DataFrame) -> DataFrame:
    """Number of domains and categories."""
    return taxonomy.agg(F.count_distinct("domain_id").alias("n_domains"),
                        F.count(F.lit(1)).alias("n_categories"))
