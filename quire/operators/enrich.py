"""DOI backfill (P6, J7, J8, J9, A12; K3 is ``sinks.write_doi_delta``).

Lookups run against landed metadata tables instead of per-entry HTTP
calls: ``arxiv_meta(arxiv_id, doi)`` and ``lookup(rank, title, year, doi)``
(search results; ``rank`` is the upstream result order, global or per
entry via an ``ord`` column).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import fixed
from quire.functions import text
from quire.operators import linkage
from quire.session import cut


def needs_doi(catalog: DataFrame, types=("paper", "book")) -> DataFrame:
    """papers/books with neither ``doi`` nor ``external_ids.doi``
    (empty string counts as missing)."""
    return catalog.filter(F.col("type").isin(*types)
                          & text.empty_to_null("doi").isNull()
                          & text.empty_to_null(F.col("external_ids.doi")).isNull())


def doi_by_arxiv(entries: DataFrame, arxiv_meta: DataFrame) -> DataFrame:
    """``(ord, doi_a)`` from landed arXiv metadata; blank = not found.
    ``arxiv_meta`` must be unique per ``arxiv_id`` (see ``ingest.keep_first``)."""
    meta = arxiv_meta.select("arxiv_id", text.empty_to_null(F.trim("doi")).alias("doi_a"))
    e = entries.select("ord", text.empty_to_null(F.col("external_ids.arxiv_id")).alias("arxiv_id"))
    return e.join(meta, "arxiv_id", "inner").filter(F.col("doi_a").isNotNull()).select("ord", "doi_a")


def doi_by_title(entries: DataFrame, lookup: DataFrame, threshold: str = fixed.BACKFILL_THRESHOLD,
                 year_band: int = 1) -> DataFrame:
    """First lookup result (by ``rank``) whose title has word-set Jaccard
    >= ``threshold`` with the entry title, whose year is within
    ``year_band`` (null on either side passes) and which has a DOI.

    Identical titles are collapsed on both sides before the similarity
    join (lookup rows keep their best rank per (title set, year)), so a
    title shared by a third of the rows never multiplies the pairs.
    """
    # both sides are tokenised once and written
    e = cut(linkage.title_keys(entries.select(F.col("ord").alias("rid"), "title", "year"))
            .select("rid", "year", "words"), "entries")
    e_sets, e_names, e_members = linkage.distinct_sets(e, "entry-sets")
    lk = lookup.filter(text.empty_to_null("doi").isNotNull())   # no DOI: skipped before ranking
    if "lrid" not in lk.columns:
        lk = lk.withColumn("lrid", F.col("rank"))
    lk = linkage.title_keys(lk).filter(F.size("words") > 0).withColumn("sw", F.sort_array("words"))
    lk = cut(lk.select("sw", F.sha2(F.array_join("sw", " "), 256).alias("_sha"), "year", "rank", "lrid", "doi"), "lookup")
    l_groups = cut(lk.groupBy("_sha", "year").agg(F.min(F.struct("rank", "lrid", "doi")).alias("best")), "lookup-best")
    l_sets = cut(lk.groupBy("_sha").agg(F.first("sw").alias("words"))
                 .withColumn("rid", F.monotonically_increasing_id()), "lookup-sets")
    l_groups = l_groups.join(l_sets.select("_sha", F.col("rid").alias("lsid")), "_sha")
    pairs = linkage.similar_pairs(e_sets, l_sets.select("rid", "words"), threshold, strict=False, only=e_names)
    cand = (pairs.select(F.col("l_rid").alias("sid"), F.col("r_rid").alias("lsid"))
            .join(l_groups.select("lsid", F.col("year").alias("l_year"), "best"), "lsid")
            .join(e_members, "sid")
            .join(e.select("rid", F.col("year").alias("e_year")), "rid"))
    band = F.col("e_year").isNull() | F.col("l_year").isNull() | (F.abs(F.col("e_year") - F.col("l_year")) <= year_band)
    return (cand.filter(band).groupBy(F.col("rid").alias("ord"))
            .agg(F.min("best").alias("best")).select("ord", F.col("best.doi").alias("doi_c")))


def backfill(catalog: DataFrame, arxiv_meta: DataFrame, lookup: DataFrame,
             threshold: str = fixed.BACKFILL_THRESHOLD) -> DataFrame:
    """arXiv first, title search for the rest (also where the arXiv
    lookup found nothing). Returns ``(ord, id, title, new_doi, doi_source)``
    for every eligible entry; ``new_doi`` null = not found."""
    need = needs_doi(catalog).select("ord", "id", "title", "year", "external_ids")
    a = doi_by_arxiv(need, arxiv_meta)
    rest = need.join(a, "ord", "left_anti")
    c = doi_by_title(rest, lookup, threshold)
    out = need.join(a, "ord", "left").join(c, "ord", "left")
    return out.select(
        "ord", "id", "title",
        F.coalesce("doi_a", "doi_c").alias("new_doi"),
        F.when(F.col("doi_a").isNotNull(), F.lit("arxiv"))
        .when(F.col("doi_c").isNotNull(), F.lit("crossref")).alias("doi_source"))


def backfill_counters(result: DataFrame) -> DataFrame:
    """Entries per DOI source (``none`` = not found)."""
    return result.groupBy(F.coalesce("doi_source", F.lit("none")).alias("doi_source")).agg(
        F.count(F.lit(1)).alias("n"))


def doi_by_title_results(entries: DataFrame, results: DataFrame,
                         threshold: str = fixed.BACKFILL_THRESHOLD, year_band: int = 1) -> DataFrame:
    """J8 over per-entry search results ``(ord, rank, title, year, doi)`` (as
    landed by ``landed.read_crossref_lookup``): each entry is compared with
    its own few results only, so this is an equi-join on ``ord``."""
    e = linkage.title_keys(entries.select("ord", "title", "year")).select(
        "ord", F.col("words").alias("e_words"), F.col("year").alias("e_year"))
    r = linkage.title_keys(results.filter(text.empty_to_null("doi").isNotNull())).select(
        "ord", "rank", "doi", F.col("words").alias("r_words"), F.col("year").alias("r_year"))
    m = e.join(r, "ord").withColumn("sim", text.jaccard("e_words", "r_words"))
    band = F.col("e_year").isNull() | F.col("r_year").isNull() | (F.abs(F.col("e_year") - F.col("r_year")) <= year_band)
    return (m.filter((F.col("sim") >= float(threshold)) & band)
            .groupBy("ord").agg(F.min_by("doi", F.col("rank")).alias("doi_c")))
