"""Registered queries over the driver tables, each with its DuckDB oracle.

Each query is ``fn(spark, sf_dir) -> DataFrame`` with scalar output columns
(arrays joined to strings, doubles rounded to 6 places); the oracle SQL
returns the same column names. Register with ``@query(name, sql)``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import analytics, curate, enrich, export, ingest, linkage, quality, search
from quire.functions import text as tx
from quire.plans import batches as bt
from quire.plans import catalog_view as cv
from quire.plans import payloads as pl
from quire.session import cut, ensure_checkpoint_dir
from quire.sources import catalog, dims, landed, sinks
from quire.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def with_catalog(body: str, *extra: str) -> str:
    ctes = ",\n".join([cv.CATALOG_SQL.strip(), *extra])
    return f"WITH RECURSIVE {ctes}\n{body}"


# --------------------------------------------------------------------- A7/W4

@query("top_categories", with_catalog("""
SELECT category_id, count(*) AS n, min(ord) AS first_ord, arg_min(pos, ord) AS first_pos
FROM (SELECT ord, unnest(categories) AS category_id,
             unnest(range(len(categories))) AS pos FROM catalog)
GROUP BY category_id
ORDER BY n DESC, first_ord, first_pos
LIMIT 10"""))
def q_top_categories(spark, sf_dir):
    return analytics.top_categories(cv.catalog_view(spark, sf_dir), 10)


@query("category_counts", with_catalog("""
SELECT category_id, count(*) AS n
FROM (SELECT unnest(categories) AS category_id FROM catalog)
GROUP BY category_id"""))
def q_category_counts(spark, sf_dir):
    return analytics.category_counts(cv.catalog_view(spark, sf_dir)).select("category_id", "n")


# ------------------------------------------------------------------------ A6

@query("catalog_stats", with_catalog("""
SELECT count(*) AS total_entries,
       count(*) FILTER (WHERE reviewed) AS reviewed_count,
       (SELECT count(*) FROM taxonomy) AS category_count,
       count(DISTINCT type) AS type_count,
       CAST(min(year) AS VARCHAR) || '-' || CAST(max(year) AS VARCHAR) AS year_range
FROM catalog""", cv.taxonomy_sql()))
def q_catalog_stats(spark, sf_dir):
    return analytics.catalog_stats(cv.catalog_view(spark, sf_dir, reviewed=True), dims.taxonomy(spark))


# ------------------------------------------------------------------------ A8

@query("taxonomy_tree_counts", with_catalog("""
SELECT t.domain_id, t.category_id, CAST(sum(coalesce(c.n, 0)) AS BIGINT) AS n,
       min(t.domain_ord) AS domain_ord, min(t.category_ord) AS category_ord
FROM taxonomy t
LEFT JOIN (SELECT category_id, count(*) AS n
           FROM (SELECT unnest(categories) AS category_id FROM catalog) GROUP BY category_id) c
  ON c.category_id = t.category_id
GROUP BY ROLLUP (t.domain_id, t.category_id)""", cv.taxonomy_sql()))
def q_taxonomy_tree_counts(spark, sf_dir):
    return analytics.taxonomy_tree_counts(cv.catalog_view(spark, sf_dir), dims.taxonomy(spark))


# --------------------------------------------------------------------- W2/W3

@query("recent_top5", with_catalog("""
SELECT id, year, citation_count, ord FROM catalog
ORDER BY year DESC, coalesce(citation_count, 0) DESC, ord LIMIT 5"""))
def q_recent_top5(spark, sf_dir):
    return analytics.most_recent(cv.catalog_view(spark, sf_dir), 5).select(
        "id", "year", "citation_count", "ord")


@query("most_cited_top5", with_catalog("""
SELECT id, year, citation_count, ord FROM catalog WHERE citation_count > 0
ORDER BY citation_count DESC, ord LIMIT 5"""))
def q_most_cited_top5(spark, sf_dir):
    return analytics.most_cited(cv.catalog_view(spark, sf_dir), 5).select(
        "id", "year", "citation_count", "ord")


# ------------------------------------------------------------------- A9/J6/W6

@query("framework_coverage", with_catalog("""
SELECT f.framework_id, f.framework_ord, CAST(coalesce(x.n, 0) AS BIGINT) AS n_entries
FROM (SELECT DISTINCT framework_id, framework_ord FROM frameworks) f
LEFT JOIN (SELECT framework_id, count(DISTINCT ord) AS n FROM fw_links GROUP BY framework_id) x
  ON x.framework_id = f.framework_id""", cv.frameworks_sql()))
def q_framework_coverage(spark, sf_dir):
    return analytics.framework_coverage(cv.catalog_view(spark, sf_dir), dims.frameworks(spark))


@query("control_entries", with_catalog("""
SELECT f.framework_id, f.control_id, f.control_ord,
       CAST(coalesce(x.n, 0) AS BIGINT) AS n_entries,
       coalesce(x.top_ids, '') AS top_ids,
       CAST(greatest(coalesce(x.n, 0) - 5, 0) AS BIGINT) AS more
FROM frameworks f
LEFT JOIN (
  SELECT l.framework_id, l.control_id, count(*) AS n,
         string_agg(CASE WHEN l.rk <= 5 THEN c.id END, ',' ORDER BY l.ord) AS top_ids
  FROM (SELECT *, row_number() OVER (PARTITION BY framework_id, control_id ORDER BY ord) AS rk
        FROM fw_links) l
  JOIN catalog c ON c.ord = l.ord
  GROUP BY l.framework_id, l.control_id) x
  ON x.framework_id = f.framework_id AND x.control_id = f.control_id""", cv.frameworks_sql()))
def q_control_entries(spark, sf_dir):
    return analytics.control_entries(cv.catalog_view(spark, sf_dir), dims.frameworks(spark), 5)


# --------------------------------------------------------------------- P9/W5

@query("category_ranked", with_catalog("""
SELECT category_id, id, row_number() OVER (
         PARTITION BY category_id
         ORDER BY year DESC, coalesce(citation_count, 0) DESC, ord) AS rank
FROM (SELECT DISTINCT ord, id, year, citation_count, unnest(categories) AS category_id FROM catalog)"""))
def q_category_ranked(spark, sf_dir):
    return analytics.category_listing(cv.catalog_view(spark, sf_dir)).select("category_id", "id", "rank")


# ----------------------------------------------------------------- A13 / A14

@query("facet_values", with_catalog("""
SELECT 'year' AS facet, CAST(year AS VARCHAR) AS value, count(*) AS n, CAST(-year AS BIGINT) AS sort_key
FROM catalog GROUP BY year
UNION ALL
SELECT 'type', type, count(*), CAST(0 AS BIGINT) FROM catalog GROUP BY type"""))
def q_facet_values(spark, sf_dir):
    return analytics.facet_values(cv.catalog_view(spark, sf_dir))


# ------------------------------------------------------------------------ J5

@query("domain_occurrences", with_catalog("""
SELECT coalesce(t.domain_id, 'other') AS domain_id, count(*) AS n
FROM (SELECT unnest(categories) AS category_id FROM catalog) o
LEFT JOIN taxonomy t ON t.category_id = o.category_id
GROUP BY 1""", cv.taxonomy_sql()))
def q_domain_occurrences(spark, sf_dir):
    occ = analytics.category_domains(cv.catalog_view(spark, sf_dir), dims.taxonomy(spark))
    return occ.groupBy("domain_id").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------------ P8

@query("facet_filtered", with_catalog("""
SELECT id, year, type FROM catalog WHERE type = 'paper' AND reviewed = true"""))
def q_facet_filtered(spark, sf_dir):
    return analytics.facet_filter(cv.catalog_view(spark, sf_dir, reviewed=True), "paper", "all", "true").select(
        "id", "year", "type")


# ----------------------------------------------------------------------- P10

@query("lookup_by_id", with_catalog("""
SELECT id, title, year FROM catalog WHERE id = 'cat-2024-00008'"""))
def q_lookup_by_id(spark, sf_dir):
    return analytics.lookup(cv.catalog_view(spark, sf_dir), "cat-2024-00008", ord_=7).select("id", "title", "year")


@query("lookup_stored", with_catalog("""
SELECT id, ord, title, year FROM catalog WHERE id IN ('cat-2018-00002', 'cat-2024-00108', 'cat-2017-99999')"""))
def q_lookup_stored(spark, sf_dir):
    """P10 on a stored catalog, laid out by id."""
    path = _shared(spark, "catalog-by-id")
    sinks.write_by_id(cv.catalog_view(spark, sf_dir), path)
    stored = spark.read.parquet(path)
    hits = [analytics.lookup(stored, i) for i in ("cat-2018-00002", "cat-2024-00108", "cat-2017-99999")]
    return hits[0].unionByName(hits[1]).unionByName(hits[2]).select("id", "ord", "title", "year")


# ------------------------------------------------------- curate

def _curate_status(spark, sf_dir):
    return curate.curate(bt.candidates(spark, sf_dir), bt.catalog_part(spark, sf_dir),
                         bt.demo_rules(spark), bt.PARAMS)


@query("candidate_validity", with_catalog("""
SELECT rid, source, reject_reason, status0 AS status FROM cls2""", bt.CANDIDATES_SQL.strip()))
def q_candidate_validity(spark, sf_dir):
    c = curate.classify(bt.candidates(spark, sf_dir), bt.demo_rules(spark), bt.PARAMS)
    return c.select("rid", "source", "reject_reason", "status")


@query("curate_new_entries", with_catalog("""
SELECT printf('qc-%d-%05d', 2025, s.num) AS id, s.rid, s.source AS source_api,
       array_to_string(s.categories, ',') AS categories, s.year, nullif(s.month, 0) AS month,
       nullif(s.doi, '') AS doi, nullif(s.citation_count, 0) AS citation_count, s.open_access
FROM status s WHERE s.status = 'added'""", bt.CANDIDATES_SQL.strip()))
def q_curate_new_entries(spark, sf_dir):
    st = _curate_status(spark, sf_dir)
    e = curate.to_entries(st.filter(F.col("status") == "added"), bt.PARAMS)
    return e.select("id", "rid", "source_api", F.array_join("categories", ",").alias("categories"),
                    "year", "month", "doi", "citation_count", "open_access")


@query("curate_run_counters", with_catalog("""
SELECT source, source_ord, count(*) AS seen,
       count(*) FILTER (WHERE status = 'invalid') AS invalid,
       count(*) FILTER (WHERE status = 'off_topic') AS off_topic,
       count(*) FILTER (WHERE status = 'duplicate') AS duplicate,
       count(*) FILTER (WHERE status = 'added') AS added
FROM status GROUP BY source, source_ord""", bt.CANDIDATES_SQL.strip()))
def q_curate_run_counters(spark, sf_dir):
    return curate.run_counters(curate.statuses(bt.candidates(spark, sf_dir), bt.catalog_part(spark, sf_dir),
                                               bt.demo_rules(spark), bt.PARAMS))


@query("catalog_id_hits", with_catalog("""
SELECT rid FROM hitkeys""", bt.CANDIDATES_SQL.strip()))
def q_catalog_id_hits(spark, sf_dir):
    c = curate.classify(bt.candidates(spark, sf_dir), bt.demo_rules(spark), bt.PARAMS)
    # written before the filter: a filter on the status would tag every text again
    c = cut(c.select("rid", "status", "arxiv_id", "doi", "semantic_scholar_id"), "classified")
    elig = c.filter(F.col("status").isNull())
    return linkage.anti_by_keys(curate.candidate_keys(elig, True, False),
                                curate.catalog_keys(bt.catalog_part(spark, sf_dir)))


@query("next_id", with_catalog("""
SELECT coalesce(max(CASE WHEN regexp_extract(id, '-([0-9]{5})$', 1) <> ''
                    THEN CAST(regexp_extract(id, '-([0-9]{5})$', 1) AS INTEGER) END), 0) + 1 AS next_num,
       coalesce(bool_or(regexp_matches(id, '-[0-9]{6,}$')), false) AS overflow
FROM catalog"""))
def q_next_id(spark, sf_dir):
    return curate.next_id(cv.catalog_view(spark, sf_dir))


# ----------------------------------------------------------------- J2 / J3

_DOC_WORDS_SQL = f"""
dw AS (SELECT doc_id AS rid, {cv.words_sql(cv.normalize_sql('text'))} AS words FROM documents)"""


@query("similar_document_counts", f"""WITH {_DOC_WORDS_SQL.strip()},
pairs AS (
  SELECT a.rid AS l, b.rid AS r FROM dw a JOIN dw b ON a.rid < b.rid
  WHERE len(a.words) > 0 AND len(b.words) > 0
    AND least(len(a.words), len(b.words)) >= 0.85 * greatest(len(a.words), len(b.words))
    AND len(list_intersect(a.words, b.words)) / (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))) > 0.85),
ends AS (SELECT l AS rid FROM pairs UNION ALL SELECT r FROM pairs)
SELECT d.rid, count(e.rid) AS n_similar FROM dw d LEFT JOIN ends e ON e.rid = d.rid GROUP BY d.rid""")
def q_similar_document_counts(spark, sf_dir):
    docs = cv.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("rid"), F.col("text").alias("title"))
    sets = linkage.title_keys(docs).select("rid", "words")
    return linkage.similar_counts(sets, "0.85", True)


_PAGE_SQL = f"""
pt AS (SELECT page_id AS rid, {cv.normalize_sql("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS norm FROM pages),
pw AS (SELECT rid, norm, {cv.words_sql('norm')} AS words FROM pt),
conflicts AS (
  SELECT a.rid AS l, b.rid AS r FROM pw a JOIN pw b ON a.rid < b.rid
  WHERE a.norm = b.norm OR (len(a.words) > 0 AND len(b.words) > 0
    AND len(list_intersect(a.words, b.words)) / (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))) > 0.85)
),
ordered AS (
  SELECT p.rid, row_number() OVER (ORDER BY p.rid) AS i, coalesce(c.smaller, CAST([] AS BIGINT[])) AS smaller
  FROM pw p LEFT JOIN (SELECT r AS rid, list(l) AS smaller FROM conflicts GROUP BY r) c ON c.rid = p.rid
),
walk(i, kept) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT o.i, CASE WHEN list_has_any(o.smaller, w.kept) THEN w.kept ELSE list_append(w.kept, o.rid) END
  FROM walk w JOIN ordered o ON o.i = w.i + 1
)"""


@query("page_title_keep_first", f"""WITH RECURSIVE {_PAGE_SQL.strip()}
SELECT p.rid AS page_id, list_contains(w.kept, p.rid) AS kept
FROM pw p, (SELECT kept FROM walk WHERE i = (SELECT max(i) FROM ordered)) w""")
def q_page_title_keep_first(spark, sf_dir):
    pages = cv.read(spark, sf_dir, "pages").select(
        F.col("page_id").alias("rid"), F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))
    rows = linkage.title_keys(pages)
    keys = rows.select("rid", F.lit("title").alias("kind"), F.col("norm").alias("key"))
    return linkage.greedy_keep_first(rows.select("rid", "words"), keys).select(
        F.col("rid").alias("page_id"), "kept")



# ------------------------------------------------- ingest

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
_EVENT_HITS_SQL = """
hits AS (SELECT list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS query_ord,
                event_id AS pos, CAST(user_id AS VARCHAR) AS key FROM events)"""


def _event_hits(spark, sf_dir):
    e = cv.read(spark, sf_dir, "events")
    types = F.array(*[F.lit(t) for t in EVENT_TYPES])
    return e.select((F.array_position(types, F.col("event_type")) - 1).cast("int").alias("query_ord"),
                    F.col("event_id").alias("pos"), F.col("user_id").cast("string").alias("key"))


@query("ingest_keep_first", f"""WITH {_EVENT_HITS_SQL.strip()}
SELECT key, arg_min(pos, query_ord * 1000000000000 + pos) AS pos, min(query_ord) AS query_ord
FROM hits GROUP BY key""")
def q_ingest_keep_first(spark, sf_dir):
    return ingest.keep_first(_event_hits(spark, sf_dir), F.col("key")).select("key", "pos", "query_ord")


@query("ingest_hits_per_query", f"""WITH {_EVENT_HITS_SQL.strip()},
found AS (SELECT query_ord, count(*) AS found FROM hits GROUP BY query_ord),
firsts AS (SELECT q AS query_ord, count(*) AS new_unique FROM (SELECT key, min(query_ord) AS q FROM hits GROUP BY key) GROUP BY q)
SELECT f.query_ord, f.found, CAST(coalesce(n.new_unique, 0) AS BIGINT) AS new_unique,
       CAST(sum(coalesce(n.new_unique, 0)) OVER (ORDER BY f.query_ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS unique_total
FROM found f LEFT JOIN firsts n ON n.query_ord = f.query_ord""")
def q_ingest_hits_per_query(spark, sf_dir):
    return ingest.hits_per_query(_event_hits(spark, sf_dir), F.col("key"))


_ORDER_PUBS_SQL = """
pubs AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
                CAST(o_custkey % 7 AS BIGINT) AS citation_count FROM orders)"""
ORDERS_AS_OF = __import__("datetime").date(1998, 6, 30)


def _order_pubs(spark, sf_dir):
    o = cv.read(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_orderdate", F.year("o_orderdate").cast("int").alias("year"),
                    F.month("o_orderdate").cast("int").alias("month"),
                    (F.col("o_custkey") % 7).cast("bigint").alias("citation_count"))


@query("recent_by_month", f"""WITH {_ORDER_PUBS_SQL.strip()}
SELECT o_orderkey, year, month FROM pubs WHERE year > 1997 OR (year = 1997 AND month >= 6)""")
def q_recent_by_month(spark, sf_dir):
    return ingest.recent_by_month(_order_pubs(spark, sf_dir), ORDERS_AS_OF, 365, date_col="o_orderdate").select(
        "o_orderkey", "year", "month")


@query("recent_or_cited", f"""WITH {_ORDER_PUBS_SQL.strip()}
SELECT o_orderkey, year, month FROM pubs
WHERE year IS NOT NULL AND year <> 0 AND (year > 1998 OR (year = 1998 AND month >= 1) OR citation_count >= 3)""")
def q_recent_or_cited(spark, sf_dir):
    return ingest.recent_or_cited(_order_pubs(spark, sf_dir), ORDERS_AS_OF, 180, 3).select(
        "o_orderkey", "year", "month")


@query("year_floor", f"""WITH {_ORDER_PUBS_SQL.strip()}
SELECT o_orderkey, year FROM pubs WHERE year >= 1996""")
def q_year_floor(spark, sf_dir):
    return ingest.year_floor(_order_pubs(spark, sf_dir), 1996, date_col="o_orderdate").select("o_orderkey", "year")


_PAGE_FIELDS_SQL = f"""
pf AS (SELECT page_id, url, html, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS raw_title FROM pages)"""


def _page_fields(spark, sf_dir):
    p = cv.read(spark, sf_dir, "pages")
    return p.select("page_id", "url", "html", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("raw_title"))


@query("keep_first_fallback_key", f"""WITH {_PAGE_FIELDS_SQL.strip()},
k AS (SELECT page_id % 3 AS query_ord, page_id AS pos,
             coalesce(nullif(regexp_extract(url, '/([0-9]+)', 1), ''), lower(raw_title)) AS key FROM pf)
SELECT key, arg_min(pos, (query_ord, pos)) AS pos FROM k GROUP BY key""")
def q_keep_first_fallback_key(spark, sf_dir):
    p = _page_fields(spark, sf_dir).select(
        (F.col("page_id") % 3).alias("query_ord"), F.col("page_id").alias("pos"),
        F.regexp_extract("url", "/([0-9]+)", 1).alias("doi"), F.col("raw_title").alias("title"))
    return ingest.keep_first(p, ingest.crossref_key()).select(ingest.crossref_key().alias("key"), "pos")


@query("page_fields", f"""WITH {_PAGE_FIELDS_SQL.strip()}
SELECT page_id,
       {cv.COLLAPSE_SQL.replace('text', 'raw_title')} AS title,
       regexp_replace(substring(html, 1, 500), '<[^>]+>', '', 'g') AS abstract,
       regexp_replace(string_split(url, '/abs/')[-1], 'v[0-9]+$', '') AS ident,
       'https://arxiv.org/pdf/' || regexp_replace(string_split(url, '/abs/')[-1], 'v[0-9]+$', '') AS pdf_url
FROM pf""")
def q_page_fields(spark, sf_dir):
    p = _page_fields(spark, sf_dir)
    ident = tx.arxiv_id_from_url("url")
    return p.select("page_id", tx.collapse_ws("raw_title").alias("title"),
                    tx.strip_markup_after_truncate("html").alias("abstract"),
                    ident.alias("ident"), F.concat(F.lit("https://arxiv.org/pdf/"), ident).alias("pdf_url"))



# ------------------------------------------------------ DOI backfill

def _backfill(spark, sf_dir):
    cat = cv.catalog_view(spark, sf_dir)
    meta = cat.select(F.col("ord").alias("pos"), F.lit(0).alias("query_ord"),
                      F.col("external_ids.arxiv_id").alias("arxiv_id"),
                      F.when(F.col("ord") % 4 == 0, F.concat(F.lit("10.7777/"), F.col("ord").cast("string")))
                      .otherwise(F.lit("")).alias("doi")).filter(F.col("arxiv_id").isNotNull())
    meta = ingest.keep_first(meta, F.col("arxiv_id")).select("arxiv_id", "doi")
    lookup = cat.select(F.col("ord").alias("rank"), "title", "year", "doi")
    return enrich.backfill(cat, meta, lookup)


_BACKFILL_SQL = f"""
need AS (SELECT * FROM catalog WHERE type IN ('paper', 'book') AND nullif(doi, '') IS NULL AND nullif(ext_doi, '') IS NULL),
meta AS (
  SELECT arxiv_id, arg_min(doi, ord) AS doi FROM (
    SELECT ord, arxiv_id, CASE WHEN ord % 4 = 0 THEN '10.7777/' || CAST(ord AS VARCHAR) ELSE '' END AS doi
    FROM catalog WHERE arxiv_id IS NOT NULL) GROUP BY arxiv_id),
stage_a AS (SELECT n.ord, nullif(trim(m.doi), '') AS doi_a FROM need n JOIN meta m ON m.arxiv_id = n.arxiv_id
            WHERE nullif(trim(m.doi), '') IS NOT NULL),
rest AS (SELECT * FROM need WHERE ord NOT IN (SELECT ord FROM stage_a)),
rw AS (SELECT ord, year, {cv.words_sql(cv.normalize_sql('title'))} AS words FROM rest),
lw AS (SELECT ord AS rank, year, doi, {cv.words_sql(cv.normalize_sql('title'))} AS words FROM catalog WHERE nullif(doi, '') IS NOT NULL),
stage_c AS (
  SELECT r.ord, arg_min(l.doi, l.rank) AS doi_c FROM rw r, lw l
  WHERE len(r.words) > 0 AND len(l.words) > 0
    AND len(list_intersect(r.words, l.words)) / (len(r.words) + len(l.words) - len(list_intersect(r.words, l.words))) >= 0.85
    AND (r.year IS NULL OR l.year IS NULL OR abs(r.year - l.year) <= 1)
  GROUP BY r.ord),
result AS (
  SELECT n.ord, n.id, coalesce(a.doi_a, c.doi_c) AS new_doi,
         CASE WHEN a.doi_a IS NOT NULL THEN 'arxiv' WHEN c.doi_c IS NOT NULL THEN 'crossref' END AS doi_source
  FROM need n LEFT JOIN stage_a a ON a.ord = n.ord LEFT JOIN stage_c c ON c.ord = n.ord)"""


@query("doi_backfill", with_catalog("SELECT ord, id, new_doi, doi_source FROM result", _BACKFILL_SQL.strip()))
def q_doi_backfill(spark, sf_dir):
    return _backfill(spark, sf_dir).select("ord", "id", "new_doi", "doi_source")


@query("doi_backfill_counters", with_catalog(
    "SELECT coalesce(doi_source, 'none') AS doi_source, count(*) AS n FROM result GROUP BY 1",
    _BACKFILL_SQL.strip()))
def q_doi_backfill_counters(spark, sf_dir):
    return enrich.backfill_counters(_backfill(spark, sf_dir))



# ---------------------------------------------------- quality

ENTRY_FIELDS = ["id", "type", "title", "authors", "year", "month", "venue", "abstract", "url", "doi",
                "pdf_url", "categories", "framework_mappings", "tags", "added_date", "added_by",
                "source_api", "external_ids", "citation_count", "open_access", "reviewed"]


def catalog_json(spark, sf_dir):
    """The catalog view as raw JSON records, with seeded faults of every rule
    kind (by ``ord``): an empty title, an unknown key, a year written as
    2019.0 (still an integer) or as true, a number as type, a fractional year
    below the first one, month 13, a misspelt id, a negative fractional count,
    an unknown external id, authors that are no strings, no url."""
    c = cv.catalog_view(spark, sf_dir, reviewed=True)
    o, r = F.col("ord"), F.col("ord") % 40
    own = {"title": F.when(o % 110 == 0, F.lit("")).otherwise(F.col("title")),
           "month": F.when(r == 3, F.lit(13)).otherwise(F.col("month")),
           "id": F.when(r == 4, F.concat(F.lit("x"), F.col("id"))).otherwise(F.col("id")),
           "citation_count": F.when(r != 5, F.col("citation_count")),
           "url": F.when(r != 8, F.col("url"))}
    j = F.to_json(F.struct(*[own.get(f, F.col(f)).alias(f) for f in ENTRY_FIELDS],
                           F.when(o % 90 == 0, F.lit(1)).alias("extra")))
    ids = F.regexp_replace(F.regexp_replace(j, r'"external_ids":\{', r'"external_ids":{"isbn":"1",'), ',}', '}')
    j = (F.when(o % 70 == 0, F.regexp_replace(j, ',"year":([0-9]+)', ',"year":true'))
         .when(o % 50 == 0, F.regexp_replace(j, ',"year":([0-9]+)', ',"year":$1.0'))
         .when(r == 1, F.regexp_replace(j, ',"type":"[a-z]+"', ',"type":5'))
         .when(r == 2, F.regexp_replace(j, ',"year":([0-9]+)', ',"year":2016.5'))
         .when(r == 5, F.regexp_replace(j, ',"open_access":', ',"citation_count":-1.5,"open_access":'))
         .when(r == 6, ids)
         .when(r == 7, F.regexp_replace(j, r',"authors":\[[^\]]*\]', ',"authors":["A",2,false]')).otherwise(j))
    return c.select("ord", "id", "categories", j.alias("raw"))


_SCHEMA_VIOLATIONS_SQL = """
faults AS (SELECT *, ord % 40 AS r FROM catalog),
violations AS (
  SELECT ord, 'reviewed' AS path, 'required' AS rule, CAST(NULL AS VARCHAR) AS value FROM faults WHERE reviewed IS NULL
  UNION ALL SELECT ord, 'categories', 'minItems', '[]' FROM faults WHERE len(categories) = 0
  UNION ALL SELECT ord, 'year', 'type', 'true' FROM faults WHERE ord % 70 = 0
  UNION ALL SELECT ord, '', 'additionalProperties', 'extra' FROM faults WHERE ord % 90 = 0
  UNION ALL SELECT ord, 'title', 'minLength', '""' FROM faults WHERE ord % 110 = 0
  UNION ALL SELECT ord, 'type', unnest(['type', 'enum']), '5' FROM faults WHERE r = 1
  UNION ALL SELECT ord, 'year', unnest(['type', 'minimum']), '2016.5' FROM faults WHERE r = 2
  UNION ALL SELECT ord, 'month', 'maximum', '13' FROM faults WHERE r = 3
  UNION ALL SELECT ord, 'id', 'pattern', '"' || CASE WHEN r = 4 THEN 'x' ELSE '' END || id || '"' FROM faults
            WHERE r = 4 OR ord >= 99999
  UNION ALL SELECT ord, 'citation_count', unnest(['type', 'minimum']), '-1.5' FROM faults WHERE r = 5
  UNION ALL SELECT ord, 'external_ids', 'additionalProperties', 'isbn' FROM faults WHERE r = 6
  UNION ALL SELECT ord, 'authors.1', 'type', '2' FROM faults WHERE r = 7
  UNION ALL SELECT ord, 'authors.2', 'type', 'false' FROM faults WHERE r = 7
  UNION ALL SELECT ord, 'url', 'required', NULL FROM faults WHERE r = 8),
unknown AS (
  SELECT o.ord, o.category_id FROM (SELECT ord, unnest(categories) AS category_id FROM catalog) o
  WHERE o.category_id NOT IN (SELECT category_id FROM taxonomy))"""


@query("schema_violations", with_catalog("SELECT ord, path, rule, value FROM violations",
                                         cv.taxonomy_sql(), _SCHEMA_VIOLATIONS_SQL.strip()))
def q_schema_violations(spark, sf_dir):
    return quality.validate_json(catalog_json(spark, sf_dir), "ord", "raw", quality.entry_schema("cat"))


@query("unknown_categories", with_catalog("SELECT ord, category_id FROM unknown",
                                          cv.taxonomy_sql(), _SCHEMA_VIOLATIONS_SQL.strip()))
def q_unknown_categories(spark, sf_dir):
    return quality.unknown_categories(cv.catalog_view(spark, sf_dir), dims.taxonomy(spark)).select(
        "ord", "category_id")


_PAGE_IDS_SQL = "pid AS (SELECT 'page-' || regexp_extract(url, '/([0-9]+)', 1) AS id FROM pages)"


@query("duplicate_ids", f"""WITH {_PAGE_IDS_SQL}
SELECT id, count(*) AS n FROM pid GROUP BY id HAVING count(*) > 1""")
def q_duplicate_ids(spark, sf_dir):
    ids = cv.read(spark, sf_dir, "pages").select(
        F.concat(F.lit("page-"), F.regexp_extract("url", "/([0-9]+)", 1)).alias("id"))
    return quality.duplicate_ids(ids)


@query("quality_verdict", with_catalog("""
SELECT * , errors = 0 AS passed FROM (
  SELECT 1 AS check_ord, 'schema' AS "check", count(*) AS errors FROM violations
  UNION ALL SELECT 2, 'duplicate_ids', count(*) FROM (SELECT id FROM catalog GROUP BY id HAVING count(*) > 1)
  UNION ALL SELECT 3, 'unknown_categories', count(*) FROM unknown
  UNION ALL SELECT 0, 'passed', CAST((SELECT count(*) FROM violations) > 0 AS BIGINT)
       + CAST((SELECT count(*) FROM (SELECT id FROM catalog GROUP BY id HAVING count(*) > 1)) > 0 AS BIGINT)
       + CAST((SELECT count(*) FROM unknown) > 0 AS BIGINT))""",
                                        cv.taxonomy_sql(), _SCHEMA_VIOLATIONS_SQL.strip()))
def q_quality_verdict(spark, sf_dir):
    cj = catalog_json(spark, sf_dir)
    cat = cv.catalog_view(spark, sf_dir)
    return quality.verdict(quality.validate_json(cj, "ord", "raw", quality.entry_schema("cat")),
                           quality.duplicate_ids(cat), quality.unknown_categories(cat, dims.taxonomy(spark)))



# ------------------------------------------------------- search

SEARCH_QUERY = "Apache licence Roe"


def _search_sql(q: str) -> str:
    terms = search.query_terms(q)
    posts = " UNION ALL ".join(
        f"SELECT ord, '{f}' AS field, unnest({cv.words_sql(cv.normalize_sql(src))}) AS term FROM catalog"
        for f, src in [("title", "coalesce(title, '')"), ("abstract", "coalesce(abstract, '')"),
                       ("authors", "coalesce(array_to_string(authors, ' '), '')"),
                       ("categories", "coalesce(array_to_string(categories, ' '), '')"),
                       ("tags", "coalesce(array_to_string(tags, ' '), '')"),
                       ("venue", "coalesce(venue, '')")])
    weights = ", ".join(f"('{f}', {w})" for f, w in search.fixed.SEARCH_WEIGHTS)
    nq = len(terms)
    return f"""
qt AS (SELECT unnest({cv._sql_list(terms)}) AS q),
posts AS ({posts}),
vocab AS (SELECT DISTINCT term FROM posts),
m AS (SELECT * FROM (SELECT term, q, CASE WHEN contains(term, q) THEN 0.0
                     ELSE least(1.0, levenshtein(q, term) / CAST(length(q) AS DOUBLE)) END AS d FROM vocab, qt) WHERE d < 1),
best AS (SELECT ord, field, q, min(d) AS d FROM posts JOIN m USING (term) GROUP BY ord, field, q),
pf AS (SELECT ord, field, (sum(d) + {nq}.0 - count(*)) / {nq}.0 AS d_f FROM best GROUP BY ord, field),
w(field, wt) AS (VALUES {weights}),
hits AS (SELECT ord, round(sum(w.wt * (1.0 - d_f)), 6) AS score FROM pf JOIN w USING (field)
         WHERE d_f <= {search.fixed.SEARCH_THRESHOLD} GROUP BY ord)"""


@query("search_hits", with_catalog("SELECT ord, score FROM hits", _search_sql(SEARCH_QUERY).strip()))
def q_search_hits(spark, sf_dir):
    return search.search(cv.catalog_view(spark, sf_dir), SEARCH_QUERY)


@query("search_index_hits", with_catalog("SELECT ord, score FROM hits", _search_sql(SEARCH_QUERY).strip()))
def q_search_index_hits(spark, sf_dir):
    path = f"{ensure_checkpoint_dir(spark)}/search-index-{uuid.uuid4().hex}"
    return search.search_index(search.write_index(cv.catalog_view(spark, sf_dir), path), SEARCH_QUERY)


@query("search_page", with_catalog("""
SELECT h.ord, h.score, (SELECT count(*) FROM hits) AS total
FROM hits h ORDER BY h.score DESC, h.ord LIMIT 50""", _search_sql(SEARCH_QUERY).strip()))
def q_search_page(spark, sf_dir):
    page, total = search.search_or_browse(cv.catalog_view(spark, sf_dir), SEARCH_QUERY)
    return page.select("ord", "score", total.select("total").scalar().alias("total"))


@query("browse_page", with_catalog("""
SELECT ord, (SELECT count(*) FROM catalog WHERE type = 'paper') AS total FROM catalog WHERE type = 'paper'
ORDER BY year DESC, coalesce(citation_count, 0) DESC, ord LIMIT 50"""))
def q_browse_page(spark, sf_dir):
    page, total = search.search_or_browse(cv.catalog_view(spark, sf_dir), " a ", type_="paper")
    return page.select("ord", total.select("total").scalar().alias("total"))



# ------------------------------------------------------------- export

@query("bibtex", with_catalog("""
SELECT ord, concat_ws(chr(10),
  '@article{' || replace(id, '-', '') || ',',
  '  title = {' || title || '},',
  '  author = {' || array_to_string(authors, ' and ') || '},',
  '  year = {' || CAST(year AS VARCHAR) || '},',
  CASE WHEN coalesce(venue, '') <> '' THEN '  journal = {' || venue || '},' END,
  CASE WHEN coalesce(doi, '') <> '' THEN '  doi = {' || doi || '},' END,
  CASE WHEN coalesce(url, '') <> '' THEN '  url = {' || url || '},' END,
  '}') AS bibtex
FROM catalog"""))
def q_bibtex(spark, sf_dir):
    c = cv.catalog_view(spark, sf_dir)
    return c.select("ord", export.bibtex(c).alias("bibtex"))


@query("entry_cards", with_catalog("""
SELECT c.ord, c.id, c.type,
       CAST(c.year AS VARCHAR) || CASE WHEN c.month IS NOT NULL AND c.month <> 0
                                       THEN '-' || lpad(CAST(c.month AS VARCHAR), 2, '0') ELSE '' END AS published,
       array_to_string(c.authors[1:3], ', ')
         || CASE WHEN len(c.authors) > 3 THEN ' + ' || CAST(len(c.authors) - 3 AS VARCHAR) || ' more' ELSE '' END
         AS authors_short,
       array_to_string(list_transform(c.categories[1:4], lambda x: replace(x, '-', ' ')), ', ') AS category_labels,
       CASE WHEN c.citation_count > 0 THEN CAST(c.citation_count AS VARCHAR) || ' citations' END AS citations,
       coalesce(nullif(c.added_by, ''), 'manual') AS added_by,
       coalesce(nullif(c.source_api, ''), 'manual') AS source,
       concat_ws(';', 'arxiv_id=' || nullif(c.arxiv_id, ''), 'semantic_scholar_id=' || nullif(c.semantic_scholar_id, ''),
                 'doi=' || nullif(c.ext_doi, '')) AS external_ids,
       coalesce(f.badges, '') AS frameworks,
       f.badges IS NOT NULL AS show_mappings
FROM catalog c
LEFT JOIN (SELECT ord, string_agg(framework_id || ':' || control_id, ',' ORDER BY framework_ord, control_pos) AS badges
           FROM fw_links GROUP BY ord) f ON f.ord = c.ord"""))
def q_entry_cards(spark, sf_dir):
    return export.cards(cv.catalog_view(spark, sf_dir))


@query("change_summary", with_catalog("""
SELECT printf('qc-%d-%05d', 2025, num) AS id, title, url, array_to_string(categories, ', ') AS categories
FROM status WHERE status = 'added'""", bt.CANDIDATES_SQL.strip()))
def q_change_summary(spark, sf_dir):
    st = _curate_status(spark, sf_dir)
    return curate.change_summary(curate.to_entries(st.filter(F.col("status") == "added"), bt.PARAMS))



# V1 on JSON text from the given tables: event properties against a declared
# rule set (closed object, required integer k in [0, 90]).
PROPS_SCHEMA = quality.Prop("", "object", closed=True, required=["k"],
                            props=[quality.Prop("k", "integer", minimum=0, maximum=90)])


@query("props_violations", """
SELECT event_id AS ord, path, rule FROM (
  SELECT event_id, '' AS path, 'parse' AS rule FROM events WHERE props IS NULL OR NOT json_valid(props)
  UNION ALL
  SELECT event_id, 'k', 'required' FROM events
  WHERE json_valid(props) AND json_type(props) = 'OBJECT' AND json_extract(props, '$.k') IS NULL
  UNION ALL
  SELECT event_id, '', 'additionalProperties' FROM events
  WHERE json_valid(props) AND json_type(props) = 'OBJECT' AND len(list_filter(json_keys(props), lambda x: x <> 'k')) > 0
  UNION ALL
  SELECT event_id, 'k', 'type' FROM events
  WHERE json_valid(props) AND json_type(props, '$.k') NOT IN ('BIGINT', 'UBIGINT', 'NULL')
    AND NOT (json_type(props, '$.k') = 'DOUBLE' AND CAST(json_extract(props, '$.k') AS DOUBLE)
             = floor(CAST(json_extract(props, '$.k') AS DOUBLE)))
  UNION ALL
  SELECT event_id, 'k', 'maximum' FROM events
  WHERE json_valid(props) AND json_type(props, '$.k') IN ('BIGINT', 'UBIGINT', 'DOUBLE')
    AND CAST(json_extract(props, '$.k') AS DOUBLE) > 90
  UNION ALL
  SELECT event_id, 'k', 'minimum' FROM events
  WHERE json_valid(props) AND json_type(props, '$.k') IN ('BIGINT', 'UBIGINT', 'DOUBLE')
    AND CAST(json_extract(props, '$.k') AS DOUBLE) < 0)""")
def q_props_violations(spark, sf_dir):
    ev = cv.read(spark, sf_dir, "events").select("event_id", "props")
    return quality.validate_json(ev, "event_id", "props", PROPS_SCHEMA).drop("value")


# ---------------------------- landed payloads

_LANDED_COLUMNS = ["query_ord", "pos", "title", "array_to_string(authors, '|') AS authors", "year", "month", "abstract",
                   "url", "pdf_url", "doi", "arxiv_id", "semantic_scholar_id", "citation_count", "open_access", "venue"]


def _landed_sql(cte: str) -> str:
    return f"WITH {pl.PAYLOADS_SQL.strip()}\nSELECT {', '.join(_LANDED_COLUMNS)} FROM {cte}"


def _landed(parsed):
    return parsed.withColumn("authors", F.array_join("authors", "|")).drop("arxiv_categories")


@query("landed_arxiv", _landed_sql("pa"))
def q_landed_arxiv(spark, sf_dir):
    return _landed(landed.parse_arxiv_atom(pl.arxiv(spark, sf_dir)))


@query("landed_semantic_scholar", _landed_sql("ps"))
def q_landed_semantic_scholar(spark, sf_dir):
    return _landed(landed.parse_semantic_scholar(pl.semantic_scholar(spark, sf_dir)))


@query("landed_crossref", _landed_sql("pc"))
def q_landed_crossref(spark, sf_dir):
    return _landed(landed.parse_crossref(pl.crossref(spark, sf_dir)))


@query("landed_candidates", f"""WITH {pl.PAYLOADS_SQL.strip()},
{pl.LANDED_SQL.strip()}
SELECT source, source_ord, pos, title, year, month, url, doi FROM cand""")
def q_landed_candidates(spark, sf_dir):
    c = landed.ingest_payloads(pl.all_sources(spark, sf_dir), bt.AS_OF)
    return c.select("source", "source_ord", "pos", "title", "year", "month", "url", "doi")


@query("landed_curate", with_catalog("""
SELECT printf('qc-%d-%05d', 2025, s.num) AS id, s.rid, s.source AS source_api, s.url,
       array_to_string(s.categories, ',') AS categories, s.year, nullif(s.doi, '') AS doi
FROM status s WHERE s.status = 'added'""", pl.PAYLOADS_SQL.strip(), pl.LANDED_SQL.strip(), bt.CURATE_SQL.strip()))
def q_landed_curate(spark, sf_dir):
    cands = landed.ingest_payloads(pl.all_sources(spark, sf_dir), bt.AS_OF)
    st = curate.curate(cands, bt.catalog_part(spark, sf_dir), bt.demo_rules(spark), bt.PARAMS)
    e = curate.to_entries(st.filter(F.col("status") == "added"), bt.PARAMS)
    return e.select("id", "rid", "source_api", "url", F.array_join("categories", ",").alias("categories"), "year", "doi")


@query("doi_by_title_results", with_catalog("""
SELECT ord, CASE WHEN ord % 3 <> 0 AND ord % 4 <= 1 THEN '10.8888/a' || CAST(ord AS VARCHAR)
                 ELSE '10.8888/b' || CAST(ord AS VARCHAR) END AS doi_c
FROM (SELECT *, len(WORDS) AS n FROM catalog)
WHERE n > 0 AND (ord % 3 <> 0 AND ord % 4 <= 1 OR ord % 5 <= 1 OR ord % 3 <= 1)""".replace(
    "WORDS", cv.words_sql(cv.normalize_sql("title")))))
def q_doi_by_title_results(spark, sf_dir):
    entries = cv.catalog_view(spark, sf_dir)
    return enrich.doi_by_title_results(entries, landed.parse_crossref_lookup(pl.title_searches(spark, sf_dir, entries)))


# ------------------------- sinks, read back through the shared folder (K1-K3, S4, U2), V3

def _shared(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("candidate_files", f"""WITH {pl.PAYLOADS_SQL.strip()},
{pl.LANDED_SQL.strip()}
SELECT source, source_ord, pos, title, abstract, url, doi FROM cand""")
def q_candidate_files(spark, sf_dir):
    root = _shared(spark, "candidates")
    sinks.write_candidates(landed.ingest_payloads(pl.all_sources(spark, sf_dir), bt.AS_OF), root)
    back = landed.read_candidate_files(spark, {s: f"{root}/file={s}" for s in [*bt.SOURCES, "not-landed"]})
    return back.select("source", "source_ord", "pos", "title", "abstract", "url", "doi")


@query("catalog_parts", with_catalog("""
SELECT ord, id, title FROM cat
UNION ALL
SELECT (SELECT max(ord) + 1 FROM cat) + num - (SELECT min(num) FROM status), printf('qc-%d-%05d', 2025, num), title
FROM status WHERE status = 'added'""", bt.CANDIDATES_SQL.strip()))
def q_catalog_parts(spark, sf_dir):
    base, part = _shared(spark, "catalog"), _shared(spark, "catalog-part")
    bt.catalog_part(spark, sf_dir).write.parquet(base)
    held = sinks.read_parts(spark, base, [])
    st = curate.curate(bt.candidates(spark, sf_dir), held, bt.demo_rules(spark), bt.PARAMS)
    added = sinks.merge_append(held, curate.to_entries(st.filter(F.col("status") == "added"), bt.PARAMS), part)
    return sinks.read_parts(spark, base, [part] if added else []).select("ord", "id", "title")


@query("incremental_catalog", with_catalog("""
SELECT ord, id, title FROM now_1
UNION ALL
SELECT (SELECT max(ord) + 1 FROM now_1) + row_number() OVER (ORDER BY num) - 1, printf('qc-%d-%05d', 2025, num), title
FROM status_1 WHERE status_1 = 'added'""", bt.INCREMENTAL_SQL))
def q_incremental_catalog(spark, sf_dir):
    """The landed batch in two landings, each taken in by the stream."""
    base, root, files, marks = (_shared(spark, n) for n in ("catalog", "store", "landed", "stream"))
    bt.catalog_part(spark, sf_dir).write.parquet(base)
    for day in (0, 1):
        sinks.write_candidates(bt.candidates(spark, sf_dir).filter(bt.landing(day)), f"{files}/day{day}")
        incremental.run(spark, files, root, base, marks, bt.demo_rules(spark), bt.PARAMS)
    return incremental.catalog_now(spark, root, base).select("ord", "id", "title")


@query("catalog_lines", with_catalog("""
SELECT ord, id, title, len(authors) AS n_authors, array_to_string(categories, ',') AS categories, doi, arxiv_id
FROM catalog"""))
def q_catalog_lines(spark, sf_dir):
    """The catalog written as JSON Lines and read back."""
    path = _shared(spark, "catalog-lines")
    catalog.write_catalog_lines(cv.catalog_view(spark, sf_dir), path)
    return catalog.read_catalog_lines(spark, path).select(
        "ord", "id", "title", F.size("authors").cast("bigint").alias("n_authors"),
        F.array_join("categories", ",").alias("categories"), "doi", F.col("external_ids.arxiv_id").alias("arxiv_id"))


@query("doi_updates", with_catalog("""
SELECT c.ord, coalesce(r.new_doi, c.doi) AS doi, coalesce(r.new_doi, c.ext_doi) AS ext_doi, c.arxiv_id
FROM catalog c LEFT JOIN result r ON r.ord = c.ord""", _BACKFILL_SQL.strip()))
def q_doi_updates(spark, sf_dir):
    path = _shared(spark, "doi-updates")
    cat = cv.catalog_view(spark, sf_dir).select("ord", "id", "doi", "external_ids")
    n = sinks.write_doi_delta(_backfill(spark, sf_dir), path)
    out = sinks.with_doi_updates(cat, [spark.read.parquet(path)] if n else [])
    return out.select("ord", "doi", F.col("external_ids.doi").alias("ext_doi"),
                      F.col("external_ids.arxiv_id").alias("arxiv_id"))


@query("violation_order", with_catalog("""
SELECT row_number() OVER (ORDER BY ord, list_transform(string_split(path, '.'), lambda step: {'place':
           CASE WHEN regexp_full_match(step, '[0-9]{1,18}') THEN step::BIGINT ELSE -1 END, 'name': step}), rule) AS place,
       ord, path, rule FROM violations""",
                                       cv.taxonomy_sql(), _SCHEMA_VIOLATIONS_SQL.strip()))
def q_violation_order(spark, sf_dir):
    v = quality.validate_json(catalog_json(spark, sf_dir), "ord", "raw", quality.entry_schema("cat"))
    return quality.report_places(v).select("place", "ord", "path", "rule")


FLAGSHIP = "curate_new_entries"
