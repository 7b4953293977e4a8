"""Landed API payloads derived from ``documents``: every row is a record of
one source's search results (by ``doc_id % 3``), 20 records a payload, and
rows with ``doc_id % 7 = 0`` are found by the next query again. Texts are
whole; ids, dates and gaps are functions of the row. ``PAYLOADS_SQL`` has
the same records as DuckDB rows, after parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans import catalog_view as cv

PER_QUERY = 60      # doc_ids of all three sources a payload spans


def _hits(spark: SparkSession, sf_dir: str, source_ord: int) -> DataFrame:
    d = F.col("doc_id")
    q = F.floor(d / PER_QUERY).cast("int")
    queries = F.when(d % 7 == 0, F.array(q, q + 1)).otherwise(F.array(q))
    return (cv.read(spark, sf_dir, "documents").filter(d % 3 == source_ord)
            .select("doc_id", "text", "source", F.explode(queries).alias("query_ord")))


def _payload(hits: DataFrame, record: Column) -> DataFrame:
    """``(query_ord, records)``, the records of a query in doc_id order."""
    rows = hits.groupBy("query_ord").agg(F.array_sort(F.collect_list(F.struct("doc_id", record.alias("r")))).alias("a"))
    return rows.select("query_ord", F.transform("a", lambda x: x["r"]).alias("records"))


def _opt(cond: Column, value) -> Column:
    return F.when(cond, value if isinstance(value, Column) else F.lit(value))


def _str(c: Column) -> Column:
    return c.cast("string")


def _two(c: Column) -> Column:
    return F.lpad(_str(c), 2, "0")


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def arxiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    ident = F.concat(F.lit("2402."), F.lpad(_str(d % 900), 5, "0"))
    full = F.concat(ident, F.lit("v"), _str(d % 3 + 1))
    entry = F.concat(
        F.lit("<entry><id> http://arxiv.org/abs/"), full, F.lit("\n</id><published>"), _str(d % 4 + 2023), F.lit("-"),
        _two(d % 12 + 1), F.lit("-05T00:00:00Z</published><title>"), _xml(F.col("text")),
        F.lit("</title><summary>"), _xml(F.col("text")), F.lit("</summary><author><name>Author "), F.col("source"),
        F.lit('</name></author><author><name>B. Coe</name></author><link href="http://arxiv.org/abs/x" rel="alternate"/>'),
        F.when(d % 2 == 0, F.concat(F.lit('<link title="pdf" href="http://arxiv.org/pdf/'), full,
                                    F.lit('" rel="related"/>'))).otherwise(F.lit("")),
        F.lit('<category term="cs.CR"/>'),
        F.when(d % 5 == 0, F.concat(F.lit("<arxiv:doi> 10.5555/doc"), _str(d % 250), F.lit(" </arxiv:doi>")))
        .otherwise(F.lit("")), F.lit("</entry>"))
    p = _payload(_hits(spark, sf_dir, 0), entry)
    return p.select("query_ord", F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">'),
        F.array_join("records", ""), F.lit("</feed>")).alias("value"))


def semantic_scholar(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    rec = F.struct(
        _opt(d % 4 != 0, F.concat(F.lit("s2-"), _str(d % 800))).alias("paperId"),
        F.when(d % 17 == 0, F.lit("")).otherwise(F.col("text")).alias("title"),
        _opt(d % 8 != 0, F.col("text")).alias("abstract"),
        _opt(d % 19 != 0, F.concat(F.lit("https://s2.example.org/"), _str(d))).alias("url"),
        F.concat(F.lit("Proc. "), F.col("source")).alias("venue"),
        _opt(d % 10 != 0, F.concat(_str(d % 4 + 2023), F.lit("-"), _two(d % 12 + 1), F.lit("-01"))).alias("publicationDate"),
        _opt(d % 13 != 0, (d % 4 + 2023).cast("int")).alias("year"),
        _opt(d % 11 != 0, F.array(*[F.struct(n.alias("name")) for n in (
            F.concat(F.lit("Author "), F.col("source")), F.lit(""), F.lit(None).cast("string"))])).alias("authors"),
        _opt(d % 9 != 0, F.struct(
            _opt(d % 6 == 1, F.concat(F.lit("2401."), F.lpad(_str(d % 700), 5, "0"))).alias("ArXiv"),
            _opt(d % 5 == 1, F.concat(F.lit("10.5555/DOC"), _str(d % 250))).alias("DOI"))).alias("externalIds"),
        (d % 7).alias("citationCount"), (d % 2 == 0).alias("isOpenAccess"))
    return _payload(_hits(spark, sf_dir, 1), rec).select(
        "query_ord", F.to_json(F.struct(F.col("records").alias("data"))).alias("value"))


def crossref(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    years = F.array(F.array((d % 5 + 2022).cast("int"), (d % 12 + 1).cast("int")))
    none = F.array().cast("array<array<int>>")
    online = F.when(d % 12 == 5, none).when(d % 6 != 2, years)
    rec = F.struct(
        _opt(d % 4 != 1, F.concat(F.lit("10.5555/doc"), _str(d % 250))).alias("DOI"),
        F.when(d % 17 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("text"))).alias("title"),
        _opt(d % 11 != 0, F.array(F.struct(F.lit("A.").alias("given"), F.col("source").alias("family")),
                                  F.struct(F.lit(None).cast("string").alias("given"), F.lit("Boe").alias("family")),
                                  F.struct(F.lit(" ").alias("given"), F.lit("").alias("family")))).alias("author"),
        F.when(online.isNotNull(), F.struct(online.alias("date-parts"))).alias("published-online"),
        F.struct(F.array(F.array(F.lit(2023))).alias("date-parts")).alias("published-print"),
        _opt(d % 19 != 0, F.concat(F.lit("https://cr.example.org/"), _str(d))).alias("URL"),
        F.concat(F.lit("<jats:p>"), F.col("text"), F.lit("</jats:p>")).alias("abstract"),
        (d % 7).alias("is-referenced-by-count"))
    return _payload(_hits(spark, sf_dir, 2), rec).select(
        "query_ord", F.to_json(F.struct(F.struct(F.col("records").alias("items")).alias("message"))).alias("value"))


def all_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"arxiv": arxiv(spark, sf_dir), "semantic-scholar": semantic_scholar(spark, sf_dir),
            "crossref": crossref(spark, sf_dir)}


def title_searches(spark: SparkSession, sf_dir: str, entries: DataFrame) -> DataFrame:
    """Title-search payloads ``(ord, value)``: per catalog entry a result
    without title, its own title without DOI or a year apart, its own title
    with a DOI and an empty or near date."""
    o, y = F.col("ord"), F.col("year")

    def result(title, doi, parts):
        return F.struct(title.alias("title"), doi.alias("DOI"), F.struct(parts.alias("date-parts")).alias("issued"))

    none = F.array().cast("array<array<int>>")
    items = F.array(
        result(F.array().cast("array<string>"), F.lit("10.8888/none"), F.array(F.array(y))),
        result(F.array(F.concat(F.lit("! "), F.col("title"))), F.when(o % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("10.8888/a"), _str(o))),
               F.array(F.array((y + o % 4).cast("int")))),
        result(F.array(F.col("title")), F.concat(F.lit("10.8888/b"), _str(o)),
               F.when(o % 5 == 0, none).when(o % 5 == 1, F.array(F.array().cast("array<int>")))
               .otherwise(F.array(F.array((y - o % 3).cast("int"))))))
    return entries.select("ord", F.to_json(F.struct(F.struct(items.alias("items")).alias("message"))).alias("value"))


# ------------------------------------------------------------- DuckDB twin

def _collapse(x: str) -> str:
    return cv.COLLAPSE_SQL.replace("text", x)


PAYLOADS_SQL = f"""
dd AS (
  SELECT doc_id AS d, text, source, CAST(doc_id // {PER_QUERY} AS INTEGER) AS query_ord FROM documents
  UNION ALL
  SELECT doc_id, text, source, CAST(doc_id // {PER_QUERY} + 1 AS INTEGER) FROM documents WHERE doc_id % 7 = 0),
dq AS (SELECT *, row_number() OVER (PARTITION BY d % 3, query_ord ORDER BY d) - 1 AS pos FROM dd),
pa AS (
  SELECT query_ord, pos, {_collapse("text")} AS title, ['Author ' || source, 'B. Coe'] AS authors,
         CAST(2023 + d % 4 AS INTEGER) AS year, CAST(d % 12 + 1 AS INTEGER) AS month,
         substring({_collapse("text")}, 1, 500) AS abstract,
         'https://arxiv.org/abs/2402.' || lpad(CAST(d % 900 AS VARCHAR), 5, '0') AS url,
         CASE WHEN d % 2 = 0 THEN 'http://arxiv.org/pdf/2402.' || lpad(CAST(d % 900 AS VARCHAR), 5, '0') || 'v' || CAST(d % 3 + 1 AS VARCHAR)
              ELSE 'https://arxiv.org/pdf/2402.' || lpad(CAST(d % 900 AS VARCHAR), 5, '0') END AS pdf_url,
         CASE WHEN d % 5 = 0 THEN '10.5555/doc' || CAST(d % 250 AS VARCHAR) ELSE '' END AS doi,
         '2402.' || lpad(CAST(d % 900 AS VARCHAR), 5, '0') AS arxiv_id,
         CAST(NULL AS VARCHAR) AS semantic_scholar_id, CAST(NULL AS BIGINT) AS citation_count,
         CAST(NULL AS BOOLEAN) AS open_access, CAST(NULL AS VARCHAR) AS venue
  FROM dq WHERE d % 3 = 0),
ps AS (
  SELECT query_ord, pos, text AS title,
         CASE WHEN d % 11 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['Author ' || source] END AS authors,
         CASE WHEN d % 13 = 0 THEN 0 ELSE CAST(2023 + d % 4 AS INTEGER) END AS year,
         CASE WHEN d % 10 = 0 THEN 0 ELSE CAST(d % 12 + 1 AS INTEGER) END AS month,
         CASE WHEN d % 8 = 0 THEN '' ELSE substring(text, 1, 500) END AS abstract,
         CASE WHEN d % 19 = 0 THEN '' ELSE 'https://s2.example.org/' || CAST(d AS VARCHAR) END AS url,
         CAST(NULL AS VARCHAR) AS pdf_url,
         CASE WHEN d % 9 <> 0 AND d % 5 = 1 THEN '10.5555/DOC' || CAST(d % 250 AS VARCHAR) ELSE '' END AS doi,
         CASE WHEN d % 9 <> 0 AND d % 6 = 1 THEN '2401.' || lpad(CAST(d % 700 AS VARCHAR), 5, '0') ELSE '' END AS arxiv_id,
         CASE WHEN d % 4 = 0 THEN '' ELSE 's2-' || CAST(d % 800 AS VARCHAR) END AS semantic_scholar_id,
         CAST(d % 7 AS BIGINT) AS citation_count, d % 2 = 0 AS open_access, 'Proc. ' || source AS venue
  FROM dq WHERE d % 3 = 1 AND d % 17 <> 0 AND text <> ''),
pc AS (
  SELECT query_ord, pos, text AS title,
         CASE WHEN d % 11 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['A. ' || source, 'Boe'] END AS authors,
         CASE WHEN d % 12 = 5 THEN 0 WHEN d % 6 = 2 THEN 2023 ELSE CAST(2022 + d % 5 AS INTEGER) END AS year,
         CASE WHEN d % 12 = 5 OR d % 6 = 2 THEN 0 ELSE CAST(d % 12 + 1 AS INTEGER) END AS month,
         regexp_replace(substring('<jats:p>' || text || '</jats:p>', 1, 500), '<[^>]+>', '', 'g') AS abstract,
         CASE WHEN d % 19 = 0 THEN 'https://doi.org/' || CASE WHEN d % 4 = 1 THEN '' ELSE '10.5555/doc' || CAST(d % 250 AS VARCHAR) END
              ELSE 'https://cr.example.org/' || CAST(d AS VARCHAR) END AS url,
         CAST(NULL AS VARCHAR) AS pdf_url,
         CASE WHEN d % 4 = 1 THEN '' ELSE '10.5555/doc' || CAST(d % 250 AS VARCHAR) END AS doi,
         CAST(NULL AS VARCHAR) AS arxiv_id, CAST(NULL AS VARCHAR) AS semantic_scholar_id,
         CAST(d % 7 AS BIGINT) AS citation_count, CAST(NULL AS BOOLEAN) AS open_access, '' AS venue
  FROM dq WHERE d % 3 = 2 AND d % 17 <> 0 AND text <> '')"""

# after keep-first, recency and numbering (as of 2025-06-30)
LANDED_SQL = """
ka AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arxiv_id ORDER BY query_ord, pos) AS k FROM pa)
       WHERE k = 1 AND (year > 2024 OR year = 2024 AND month >= 6)),
ks AS (SELECT * FROM (SELECT *, row_number() OVER (
           PARTITION BY coalesce(nullif(semantic_scholar_id, ''), nullif(doi, ''), lower(title))
           ORDER BY query_ord, pos) AS k FROM ps)
       WHERE k = 1 AND year <> 0 AND (year > 2025 OR year = 2025 AND month >= 1 OR citation_count >= 3)),
kc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(doi, ''), lower(title))
                                                   ORDER BY query_ord, pos) AS k FROM pc)
       WHERE k = 1 AND year >= 2023),
cand0 AS (
  SELECT 'arxiv' AS source, 0 AS source_ord, * FROM ka UNION ALL SELECT 'semantic-scholar', 1, * FROM ks
  UNION ALL SELECT 'crossref', 2, * FROM kc),
cand AS (
  SELECT * EXCLUDE (query_ord, pos, k), row_number() OVER (PARTITION BY source_ord ORDER BY query_ord, pos) - 1 AS pos,
         row_number() OVER (ORDER BY source_ord, query_ord, pos) AS rid
  FROM cand0)"""
