"""A catalog derived from the driver's ``documents`` and ``labels`` tables.

The upstream catalog file is not available, so the registered queries run on
a catalog view that Spark derives from the given tables; its size grows with
them. Every field is a deterministic function of a document row (whole
texts, all rows), and the same definition is written twice: as DataFrame
code here and as DuckDB SQL in ``CATALOG_SQL`` for the oracle.

Rows with a ``labels`` row are the curated, already-reviewed catalog; the
rest are newly landed candidates (see ``quire.plans.batches``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import fixed
from quire.functions import tagging, text
from quire.session import spread

# Rules for the driver tables. The default (fixed) rule set never hits the
# invented prose of the test tables, so the registered queries tag with
# these keywords, which do occur in it. "legal-notice" is deliberately not a
# taxonomy category, to exercise the unknown-category check.
DEMO_RULES = [
    ("risk-frameworks", ["mit license", "apache license", "general public license"]),
    ("data-anonymization", ["@mail", "example.com"]),
    ("benchmarks", ["tion"]),
    ("survey", ["the "]),
    ("responsible-ai", [" und ", " der "]),
    ("watermarking", [" les ", " des "]),
    ("guardrails", [" los ", " las "]),
    ("model-governance", ["ment"]),
    ("access-control", ["token"]),
    ("legal-notice", ["license"]),
]

AUTHOR_POOL = ["J. Doe", "A. Roe", "K. Poe"]


TEXT_TABLES = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in TEXT_TABLES:
        # whole-text regex work is CPU-heavy: never leave it to one task
        df = spread(df, None, TEXT_TABLES[name])
    return df


def catalog_view(spark: SparkSession, sf_dir: str, rules=None, reviewed: bool = False) -> DataFrame:
    """One catalog entry per document, in ``doc_id`` order (``ord``).
    ``reviewed`` joins ``labels``; without it that column is left out (an
    outer join is planned even where nothing reads it)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    if reviewed:
        labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
        docs = docs.join(labels, "doc_id", "left")
    d = F.col("doc_id")
    year = (F.lit(2017) + d % 10).cast("int")
    title = text.collapse_ws("text")
    types = F.array(*[F.lit(t) for t in fixed.ENTRY_TYPES])
    apis = F.array(*[F.lit(t) for t in ["arxiv", "semantic-scholar", "crossref", "manual"]])
    doi = F.when(d % 3 == 0, F.concat(
        F.lit("10.5555/"), F.when(d % 500 < 250, F.lit("DOC")).otherwise(F.lit("doc")),
        (d % 250).cast("string")))
    base = docs.select(
        d.alias("ord"),
        F.format_string("cat-%d-%05d", year, d + 1).alias("id"),
        F.element_at(types, (d % 8 + 1).cast("int")).alias("type"),
        title.alias("title"),
        F.slice(F.array(F.concat(F.lit("Author "), F.col("source")),
                        F.concat(F.lit("Writer "), F.col("lang")),
                        *[F.lit(a) for a in AUTHOR_POOL]), 1, (d % 5 + 1).cast("int")).alias("authors"),
        year.alias("year"),
        F.nullif(d % 13, F.lit(0)).cast("int").alias("month"),
        F.when(d % 4 != 0, F.concat(F.lit("Proc. "), F.col("source"))).alias("venue"),
        text.truncate(title).alias("abstract"),
        F.concat(F.lit("https://docs.example.org/"), d.cast("string")).alias("url"),
        F.when(d % 6 != 3, doi).alias("doi"),
        F.lit(None).cast("string").alias("pdf_url"),
        F.array(F.col("lang")).alias("tags"),
        F.date_add(F.lit("2025-01-01").cast("date"), (d % 365).cast("int")).alias("added_date"),
        F.when(d % 2 == 0, F.lit("automation")).alias("added_by"),
        F.element_at(apis, (d % 4 + 1).cast("int")).alias("source_api"),
        F.struct(
            F.when(d % 5 == 0, F.concat(F.lit("2401."), F.lpad((d % 700).cast("string"), 5, "0")))
            .alias("arxiv_id"),
            F.when(d % 7 == 0, F.concat(F.lit("s2-"), (d % 300).cast("string"))).alias("semantic_scholar_id"),
            doi.alias("doi")).alias("external_ids"),
        F.nullif(F.col("n_chars") % 97, F.lit(0)).cast("bigint").alias("citation_count"),
        (F.col("n_chars") % 2 == 0).alias("open_access"),
        *([(F.col("quality") == 1).alias("reviewed")] if reviewed else []),
        framework_mappings(d).alias("framework_mappings"),
    )
    rules_df = tagging.rules_frame(spark, DEMO_RULES if rules is None else rules)
    return tagging.tag(base, rules_df, tagging.tag_source_text("title", "abstract"), "categories")


def framework_mappings(d: Column) -> Column:
    """Each framework lists the controls whose position i has
    ``(doc_id + i) % 7 == framework_ord``; lists may be empty."""
    def keep(fo):
        return lambda x, i: (d + i) % 7 == fo

    kv = []
    for f_ord, (fid, _n, _v, _u, controls) in enumerate(fixed.FRAMEWORKS):
        arr = F.array(*[F.lit(c) for c in controls])
        kv += [F.lit(fid), F.filter(arr, keep(f_ord))]
    return F.create_map(*kv)


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_list(items) -> str:
    return "[" + ", ".join(_sql_str(x) for x in items) + "]"


def tag_sql(text_sql: str, rules=None) -> str:
    """DuckDB twin of ``tagging.tag_text_expr``."""
    rules = DEMO_RULES if rules is None else rules
    cases = []
    for cat, kws in rules:
        cond = " OR ".join(f"contains({text_sql}, {_sql_str(k.lower())})" for k in kws)
        cases.append(f"CASE WHEN {cond} THEN {_sql_str(cat)} END")
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


def _mapping_rows_sql() -> str:
    rows = []
    for f_ord, (fid, _n, _v, _u, controls) in enumerate(fixed.FRAMEWORKS):
        for i, c in enumerate(controls):
            rows.append(f"({_sql_str(fid)}, {f_ord}, {_sql_str(c)}, {i})")
    return ", ".join(rows)


WS = text.WS
COLLAPSE_SQL = (f"regexp_replace(regexp_replace(text, '^[{WS}]+|[{WS}]+$', '', 'g'), "
                f"'[{WS}]+', ' ', 'g')")
NORMALIZE_SQL = ("regexp_replace(regexp_replace(regexp_replace(lower({x}), '^[{ws}]+|[{ws}]+$', '', 'g'), "
                 "'[^a-z0-9{ws}]', '', 'g'), '[{ws}]+', ' ', 'g')")


def normalize_sql(x: str) -> str:
    return NORMALIZE_SQL.replace("{x}", x).replace("{ws}", WS)


def words_sql(norm: str) -> str:
    return f"list_distinct(list_filter(string_split({norm}, ' '), lambda w: w <> ''))"


def _types_sql() -> str:
    return _sql_list(fixed.ENTRY_TYPES)


# Base rows of the catalog view in DuckDB; ``categories`` is a LIST.
CATALOG_SQL = f"""
catalog AS (
  SELECT *, {tag_sql("lower(title || ' ' || abstract)")} AS categories
  FROM (
    SELECT d.doc_id AS ord,
           printf('cat-%d-%05d', CAST(2017 + d.doc_id % 10 AS INTEGER), d.doc_id + 1) AS id,
           ({_types_sql()})[d.doc_id % 8 + 1] AS type,
           t.title AS title,
           (['Author ' || d.source, 'Writer ' || d.lang, {', '.join(_sql_str(a) for a in AUTHOR_POOL)}])[1:(d.doc_id % 5 + 1)] AS authors,
           CAST(2017 + d.doc_id % 10 AS INTEGER) AS year,
           CAST(nullif(d.doc_id % 13, 0) AS INTEGER) AS month,
           CASE WHEN d.doc_id % 4 <> 0 THEN 'Proc. ' || d.source END AS venue,
           substring(t.title, 1, 500) AS abstract,
           'https://docs.example.org/' || CAST(d.doc_id AS VARCHAR) AS url,
           CASE WHEN d.doc_id % 6 <> 3 THEN t.doi END AS doi,
           [d.lang] AS tags,
           CAST(DATE '2025-01-01' + CAST(d.doc_id % 365 AS INTEGER) AS DATE) AS added_date,
           CASE WHEN d.doc_id % 2 = 0 THEN 'automation' END AS added_by,
           (['arxiv', 'semantic-scholar', 'crossref', 'manual'])[d.doc_id % 4 + 1] AS source_api,
           CASE WHEN d.doc_id % 5 = 0 THEN '2401.' || lpad(CAST(d.doc_id % 700 AS VARCHAR), 5, '0') END AS arxiv_id,
           CASE WHEN d.doc_id % 7 = 0 THEN 's2-' || CAST(d.doc_id % 300 AS VARCHAR) END AS semantic_scholar_id,
           t.doi AS ext_doi,
           CAST(nullif(d.n_chars % 97, 0) AS BIGINT) AS citation_count,
           (d.n_chars % 2 = 0) AS open_access,
           (l.quality = 1) AS reviewed
    FROM documents d
    LEFT JOIN labels l ON l.doc_id = d.doc_id
    CROSS JOIN LATERAL (SELECT {COLLAPSE_SQL.replace('text', 'd.text')} AS title,
        CASE WHEN d.doc_id % 3 = 0 THEN '10.5555/' || CASE WHEN d.doc_id % 500 < 250 THEN 'DOC' ELSE 'doc' END
             || CAST(d.doc_id % 250 AS VARCHAR) END AS doi) t
  )
),
fw_controls(framework_id, framework_ord, control_id, control_pos) AS (VALUES {_mapping_rows_sql()}),
fw_links AS (
  SELECT c.ord, f.framework_id, f.framework_ord, f.control_id, f.control_pos
  FROM catalog c JOIN fw_controls f ON (c.ord + f.control_pos) % 7 = f.framework_ord
)"""


def taxonomy_sql() -> str:
    rows, k = [], 0
    for d_ord, (did, dlabel, cats) in enumerate(fixed.TAXONOMY):
        for cid, clabel in cats:
            rows.append(f"({_sql_str(did)}, {d_ord}, {_sql_str(cid)}, {k})")
            k += 1
    return ("taxonomy(domain_id, domain_ord, category_id, category_ord) AS (VALUES "
            + ", ".join(rows) + ")")


def frameworks_sql() -> str:
    rows, k = [], 0
    for f_ord, (fid, _n, _v, _u, controls) in enumerate(fixed.FRAMEWORKS):
        for c in controls:
            rows.append(f"({_sql_str(fid)}, {f_ord}, {_sql_str(c)}, {k})")
            k += 1
    return ("frameworks(framework_id, framework_ord, control_id, control_ord) AS (VALUES "
            + ", ".join(rows) + ")")
