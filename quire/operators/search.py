"""Weighted multi-field fuzzy search (Q1), search-or-browse (Q2), result
page (W7).

The upstream site runs an in-browser fuzzy index; here the same fields,
weights and 0.35 cut-off drive a Spark plan:

* per query term q and word t of a field: ``d = 0`` if t contains q, else
  ``least(1, levenshtein(q, t) / len(q))``; query terms are a handful of
  literals, so this is an expression over a word, never a join of rows;
* per (entry, field, q) the best d; per field ``d_f = mean over q`` (1 for a
  q without a match); a field hits when ``d_f <= 0.35``; score = sum of
  ``w_f * (1 - d_f)`` over hit fields.

``search`` scans the catalog once and shuffles nothing but hits. For many
searches of one catalog, ``write_index`` stores its postings ``(term, ord,
field)`` sorted by term, and ``search_index`` works from them: distances on
the distinct terms only, then the postings of the matching ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import fixed
from quire.functions import text
from quire.operators.analytics import catalog_order_cols
from quire.session import cut

def query_terms(q: str, min_chars: int = fixed.SEARCH_MIN_MATCH_CHARS) -> list[str]:
    """Distinct words of the normalised query (driver side: it is one
    string), in first-seen order, at least ``min_chars`` long."""
    import re

    ws = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
          + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")
    n = q.lower().strip(ws)
    n = re.sub(f"[^a-z0-9{re.escape(ws)}]", "", n)
    out: list[str] = []
    for w in re.split(f"[{re.escape(ws)}]+", n):
        if len(w) >= min_chars and w not in out:
            out.append(w)
    return out


def field_text(c: Column, is_array: bool) -> Column:
    return F.array_join(c, " ") if is_array else c


def field_words(df: DataFrame, fields=None) -> DataFrame:
    """(ord, field, terms): the distinct normalised words of every field."""
    fields = fields or [(f, f in ("authors", "categories", "tags")) for f, _ in fixed.SEARCH_WEIGHTS]
    parts = [F.struct(F.lit(f).alias("field"),
                      text.word_set(F.coalesce(field_text(F.col(f), arr), F.lit(""))).alias("terms"))
             for f, arr in fields]
    return df.select("ord", F.explode(F.array(*parts)).alias("p")).select("ord", "p.field", "p.terms")


def distance(term: Column, q: str) -> Column:
    """0 for a term that contains ``q``, else the relative edit distance, 1
    at most (the edit distance stops counting at the length of ``q``)."""
    lev = F.levenshtein(term, F.lit(q), len(q) - 1)
    return (F.when(term.contains(F.lit(q)), F.lit(0.0)).when(lev < 0, F.lit(1.0))
            .otherwise(lev.cast("double") / F.lit(float(len(q)))))


def _scores(per_field: DataFrame, weights, threshold: float) -> DataFrame:
    """(ord, score) from (ord, field, d_f)."""
    w = F.create_map(*[x for f, wt in weights for x in (F.lit(f), F.lit(float(wt)))])
    return per_field.filter(F.col("d_f") <= threshold).groupBy("ord").agg(
        F.round(F.sum(w[F.col("field")] * (F.lit(1.0) - F.col("d_f"))), 6).alias("score"))


def search(df: DataFrame, q: str, weights=fixed.SEARCH_WEIGHTS, threshold: float = fixed.SEARCH_THRESHOLD) -> DataFrame:
    """Q1: ``(ord, score)`` for every entry with at least one field hit."""
    terms = query_terms(q)
    if not terms:
        return df.sparkSession.createDataFrame([], "ord bigint, score double")

    def nearest(q: str) -> Column:
        return F.coalesce(F.array_min(F.transform("terms", lambda t: distance(t, q))), F.lit(1.0))

    best = [nearest(q) for q in terms]
    d_f = sum(best[1:], best[0]) / F.lit(float(len(terms)))
    return _scores(field_words(df).select("ord", "field", d_f.alias("d_f")), weights, threshold)


def write_index(df: DataFrame, path: str) -> DataFrame:
    """The catalog's postings ``(term, ord, field)``, sorted by term so that
    a search reads the files' parts that hold its terms."""
    # written once: range bounds come from sampling, which would split every text again
    posts = cut(field_words(df), "field-words").select("ord", "field", F.explode("terms").alias("term"))
    posts.repartitionByRange("term").sortWithinPartitions("term").write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def search_index(posts: DataFrame, q: str, weights=fixed.SEARCH_WEIGHTS,
                 threshold: float = fixed.SEARCH_THRESHOLD) -> DataFrame:
    """Q1 over stored postings; the same rows as ``search``."""
    terms = query_terms(q)
    if not terms:
        return posts.sparkSession.createDataFrame([], "ord bigint, score double")
    near = F.array(*[F.struct(F.lit(q).alias("q"), distance(F.col("term"), q).alias("d")) for q in terms])
    # the matching terms: a subset of the vocabulary; AQE broadcasts it when its measured size is small
    matches = (posts.select("term").distinct().select("term", F.explode(near).alias("m"))
               .select("term", "m.q", "m.d").filter(F.col("d") < 1.0))
    best = posts.join(matches, "term").groupBy("ord", "field", "q").agg(F.min("d").alias("d"))
    n = F.lit(float(len(terms)))
    per_field = best.groupBy("ord", "field").agg(((F.sum("d") + n - F.count(F.lit(1))) / n).alias("d_f"))
    return _scores(per_field, weights, threshold)


def search_or_browse(df: DataFrame, q: str, type_: str = "all", year="all", reviewed="all",
                     k: int = 50) -> tuple[DataFrame, DataFrame]:
    """Q2 + P8 + W7: a trimmed query shorter than 2 characters browses in
    catalog order (W1), otherwise the untrimmed query is searched (score
    desc, then file order). Facets are applied after ranking. Returns the
    first ``k`` rows and the total count."""
    from quire.operators.analytics import facet_filter

    if len(q.strip()) < 2:
        ranked = df.withColumn("score", F.lit(None).cast("double"))
        order = catalog_order_cols()
    else:
        # the hit list (ord, score) is small: materialise it once for the page
        # and the total instead of searching twice
        ranked = df.join(cut(search(df, q), "hits"), "ord")
        order = [F.col("score").desc(), F.col("ord").asc()]
    ranked = facet_filter(ranked, type_, year, reviewed)
    return ranked.orderBy(*order).limit(k), ranked.agg(F.count(F.lit(1)).alias("total"))
