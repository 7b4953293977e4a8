"""Multi-label keyword tagging.

A rule table ``(category_id, category_ord, keyword)`` is a parameter. A
category is tagged when any of its keywords is a plain substring of the
lower-cased ``title + " " + abstract`` (no word boundaries, so a keyword may
span the joint). The result lists categories in rule order, each once.

A small rule table (133 rows by default, up to ``COMPILED``) becomes one
``array(when(contains OR ...))`` expression: no shuffle, no Python, whole-stage
codegen. A larger one is joined (``tag_by_anchors``), with the same answers:
each keyword is filed under the one of its four-letter pieces that is rarest
in the texts, a text's pieces find the keywords filed under them, and what is
found is looked for in the text. The work then grows with the texts and the
keywords found, not with texts times keywords.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import fixed
from quire.session import cut

COMPILED = 1_000
PIECE = 4


def rules_frame(spark: SparkSession, rules=None) -> DataFrame:
    """Rule dim from ``[(category_id, [keywords...]), ...]`` (default: the
    fixed default rules)."""
    rules = fixed.DEFAULT_RULES if rules is None else rules
    rows = [(cat, i, kw) for i, (cat, kws) in enumerate(rules) for kw in kws]
    df = spark.createDataFrame(rows, "category_id string, category_ord int, keyword string")
    # known here already: no job has to read them back
    df._quire_rules = [(cat, list(kws)) for cat, kws in rules if kws] if len(rows) <= COMPILED else None
    return df


def _ordered_rules(rules_df: DataFrame):
    """The rules as a list, or null where there are too many to compile."""
    if rules_df.count() > COMPILED:
        return None
    rows = rules_df.orderBy("category_ord", "category_id").collect()
    grouped: list[tuple[str, list[str]]] = []
    for r in rows:
        if grouped and grouped[-1][0] == r["category_id"]:
            grouped[-1][1].append(r["keyword"])
        else:
            grouped.append((r["category_id"], [r["keyword"]]))
    return grouped


def tag_text_expr(text: Column, grouped_rules) -> Column:
    """Compile ``[(category, [keywords])]`` into one array expression over an
    already lower-cased text column."""
    if not grouped_rules:
        return F.array().cast("array<string>")
    hits = []
    for cat, kws in grouped_rules:
        cond = None
        for kw in kws:
            c = text.contains(F.lit(kw.lower()))
            cond = c if cond is None else (cond | c)
        hits.append(F.when(cond, F.lit(cat)))
    # distinct hits without the nulls, in one generated loop (a higher-order
    # function would be interpreted, the text's preparation included, per keyword)
    return F.array_except(F.array(*hits), F.array(F.lit(None).cast("string")))


def tag_source_text(title, abstract) -> Column:
    """The tagged text: ``lower(title + " " + abstract)``, missing parts empty."""
    t = F.col(title) if isinstance(title, str) else title
    a = F.col(abstract) if isinstance(abstract, str) else abstract
    return F.lower(F.concat(F.coalesce(t, F.lit("")), F.lit(" "), F.coalesce(a, F.lit(""))))


def tag(df: DataFrame, rules_df: DataFrame, text: Column, out: str = "categories") -> DataFrame:
    """Add ``out`` = categories hit by ``text`` (already lower-cased)."""
    grouped = getattr(rules_df, "_quire_rules", None)   # the dim is read once per frame
    if grouped is None:
        grouped = rules_df._quire_rules = _ordered_rules(rules_df)
    if grouped is None:
        return tag_by_anchors(df, rules_df, text, out)
    return df.withColumn(out, tag_text_expr(text, grouped))


def _pieces(text: Column, length: int) -> Column:
    """All pieces of this length: an empty match at every place, in one pass."""
    return F.regexp_extract_all(text, F.lit("(?s)(?=(.{%d}))" % length), F.lit(1))


def tag_by_anchors(df: DataFrame, rules_df: DataFrame, text: Column, out: str = "categories") -> DataFrame:
    """``tag`` for rule tables of any size. ``df`` is written once, so that
    its row numbers are the same for both sides of the join."""
    from quire.operators import linkage

    rules = rules_df.select("category_ord", "category_id", F.lower("keyword").alias("keyword")).distinct()
    # a keyword shorter than a piece is a piece itself; the empty one is in every text
    lengths = sorted(r[0] for r in rules.select(F.least(F.length("keyword"), F.lit(PIECE)).alias("n")).distinct().collect())
    x = cut(df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_text", text), "texts")
    pieces = F.array_distinct(F.concat(*[_pieces(F.col("_text"), n) for n in lengths if n], F.array(F.lit(""))))
    mine = cut(x.select("_row", pieces.alias("words")), "pieces")
    table = linkage.word_table(mine)
    of_rule = F.when(F.length("keyword") <= PIECE, F.array("keyword")).otherwise(_pieces(F.col("keyword"), PIECE))
    rarest = F.array_min(F.transform(of_rule, lambda w: F.struct(
        F.substr(F.lit(bytearray(table)), (linkage.slot(w, len(table)) + 1).cast("int"), F.lit(1)).alias("f"), w.alias("piece"))))
    filed = rules.select("*", rarest["piece"].alias("piece"))
    found = (mine.select("_row", F.explode("words").alias("piece")).join(filed, "piece")
             .groupBy("_row").agg(F.collect_set(F.struct("category_ord", "category_id", "keyword")).alias("_found")))
    hits = F.sort_array(F.filter("_found", lambda r: F.contains(F.col("_text"), r["keyword"])))
    names = F.array_distinct(F.transform(hits, lambda r: r["category_id"]))
    return (x.join(found, "_row", "left")
            .withColumn(out, F.coalesce(names, F.array().cast("array<string>"))).drop("_row", "_text", "_found"))
