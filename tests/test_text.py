"""Column expressions: normalisation, Jaccard, tagging, projections."""

from pyspark.sql import functions as F

from quire.functions import tagging, text


def one(spark, expr, *values, schema="a string"):
    df = spark.createDataFrame([values], schema)
    return df.select(expr.alias("x")).first()["x"]


def test_normalize_keeps_letters_digits_and_single_blanks(spark):
    cases = {"GPT-4's (Second) Report?": "gpt4s second report", "\ta\u00a0\u00a0b \n c ": "a b c", "?!": ""}
    for raw, want in cases.items():
        assert one(spark, text.normalize_title("a"), raw) == want


def test_normalize_keeps_trailing_blank_after_dropping(spark):
    assert one(spark, text.normalize_title("a"), "Hello !") == "hello "


def test_normalize_unicode_blanks(spark):
    for ch in [" ", " ", "\x1c", "\x85"]:
        assert one(spark, text.normalize_title("a"), f"{ch}Deep{ch}{ch}Nets{ch}") == "deep nets"


def test_normalize_non_latin_title_becomes_empty(spark):
    assert one(spark, text.normalize_title("a"), "Über Straße") == "ber strae"
    assert one(spark, text.normalize_title("a"), "深度学习") == ""


def sim(spark, a, b):
    return one(spark, text.title_similarity("a", "b"), a, b, schema="a string, b string")


def test_similarity_is_shared_words_over_all_words(spark):
    cases = [("one two three", "THREE, two: one", 1.0), ("red green", "blue black", 0.0),
             ("red green blue", "green blue black", 0.5), ("", "red", 0.0), ("??", "??", 0.0),
             ("red red red", "red", 1.0)]
    for a, b, want in cases:
        assert sim(spark, a, b) == want


def tags(spark, s):
    rules = tagging.rules_frame(spark)
    df = spark.createDataFrame([(s,)], "t string")
    return tagging.tag(df, rules, F.lower(F.col("t"))).first()["categories"]


def test_tagging_lists_each_matching_category_once_in_rule_order(spark):
    assert tags(spark, "we watermark outputs; watermarking resists a jailbreak") == ["jailbreaking", "watermarking"]
    assert tags(spark, "tides and moons") == []
    assert tags(spark, "jailbroken, jailbreak, jailbreaks") == ["jailbreaking"]


def test_tagging_keyword_may_span_title_abstract_joint(spark):
    df = spark.createDataFrame([("Red", "team exercises")], "title string, abstract string")
    out = tagging.tag(df, tagging.rules_frame(spark), tagging.tag_source_text("title", "abstract"))
    assert out.first()["categories"] == ["red-teaming"]


def test_truncation_happens_before_tag_strip(spark):
    s = "x" * 495 + "<jats:p>tail</jats:p>"
    out = one(spark, text.strip_markup_after_truncate("a"), s)
    assert out == "x" * 495 + "<jats"


def test_arxiv_id_from_url(spark):
    assert one(spark, text.arxiv_id_from_url("a"), "http://arxiv.org/abs/2401.12345v3") == "2401.12345"


def test_authors_short_and_labels(spark):
    df = spark.createDataFrame([(["A", "B", "C", "D", "E"], ["prompt-injection", "a-b", "c", "d", "e"], 2024, 3)],
                               "authors array<string>, cats array<string>, year int, month int")
    r = df.select(text.authors_short("authors").alias("s"), text.category_labels("cats").alias("l"),
                  text.year_month("year", "month").alias("ym")).first()
    assert r["s"] == "A, B, C + 2 more"
    assert r["l"] == ["prompt injection", "a b", "c", "d"]
    assert r["ym"] == "2024-03"


def test_a_category_split_over_the_rule_table_is_listed_once_at_any_size(spark):
    rules = [("a", ["foo"]), ("b", ["bar"]), ("a", ["baz"])]
    many = rules + [(f"c{i}", [f"never{i}x{j}" for j in range(10)]) for i in range(40)]
    df = spark.createDataFrame([("foo bar baz",), ("baz",), (None,)], "t string")
    for r in (rules, many):
        got = [x["categories"] for x in tagging.tag(df, tagging.rules_frame(spark, r), F.lower("t")).collect()]
        assert got[:2] == [["a", "b"], ["a"]]
