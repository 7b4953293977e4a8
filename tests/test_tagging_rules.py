"""Keyword rules of any number, compiled or joined."""

import random

from pyspark.sql import functions as F

from quire.functions import tagging


def plain(text, rules):
    return list(dict.fromkeys(c for _, c, k in sorted(rules) if k.lower() in text))


def test_hundred_thousand_keywords(spark):
    rng = random.Random(4)

    def word(n):
        return "".join(rng.choice("abcdefghijklmnop é日𝒳-") for _ in range(n))

    rules = [(i % 700, f"c{i % 700:03}", word(rng.randrange(3, 12))) for i in range(100_000)]
    rules += [(701, "short", "q"), (702, "two", "zq"), (703, "Upper", "ZEBRA"), (3, "c003", rules[3][2])]
    texts = [word(rng.randrange(0, 400)) for _ in range(40)] + ["", "a zebra", "zq", "𝒳" * 9, rules[5][2] + rules[9][2]]
    texts.append("".join(rng.choice(rules)[2] for _ in range(300)))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")],
                               "id long, t string, words string")
    frame = spark.createDataFrame(rules, "category_ord int, category_id string, keyword string")
    got = tagging.tag(df, frame, F.lower("t"), "tags")
    assert got.columns == ["id", "t", "words", "tags"]
    rows = got.collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert r.tags == plain(r.t.lower(), rules), r.t
    assert sum(map(len, (r.tags for r in rows))) > 100


def test_joined_and_compiled_rules_agree(spark):
    rules = [("b", ["ab", "x y", ""][:2]), ("a", ["", "zz"]), ("c", ["abcdef", "cdefg"])]
    df = spark.createDataFrame([(t,) for t in ["", "ab", "x  y", "x y", "xabcdefg", "cdef", "zz"]], "t string")
    frame = tagging.rules_frame(spark, rules)
    one = [r.k for r in tagging.tag(df, frame, F.col("t"), "k").collect()]
    two = {r.t: r.k for r in tagging.tag_by_anchors(df, frame, F.col("t"), "k").collect()}
    assert one == [two[r.t] for r in df.collect()]
    assert tagging.tag_by_anchors(df.limit(0), frame, F.col("t"), "k").count() == 0
