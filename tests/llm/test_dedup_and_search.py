"""Chosen-path similarity join, components, exact top-k, URL rules."""

import random

import numpy as np

from quire.llm import chosen_path, components, topk, url_filter


def words_of(text):
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


def shingle_set(text):
    w = words_of(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and (len(a & b) >= 0.8 * len(a | b) if a and b else
                           not a and not b and (rows[i][1] or "") == (rows[j][1] or "")):
                links[i] += 1
                root[find(i)] = find(j)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        smallest[find(i)] = min(smallest.get(find(i), d), d)
    return {(d, smallest[find(i)], links[i]) for i, (d, _) in enumerate(rows)}


def corpus(seed=2):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, d = [], 0
    for _ in range(12):      # groups of near copies, and texts of their own
        base = [rnd.choice(vocab) for _ in range(rnd.randint(4, 120))]
        for _ in range(rnd.choice([1, 2, 9])):
            text = list(base)
            for _ in range(rnd.randint(0, 3)):
                text[rnd.randrange(len(text))] = rnd.choice(vocab)
            rows.append((d, " ".join(text)))
            d += 1
    hot = [rnd.choice(vocab) for _ in range(200)]
    for _ in range(90):      # more than a leaf and several tiles hold
        text = list(hot)
        for _ in range(rnd.randint(0, 6)):
            text[rnd.randrange(len(text))] = rnd.choice(vocab)
        rows.append((d, " ".join(text)))
        d += 1
    for t in (None, "", "!!", "??", "one two", "One, two!", "three", "a " * 30_000, "a " * 20_000):
        rows.append((d, t))
        d += 1
    return rows


def test_classes_and_links_match_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "TILE", 24)
    monkeypatch.setattr(chosen_path, "LEAF", 16)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.class_id, r.n_links) for r in chosen_path.similarity_classes(df).collect()}
    assert got == brute_classes(rows)


def test_join_as_a_stage_keeps_one_of_each_class(spark, docs):
    out = chosen_path.keep_one(docs.filter("doc_id is not null"))
    assert out.columns == docs.columns
    # null and empty are the same text; rows 3 and 4 and the repeated row 3 as well
    assert sorted(r.doc_id for r in out.collect()) == [0, 2, 3, 3, 5, 6, 7, 8, 9, 10, 11]
    assert chosen_path.similarity_classes(docs.limit(0)).count() == 0
    assert chosen_path.similarity_classes(docs).count() == docs.count()


def test_near_copies_with_one_id_or_none_leave_one_row(spark):
    def near(word):
        return [" ".join(f"{word}{i}" for i in range(200)) + end for end in ("", " more", " and more")]

    rows = [(7, t) for t in near("a")] + [(None, t) for t in near("b")] + [(7, "alone")]
    out = chosen_path.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text[:2]) for r in out) == [(0, "b0"), (7, "a0"), (7, "al")]


def test_intersections_are_exact():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 5000, rnd.integers(0, 9000)).astype(np.uint64)) for _ in range(12)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = chosen_path.intersections(sets)
    np.fill_diagonal(got, 0)
    want = np.array(want, float)
    np.fill_diagonal(want, 0)
    assert (got == want).all()


def test_components_of_chains_stars_and_cycles(spark):
    rnd = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(60, 100)] + [(200, 201), (201, 202), (202, 200)]
    links += [(5, 5), (40, 39)]
    rnd.shuffle(links)
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.id: r.root for r in components.connected_components(df).collect()}
    want = {i: 0 for i in range(41)} | {i: 60 for i in range(60, 101)} | {i: 200 for i in (200, 201, 202)}
    assert got == want


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 100)
    monkeypatch.setattr(topk, "FEW", 8)
    rnd = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.round(rnd.normal(0, 1, 6), 1)]) for i in range(330)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]                      # ties
    # rows repeated whole, and one id with another vector
    rows += [rows[0], rows[7], rows[7], (50, [2.0] * 6), (2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6),
             (2003, [float("inf")] * 6), (2004, []), (None, [1.0] * 6), (2005, [3.0, 3.0])]
    df = spark.createDataFrame([(i, v, 0, "s") for i, v in rows], "vec_id long, embedding array<float>, x int, v string")
    vectors = topk.integer_vectors(df, "vec_id", "embedding")
    got = {}
    for r in topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_rid, {"id": r.query_id})[r["rank"]] = (r.vec_id, r.score)
    usable = [(i, np.floor(np.array(v, np.float32).astype(float) * 256).astype(int)) for i, v in rows
              if i is not None and v and None not in v and np.isfinite(v).all()]
    usable = [(i, np.pad(v, (0, 6 - len(v)))) for i, v in usable]
    # every row counts, repeated ones too, and only the query's own row is no candidate
    want = []
    for n, (i, q) in enumerate(usable):
        if i % 50 == 0:
            best = sorted(((-int(v @ q), j) for m, (j, v) in enumerate(usable) if m != n))[:5]
            want.append((i, [(j, -s) for s, j in best]))
    assert sorted((g["id"], [g[k] for k in range(1, 6)]) for g in got.values()) == sorted(want)
    assert len(want) == 10
    few = topk.top_k(vectors.filter("vec_id < 3"), vectors.filter("vec_id = 0"), 5)
    assert few.count() == 6 and topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_lists_are_read_in_part_on_the_given_vectors(spark):
    v = topk.integer_vectors(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"), "vec_id", "embedding")
    rows = v.collect()
    x = np.array([r.v for r in rows])
    shard = topk.Shard(np.array([r.rid for r in rows]), np.array([r.vec_id for r in rows]), x)
    asked = [i for i, r in enumerate(rows) if r.vec_id % 50 == 0]
    own = np.array([rows[i].rid for i in asked])

    def found(floors=None):
        shard.touched = 0
        return shard.top(own, x[asked], 5, floors), shard.touched

    plain, read = found()
    for i, (where, score) in zip(asked, plain):
        assert list(score) == sorted(np.delete(x @ x[i], i), reverse=True)[:5]
    # brute force reads every value for every query
    assert read < len(asked) * x.size
    # a floor from elsewhere never costs more, and nothing at or above it is lost
    best = np.array([score[0] for _, score in plain])
    floored, less = found(best)
    assert less <= read and [s[0] for _, s in floored] == best.tolist()


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("a.b.example.org", "/es/x", "allow"),
         ("org", "/", "allow"), ("net", "", "block"), ("net", "/ok", "allow")]


def test_url_rules_match_a_plain_loop(spark):
    urls = [None, "", "no scheme/org", "http://ORG/", "https://example.org/es/1?q#f", "https://x.example.org/es/",
            "https://notexample.org/es/", "https://a.b.example.org/es/x1", "https://z.a.b.example.org/es/y",
            "ftp://u://v/", "http://net", "http://a.net/ok/1", "http://a.net?x=/ok", "http://a.net#/ok", "http://planet/",
            "http://" + "a." * 3000 + "org/", "http://É.net/ok", "://net/ok", "http:///ok"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(3, urls[3], "h"), (None, urls[4], "h")],
                               "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_filter.judge(df, rules).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        if r.page_id is None:
            continue
        _, sep, rest = (urls[r.page_id] or "").partition("://")
        cuts = [rest.find(c) for c in "/?#" if c in rest]
        host = rest[:min(cuts, default=len(rest))] if sep else ""
        path = rest[len(host):] if sep else ""
        path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[1], best[2]), urls[r.page_id]
    none = url_filter.judge(df, rules.limit(0))
    assert {r.verdict for r in none.collect()} == {"allow"} and url_filter.judge(df.limit(0), rules).count() == 0


def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark):
    from pyspark.sql import functions as F

    listed = spark.range(4000).select(F.concat(F.lit("h"), "id").alias("host"), F.lit("/").alias("path"))
    blocks, n = url_filter.bloom_blocks(listed, 4000)
    keys = spark.range(8000).select("id", F.concat(F.lit("h"), "id").alias("host"), F.lit("/").alias("path"))
    h = F.xxhash64("host", "path")
    probe = keys.select("id", F.pmod(h, F.lit(n)).alias("block"),
                        *[w.alias(f"p{i}") for i, w in enumerate(url_filter._bit_columns(h))]).join(blocks, "block")
    for i in range(4):
        probe = probe.filter(F.col(f"p{i}").bitwiseAND(F.col(f"w{i}")) == F.col(f"p{i}"))
    assert probe.filter("id < 4000").count() == 4000 and probe.filter("id >= 4000").count() < 80
