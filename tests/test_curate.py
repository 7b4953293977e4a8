"""Validity, topic, duplicates, id assignment and the curate flow."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quire.functions import tagging
from quire.operators import curate, linkage
from quire.operators.curate import CurateParams

P = CurateParams(as_of=dt.date(2025, 6, 30), id_prefix="qc")

CAND = ("source string, source_ord int, pos bigint, title string, authors array<string>, year int, "
        "month int, abstract string, url string, doi string, arxiv_id string, semantic_scholar_id string, "
        "citation_count bigint, open_access boolean, venue string, pdf_url string")
CAT = ("ord bigint, id string, title string, doi string, "
       "external_ids struct<arxiv_id:string,semantic_scholar_id:string,doi:string>")


def cand(title, *, src="arxiv", so=0, pos=0, authors=("X. Author",), year=2024, month=5, abstract="",
         url="https://example.org/p", doi="", arxiv="", s2="", cites=0, oa=None, venue=""):
    return (src, so, pos, title, list(authors) if authors is not None else None, year, month, abstract, url,
            doi, arxiv, s2, cites, oa, venue, "")


# one faulty field each, and what the reason must say
FAULTS = {
    "no year": (dict(year=None), "year=None outside [2017,2026]"),
    "before the first year": (dict(year=2016), "year=2016 outside [2017,2026]"),
    "after next year": (dict(year=2027), "year=2027 outside [2017,2026]"),
    "nobody wrote it": (dict(authors=()), "empty authors"),
    "authors unknown": (dict(authors=None), "empty authors"),
    "nowhere to read it": (dict(url=" \t"), "empty url"),
    "year before authors": (dict(year=1850, authors=()), "year=1850 outside [2017,2026]"),
}


def test_first_failing_rule_is_the_reason(spark):
    rows = [cand("Poisoned retrieval corpora", pos=i, **kw) for i, (kw, _) in enumerate(FAULTS.values())]
    rows += [cand("\u2003", pos=50), cand("Poisoned retrieval corpora", pos=51, year=2026)]
    got = {r["pos"]: r["reject_reason"] for r in
           curate.classify(spark.createDataFrame(rows, CAND), tagging.rules_frame(spark), P).collect()}
    assert [got[i] for i in range(len(FAULTS))] == [want for _, want in FAULTS.values()]
    assert got[50] == "empty title" and got[51] is None


def test_topic_needs_one_keyword_in_title_or_abstract(spark):
    rows = [cand("Jailbreak prompts in the wild", pos=0), cand("Tides of the North Sea", pos=1),
            cand("A field report", abstract="we red team an assistant", pos=2),
            cand("A field report", abstract=None, pos=3)]
    got = {r["pos"]: r["status"] for r in
           curate.classify(spark.createDataFrame(rows, CAND), tagging.rules_frame(spark), P).collect()}
    assert got == {0: None, 1: "off_topic", 2: None, 3: "off_topic"}


@pytest.fixture
def library(spark):
    rows = [(0, "qc-2023-00001", "Membership inference against medical chatbots", None,
             ("2305.07777", None, "10.6000/mi.77")),
            (1, "qc-2023-00002", "Watermarks that survive paraphrase", None, (None, "c0ffee", None))]
    return spark.createDataFrame(rows, CAT)


def run(spark, library, cands):
    df = spark.createDataFrame(cands, CAND)
    return {r["pos"]: r["status"] for r in curate.curate(df, library, tagging.rules_frame(spark), P).collect()}


def test_known_ids_and_titles_are_duplicates(spark, library):
    topic = dict(abstract="jailbreak")
    rows = [cand("Under another name", arxiv="2305.07777", pos=0, **topic),
            cand("Under a third name", doi="10.6000/MI.77", pos=1, **topic),
            cand("Under a fourth name", s2="c0ffee", pos=2, **topic),
            cand("Survive, paraphrase: that WATERMARKS!", pos=3, **topic),     # same words, other order
            cand("Watermarks that survive translation", pos=4, **topic),      # 3 of 5 words
            cand("Sandboxing tool calls", arxiv="2305.0777", pos=5, **topic)]  # an id's prefix is another id
    assert run(spark, library, rows) == {0: "duplicate", 1: "duplicate", 2: "duplicate", 3: "duplicate",
                                         4: "added", 5: "added"}


def test_doi_only_in_top_level_field(spark):
    lib = spark.createDataFrame([(0, "qc-2024-00001", "Old prompt injection work", "10.9/XY", (None, None, None))], CAT)
    assert run(spark, lib, [cand("New prompt injection study", doi="10.9/xy")])[0] == "duplicate"


def test_greedy_is_not_connected_components(spark, library):
    words = [f"w{i}" for i in range(19)] + ["prompt injection"]
    a = " ".join(words)
    b = a.replace("w0", "v0")
    c = b.replace("w1", "v1")
    out = run(spark, library, [cand(a, pos=0), cand(b, pos=1), cand(c, pos=2)])
    assert out == {0: "added", 1: "duplicate", 2: "added"}


def test_threshold_edge_is_not_a_dedup_match(spark, library):
    shared = [f"t{i}" for i in range(17)]
    a = " ".join(shared + ["a1", "a2", "a3"])   # 20 words
    b = " ".join(shared)                        # 17 of them: J = 17/20 = 0.85
    rows = [cand(a, abstract="prompt injection", pos=0), cand(b, abstract="prompt injection", pos=1)]
    assert run(spark, library, rows) == {0: "added", 1: "added"}   # strictly above 0.85 only


def test_blank_normalised_titles_in_one_batch(spark, library):
    rows = [cand("！！", abstract="prompt injection", pos=0), cand("。。", abstract="prompt injection", pos=1)]
    assert run(spark, library, rows) == {0: "added", 1: "duplicate"}


def test_blank_normalised_title_in_catalog_does_not_drop(spark):
    lib = spark.createDataFrame([(0, "qc-2024-00001", "？？", None, (None, None, None))], CAT)
    assert run(spark, lib, [cand("！！", abstract="prompt injection")])[0] == "added"


def test_same_s2_id_twice_in_batch_kept(spark, library):
    out = run(spark, library, [cand("Prompt injection one", s2="s2-new", pos=0),
                               cand("Jailbreak study two", s2="s2-new", pos=1)])
    assert out == {0: "added", 1: "added"}


def test_source_order_decides_the_winner(spark, library):
    t = "A study of prompt injection defenses"
    out = spark.createDataFrame([cand(t, src="crossref", so=2, pos=0), cand(t, src="semantic-scholar", so=1, pos=0),
                                 cand(t, src="arxiv", so=0, pos=0)], CAND)
    st = curate.curate(out, library, tagging.rules_frame(spark), P)
    kept = [r["source"] for r in st.filter("status = 'added'").collect()]
    assert kept == ["arxiv"]


def test_entry_projection_nulls_and_open_access(spark, library):
    df = spark.createDataFrame([cand("Prompt injection paper", oa=False, cites=0, month=0)], CAND)
    st = curate.curate(df, library, tagging.rules_frame(spark), P)
    e = curate.to_entries(st.filter("status = 'added'"), P).first()
    assert e["open_access"] is False and e["citation_count"] is None and e["month"] is None
    assert e["id"] == "qc-2025-00003" and e["reviewed"] is False and e["type"] == "paper"


def ids_df(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_next_id_follows_the_largest_five_digit_number(spark):
    mixed = ["qc-2019-00412", "zz-2025-00058", "qc-2024-0413", "no number", "qc-00900-x"]
    assert curate.next_id(ids_df(spark, mixed)).first()["next_num"] == 413
    assert curate.next_id(ids_df(spark, [])).first()["next_num"] == 1
    assert curate.next_id(ids_df(spark, ["only words"])).first()["next_num"] == 1


def test_next_id_overflow_fails_loudly(spark):
    cat = ids_df(spark, ["x-2024-99999", "x-2024-100000"]).withColumn("ord", F.lit(0))
    assert curate.next_id(cat).first()["overflow"] is True
    with pytest.raises(ValueError):
        curate.curate(spark.createDataFrame([], CAND), cat, tagging.rules_frame(spark), P)


def test_numbers_go_on_beyond_five_digits(spark, library):
    from dataclasses import replace

    from quire.plans import batches as bt

    p = replace(P, wider_ids=bt.PARAMS.wider_ids)
    rows = spark.createDataFrame([cand("Jailbreak one", pos=0), cand("Jailbreak two and three", pos=1)], CAND)
    for held, want in (("cat-2024-99999", [100000, 100001]), ("cat-2024-123456", [1, 2]), ("qc-2025-123456", [123457, 123458])):
        cat = library.withColumn("id", F.lit(held))
        st = curate.curate(rows, cat, tagging.rules_frame(spark), p)
        ids = sorted(r["id"] for r in curate.to_entries(st.filter("status = 'added'"), p).collect())
        assert ids == [f"qc-2025-{n:05d}" for n in want]


def test_run_counters_need_no_room_for_ids(spark, library, monkeypatch):
    from quire.plans import batches as bt
    from quire.plans import registry

    rows = [cand("Jailbreak prompts in the wild", pos=0), cand("Jailbreak prompts in the wild", pos=1),
            cand("Tides of the North Sea", pos=2), cand("Jailbreak", pos=3, year=None)]
    beyond = library.withColumn("id", F.lit("qc-2024-100000"))
    monkeypatch.setattr(bt, "candidates", lambda *_: spark.createDataFrame(rows, CAND))
    monkeypatch.setattr(bt, "catalog_part", lambda *_: beyond)
    monkeypatch.setattr(bt, "demo_rules", lambda *_: tagging.rules_frame(spark))
    got = registry.q_curate_run_counters(spark, "").first()
    assert (got.seen, got.invalid, got.off_topic, got.duplicate, got.added) == (4, 1, 1, 1, 1)
    with pytest.raises(ValueError):
        curate.curate(bt.candidates(), beyond, bt.demo_rules(), P)


def test_positions_must_be_unique_in_a_source(spark, library):
    rows = [cand("Jailbreak one", pos=3), cand("Jailbreak two", pos=3)]
    with pytest.raises(ValueError, match="not unique"):
        run(spark, library, rows)


def test_positions_beyond_any_span_keep_sources_apart(spark, library):
    far = 1 << 41
    rows = [cand("Jailbreak atlas", so=0, pos=far), cand("Jailbreak atlas", src="semantic-scholar", so=1, pos=0)]
    got = {r["source"]: r["status"] for r in
           curate.curate(spark.createDataFrame(rows, CAND), library, tagging.rules_frame(spark), P).collect()}
    assert got == {"arxiv": "added", "semantic-scholar": "duplicate"}


def test_short_titles_sharing_words_need_few_rounds(spark):
    import itertools

    rows = [(i, list(c)) for i, c in enumerate(itertools.combinations([f"w{i}" for i in range(10)], 3))]
    df = spark.createDataFrame(rows, "rid bigint, words array<string>")
    none = spark.createDataFrame([], "rid bigint, kind string, key string")
    got = linkage.greedy_keep_first(df, none, max_rounds=2)
    assert got.filter("kept").count() == len(rows)


def sequential(rows, limit=0.85):
    """Ids kept by the plain walk, and how deep links of earlier matches go."""
    kept, depth = [], {}
    sets = {r: set(w) for r, w in rows}
    for rid, w in rows:
        near = [k for k, _ in rows if k < rid and len(sets[k] & sets[rid]) > limit * len(sets[k] | sets[rid])]
        depth[rid] = 1 + max((depth[k] for k in near), default=0)
        if not set(near) & set(kept):
            kept.append(rid)
    return set(kept), max(depth.values(), default=0)


def decided(spark, rows, **kw):
    df = spark.createDataFrame(rows, "rid bigint, words array<string>")
    none = spark.createDataFrame([], "rid bigint, kind string, key string")
    return {r.rid for r in linkage.greedy_keep_first(df, none, **kw).filter("kept").collect()}


def test_titles_of_common_words_are_decided_in_few_rounds(spark):
    """All six of nine, seven of eleven words: every word has many holders and
    no two titles are similar, or many are."""
    import itertools

    rows = [(i, list(c)) for i, c in enumerate(itertools.combinations([f"w{i}" for i in range(9)], 6))]
    assert len(rows) == 84 and decided(spark, rows, max_rounds=3) == {i for i, _ in rows}
    rows = [(i, list(c)) for i, c in enumerate(
        x for n in (10, 9) for x in itertools.combinations([f"w{i}" for i in range(12)], n))]
    assert decided(spark, rows, max_rounds=3) == sequential(rows)[0]


def test_a_long_chain_of_matches_needs_no_round_a_link(spark):
    """Each title matches its neighbours alone, so every second one stays."""
    rows = [(i, [f"w{j}" for j in range(i, i + 14)]) for i in range(40)]
    kept, depth = sequential(rows)
    assert depth == 40 and kept == set(range(0, 40, 2)) and decided(spark, rows, max_rounds=2) == kept


@pytest.mark.parametrize("small", [2, 16])
def test_clusters_of_distinct_near_copies_match_the_sequential_rule(spark, monkeypatch, small):
    import random

    monkeypatch.setattr(linkage, "SMALL_GROUP", small)
    rnd = random.Random(small)
    rows = []
    for c in range(3):
        base = [f"c{c}w{i}" for i in range(30)] + ["the", "of"]
        for _ in range(25):
            s = list(base)
            for _ in range(rnd.randrange(4)):
                s[rnd.randrange(len(s))] = f"x{rnd.randrange(400)}"
            rows.append(sorted(set(s)))
    rnd.shuffle(rows)
    rows = list(enumerate(rows))
    assert decided(spark, rows, max_rounds=6) == sequential(rows)[0]


def test_near_copies_against_near_copies_give_candidates_in_proportion(spark):
    import random

    rnd = random.Random(2)
    base = [f"w{i}" for i in range(40)]

    def copies(side):
        return spark.createDataFrame([(i, [w if j != i % 40 else f"{side}{i}" for j, w in enumerate(base)])
                                      for i in range(2000)] + [(5000 + i, [f"{side}z{rnd.randrange(50)}{i}" for _ in range(9)])
                                                               for i in range(50)], "rid bigint, words array<string>")

    pairs = []
    got = linkage.similar_to_any(copies("l"), copies("r"), "0.85", True, on_candidates=pairs.append)
    assert sorted(r.rid for r in got.collect()) == list(range(2000))
    assert sum(pairs) < 40 * 4000      # all pairs would be 4,000,000


def test_words_are_not_shuffled_for_their_order(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "é", "c"]), (3, [])], "rid bigint, words array<string>")
    table = linkage.word_table(df)
    assert len(table) == linkage.SLOTS and sum(b > 0 for b in table) == 4
    rows = linkage.entries(linkage.prefix_rows(df, table, "0.5"))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {r.rid for r in rows.collect()} == {1, 2}


def test_greedy_refuses_repeated_or_null_row_ids(spark):
    none = spark.createDataFrame([], "rid bigint, kind string, key string")
    for ids in ([1, 1], [1, None]):
        df = spark.createDataFrame([(i, ["a", "b"]) for i in ids], "rid bigint, words array<string>")
        with pytest.raises(ValueError):
            linkage.greedy_keep_first(df, none)


def test_words_of_large_unlike_sets_do_not_move(spark, monkeypatch):
    # any two of the first twelve share 180 of their 1980 words; the others are
    # alike, with signatures of either length
    block = lambda i, j: [f"b{min(i, j)}-{max(i, j)}-{k}" for k in range(180)]
    sets = [sum((block(i, j) for j in range(12) if j != i), []) for i in range(12)]
    sets += [[f"near{k}" for k in range(n)] for n in (900, 995, 1000, 1100)] + [[f"near{k}" for k in range(120, 1100)]]
    seen = {}

    def noting(df, name="cut", scope=None):
        out = linkage_cut(df, name, scope)
        seen[name] = out.count()
        return out

    linkage_cut = linkage.cut
    monkeypatch.setattr(linkage, "cut", noting)
    df = spark.createDataFrame(list(enumerate(sets)), "rid bigint, words array<string>")
    got = {(r.l_rid, r.r_rid) for r in linkage.similar_pairs(df, None).collect()}
    s = [set(x) for x in sets]
    want = {(i, j) for j in range(len(s)) for i in range(j) if len(s[i] & s[j]) > 0.85 * len(s[i] | s[j])}
    assert got == want and len(want) >= 5
    assert seen["alike"] < 15


def test_similarity_join_matches_brute_force(spark):
    import random

    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(30)]
    sets = []
    for i in range(120):
        base = rnd.sample(vocab, rnd.randint(1, 12))
        sets.append((i, sorted(set(base))))
    for i in range(40):   # near copies
        j = rnd.randrange(len(sets))
        s = set(sets[j][1])
        if len(s) > 2 and rnd.random() < 0.5:
            s.discard(next(iter(s)))
        sets.append((120 + i, sorted(s)))
    df = spark.createDataFrame(sets, "rid bigint, words array<string>")
    got = {(r.l_rid, r.r_rid) for r in linkage.similar_pairs(df, None, "0.85", True).collect()}
    want = set()
    for a, wa in sets:
        for b, wb in sets:
            if a < b and wa and wb and len(set(wa) & set(wb)) / len(set(wa) | set(wb)) > 0.85:
                want.add((a, b))
    assert got == want


def test_greedy_matches_sequential_rule(spark):
    import random

    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(12)]
    rows = [(i, sorted(set(rnd.sample(vocab, rnd.randint(1, 6))))) for i in range(80)]
    df = spark.createDataFrame(rows, "rid bigint, words array<string>")
    keys = spark.createDataFrame([(i, "k", str(i % 9)) for i in range(0, 80, 5)], "rid bigint, kind string, key string")
    got = {r.rid for r in linkage.greedy_keep_first(df, keys).filter("kept").collect()}
    keymap = {i: str(i % 9) for i in range(0, 80, 5)}
    kept = []
    for rid, w in rows:
        bad = any((keymap.get(rid) is not None and keymap.get(rid) == keymap.get(k))
                  or (w and rows[k][1] and len(set(w) & set(rows[k][1])) / len(set(w) | set(rows[k][1])) > 0.85)
                  for k in kept)
        if not bad:
            kept.append(rid)
    assert got == set(kept)


def test_greedy_small_and_large_groups_match_sequential_rule(spark, monkeypatch):
    import random

    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(9)]
    base = [sorted(set(rnd.sample(vocab, rnd.randint(3, 7)))) for _ in range(12)]
    rows = []
    for i in range(150):   # many near copies of a few bases: dense, mixed-size groups
        s = set(rnd.choice(base))
        if rnd.random() < 0.5:
            s.add(rnd.choice(vocab))
        if rnd.random() < 0.3 and len(s) > 1:
            s.discard(rnd.choice(sorted(s)))
        rows.append((i, sorted(s)))
    df = spark.createDataFrame(rows, "rid bigint, words array<string>")
    none = spark.createDataFrame([], "rid bigint, kind string, key string")
    kept = []
    for rid, w in rows:
        if not any(len(set(w) & set(rows[k][1])) / len(set(w) | set(rows[k][1])) > 0.85 for k in kept):
            kept.append(rid)
    for small in (2, 16):
        monkeypatch.setattr(linkage, "SMALL_GROUP", small)
        got = {r.rid for r in linkage.greedy_keep_first(df, none).filter("kept").collect()}
        assert got == set(kept)


@pytest.mark.parametrize("few, sent", [(-1, 0), (100_000, 1)])
def test_what_grows_with_the_rows_is_not_sent_to_every_task(spark, monkeypatch, few, sent):
    plans, cut = [], linkage.cut

    def noted(df, name="cut", scope=None):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return cut(df, name, scope)

    monkeypatch.setattr(linkage, "cut", noted)
    monkeypatch.setattr(linkage, "FEW_PAIRS", few, raising=False)
    sets = [(i, [f"w{i % 10}_{k}" for k in range(8)] + ([f"x{i}"] if i >= 20 else [])) for i in range(40)]
    df = spark.createDataFrame(sets, "rid bigint, words array<string>")
    keys = spark.createDataFrame([(i, "k", str(i)) for i in (5, 6, 7)] + [(39, "k", "5")], "rid bigint, kind string, key string")
    got = {r.rid for r in linkage.greedy_keep_first(df, keys).filter("kept").collect()}
    assert got == set(range(10))
    # only a few verified pairs may go to every task, by the tables of ``_verify``
    assert {n for n, p in plans if "BroadcastExchange" in p} <= ({"alike", "matches", "tried"} if sent else set())


def _cuts_made(spark, monkeypatch):
    """Names of the tables that linkage and curate write, as they are written."""
    from quire import session

    made = []

    def noted(df, name="cut", scope=None):
        made.append(name)
        return session.cut(df, name, scope)

    for module in (linkage, curate):
        monkeypatch.setattr(module, "cut", noted)
    return made


def test_pairs_found_in_turns_are_all_pairs(spark, monkeypatch):
    import random

    rnd = random.Random(7)
    sets = []
    for _ in range(30):
        base = [f"w{rnd.randrange(300)}" for _ in range(rnd.randrange(5, 45))]
        for _ in range(4):
            s = set(base)
            for _ in range(rnd.randrange(4)):
                s = (s | {f"x{rnd.randrange(50)}"}) if rnd.random() < 0.5 else s - {rnd.choice(base)}
            sets.append(sorted(s))
    rows = [(i, s) for i, s in enumerate(sets) if s]

    def alike(a, b):
        return len(set(a) & set(b)) / len(set(a) | set(b)) > 0.85

    made = _cuts_made(spark, monkeypatch)
    monkeypatch.setattr(linkage, "TURN_SETS", 20)
    monkeypatch.setattr(linkage, "FEW_PAIRS", 0)         # words of both ends are written before they move
    df = spark.createDataFrame(rows, "rid bigint, words array<string>")
    got = [(r.l_rid, r.r_rid) for r in linkage.similar_pairs(df, None).collect()]
    assert sorted(got) == [(i, j) for i, a in rows for j, b in rows if i < j and alike(a, b)] and got
    assert made.count("turn") == linkage.MOST_TURNS and {"l-ends", "r-ends"} <= set(made)
    left, right = df.filter("rid % 2 = 0"), df.filter("rid % 2 = 1")
    got = [(r.l_rid, r.r_rid) for r in linkage.similar_pairs(left, right).collect()]
    assert sorted(got) == [(i, j) for i, a in rows if i % 2 == 0 for j, b in rows if j % 2 and alike(a, b)] and got


def test_words_are_written_once_and_searches_leave_only_their_answer(spark, monkeypatch):
    import os

    from quire.session import ensure_checkpoint_dir

    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    made = _cuts_made(spark, monkeypatch)
    df = spark.createDataFrame([(i, [f"w{j}" for j in range(i, i + 9)]) for i in range(5)] + [(9, [])], "rid bigint, words array<string>")
    assert {r.rid: r.n_similar for r in linkage.similar_counts(df).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 9: 0}
    assert [m for m in made if m.endswith("-rows") and m != "prefix-rows"] == ["count-rows"]
    before = set(os.listdir(base))
    got = linkage.similar_to_any(df, df.filter("rid < 2"))
    left = set(os.listdir(base)) - before
    assert [x.split("-")[1] for x in left] == ["similar"]
    assert sorted(r.rid for r in got.collect()) == [0, 1]


def test_texts_of_candidates_move_once(spark, library):
    import contextlib
    import io
    import re

    rows = [cand(f"Jailbreak study {i} {'long ' * i}", pos=i) for i in range(12)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        st = curate.curate(spark.createDataFrame(rows, CAND), library, tagging.rules_frame(spark), P)
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            st.select("title", "status", "num").explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = re.findall(r"\(\d+\) Exchange[^\n]*\nInput \[\d+\]: \[[^\n]*\btitle#", out.getvalue())
    assert len(moved) == 1
    # the words of the candidates are those of the whole title all the same
    words = {r["pos"]: r["words"] for r in st.collect()}
    assert words[3] == ["jailbreak", "study", "3", "long"]
