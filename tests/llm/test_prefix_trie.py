"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quire.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"
COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def ordered(rows):
    """Turns of every conversation in order, from (conv_id, turn, role, text)."""
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, digest(r or "", x or ""), (r or "", x or "")))
    return {c: [v[3] for v in sorted(turns, key=lambda v: v[:3])] for c, turns in convs.items()}


def brute(convs):
    nodes = {}
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            nodes.setdefault(tuple(convs[c][:d]), []).append(c)
    kids = {}
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        below = kids.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) or 1
        saved[k] = sum(saved[x] for x in below) + ((len(nodes[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    return sorted((m[0], len(k), nodes[k[:-1]][0] if k else -10**9, len(m), len(kids.get(k, [])), leaves[k], saved[k],
                   hashlib.sha256(",".join(str(c) for c in m if len(convs[c]) == len(k)).encode()).hexdigest())
                  for k, m in nodes.items())


def result(df):
    return sorted(tuple(-10**9 if v is None else v for v in (r[c] for c in COLS)) for r in df.collect())


def flat(convs):
    return [(c, i, r, x) for c, turns in convs.items() for i, (r, x) in enumerate(turns)]


def bushy():
    rng = random.Random(11)
    return {c: [("u", rng.choice(["a", "b", "ä" * 3])) for _ in range(rng.randrange(1, 9))] for c in range(-40, 160)}


def chain():
    """Each conversation continues the one before; copies; one of another kind."""
    long = [("u", f"turn {i}") for i in range(300)]
    out = {c: long[:n] for c, n in enumerate([1, 2, 63, 64, 65, 66, 127, 128, 129, 130, 192, 200, 255, 256, 257, 300, 300])}
    out |= {100 + c: long[:n] + [("u", f"other {c % 3}")] * (c % 4) for c, n in enumerate([0, 1, 63, 64, 65, 128, 200, 256])}
    return out


def long_edges():
    rng = random.Random(2)
    base = [("u", f"t{i}") for i in range(700)]
    out = {}
    for c in range(40):
        n = rng.randrange(1, 700)
        out[c] = base[:n] + [("a", f"x{rng.randrange(2)}")] * rng.randrange(0, 200)
    return out


@pytest.mark.parametrize("make", [bushy, chain, long_edges])
def test_every_prefix_has_its_numbers(spark, make):
    convs = {c: t for c, t in make().items() if t}
    turns = spark.createDataFrame(flat(convs), SCHEMA).withColumn("pos", F.lit("x")).withColumn("n", F.lit(1))
    numbered = T.numbered_turns(turns)
    assert result(T.prefix_nodes(numbered, numbered.select("conv_id").distinct())) == brute(convs)


def test_ties_nulls_repeats_and_turnless_conversations(spark):
    rows = [(1, None, "u", "first"), (1, 0, None, None), (1, 0, "u", "tie"), (1, 0, "a", "tie"), (1, 0, "a", "tie"),
            (2, 5, "u", "first"), (2, 6, "", ""), (3, 1, "u", "firs"), (3, 1, "ut", ""), (None, 1, "u", "lost"),
            (4, 0, "x", "y" * 100_000)]
    convs = ordered(rows) | {9: [], 8: []}
    ids = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    got = T.prefix_nodes(T.numbered_turns(spark.createDataFrame(rows, SCHEMA)), ids)
    assert result(got) == brute(convs)


def test_only_turnless_and_no_conversations(spark):
    none = T.numbered_turns(spark.createDataFrame([], SCHEMA))
    assert result(T.prefix_nodes(none, spark.createDataFrame([(5,), (3,)], "conv_id long"))) == brute({5: [], 3: []})
    assert T.prefix_nodes(none, spark.createDataFrame([], "conv_id long")).count() == 0


def test_shared_heads_follow_their_rule(spark):
    rng = random.Random(1)
    rows = [(c, t, "u", f"{c}-{t}") for c in [*range(-12, 40)] if c % 7 for t in range(rng.randrange(1, 14))]
    own = ordered(rows)
    want = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        want[c] = own.get(base, [])[:h] + own[c][h:]
    numbered, ids = T.shared_heads(T.numbered_turns(spark.createDataFrame(rows, SCHEMA)))
    got = {c: [] for c in (r.conv_id for r in ids.collect())}
    for r in sorted(numbered.collect(), key=lambda r: r.pos):
        got[r.conv_id].append(r.digest)
        assert r.pos == len(got[r.conv_id])
    assert got == {c: [digest(*t) for t in turns] for c, turns in want.items()}


def test_two_fattest_numbers(spark):
    rows = [(a, b) for a in range(0, 40) for b in range(a + 1, 41)] + [(2**40, 2**41 + 5), (2**50 - 1, 2**50 + 1)]
    df = spark.createDataFrame(rows, "a long, b long").withColumn("f", T.fattest(F.col("a"), F.col("b")))
    for r in df.collect():
        step = 1
        while r.b // (step * 2) * (step * 2) > r.a:
            step *= 2
        assert r.f == r.b // step * step and r.a < r.f <= r.b
