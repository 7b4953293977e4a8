"""Structure repair against an exhaustive search over all edits."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from quire.llm import repair
from quire.llm.queries import op13_structure_repair

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """All edit sequences of a short conversation, by recursion on its turns."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    flags, seen = [], set()
    for _, role, text in rows:
        blank = re.search(r"[^\x20\x09-\x0D]", text) is None
        dup = not blank and (role, text) in seen
        trunc = not blank and not dup and not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text)
        seen.add((role, text))
        flags.append((blank, dup, trunc))
    best = None

    def step(i, cost, audit, out, inserts):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        # a prefix that no repaired conversation starts with is given up
        if not re.fullmatch("s?(ua)*u?", "".join(r[:1] or "?" for r, _ in out)):
            return
        if inserts < 2:
            for role in ("user", "assistant"):
                step(i, cost + 2, audit + "I", [*out, (role, "")], inserts + 1)
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out)):
                key = (cost, audit, out)
                best = key if best is None or key[:2] < best[:2] else best
            return
        _, role, text = rows[i]
        blank, dup, trunc = flags[i]
        step(i + 1, cost + 3, audit + "D", out, 0)
        if not (blank or dup):
            step(i + 1, cost + trunc, audit + "K", [*out, (role, text)], 0)
            for r in ("user", "assistant"):
                step(i + 1, cost + 2 + trunc, audit + "R", [*out, (r, text)], 0)

    step(0, 0, "", [], 0)
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [(a[1][:1] + b[1][:1]) for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            sum(f[0] for f in flags), sum(f[1] for f in flags), sum(f[2] for f in flags),
            sum(p not in ("su", "ua", "au") for p in pairs), best[0], best[1],
            hashlib.sha256("\n".join(f"{r}:{x}" for r, x in best[2]).encode()).hexdigest()), best[2]


def conversations():
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, " "]
    texts = ["Yes.", "No!", "cut off", "", None, " \t\n", "Why?  ", "\x0b.", "ünïcode。", "Yes. "]
    out = {}
    for c in range(160):
        n = rng.randrange(0, 6)
        out[c if c else None] = [(rng.choice([None, 0, 1, 2, 3, 3, 9, -4]), rng.choice(roles[:5] if c % 2 else roles),
                                  rng.choice(texts[:3] if c % 3 else texts)) for _ in range(n)]
    out[-7] = [(i, ["user", "assistant"][i % 2], f"Turn {i}.") for i in range(6)]
    out[-8] = [(i, "assistant", f"Turn {i}.") for i in range(5)]
    return out


def test_repairs_are_the_cheapest_with_the_least_audit(spark):
    convs = conversations()
    turns = spark.createDataFrame([(c, *r) for c, rows in convs.items() for r in rows], SCHEMA)
    ids = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(turns.withColumn("seen", F.lit(1)), ids).collect()}
    want = {c: brute(rows) for c, rows in convs.items()}
    assert got == {c: w[0] for c, w in want.items()}
    # the repaired turns themselves
    made = {}
    for r in sorted(repair.repaired_turns(turns, repair.repair(turns)).collect(),
                    key=lambda r: (r.conv_id or 0, r.place)):
        made.setdefault(r.conv_id, []).append((r.role, r.text))
    assert made == {c: w[1] for c, w in want.items() if w[1]}


def test_grammar_accepts_what_its_pattern_accepts():
    import itertools

    g = repair.Grammar(repair.ROLE_GRAMMAR)
    for n in range(7):
        for word in itertools.product("sua", repeat=n):
            stacks = {g.bottom}
            for symbol in word:
                stacks = {to for s in stacks for to in g.after(s, symbol)}
            assert any(map(g.accepts, stacks)) == bool(re.fullmatch("(s?(ua)+)?", "".join(word)))
    assert len(g.nodes) < 20         # stacks are shared, however long the word


def test_a_long_conversation_takes_linear_time():
    import time

    def run(n):
        g, t = repair.Grammar(repair.ROLE_GRAMMAR), time.process_time()
        p = repair.Parse(g)
        for i in range(n):
            p.turn("system" if i == 0 else ["user", "assistant"][i % 2], "Ties, always ties.", False, i % 3 == 0)
        p.best()
        return time.process_time() - t

    run(2_000)
    short = run(5_000)
    assert run(20_000) < 10 * short + 0.5


def test_empty_tables_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA + ", _same string, audit string, place int")
    assert repair.repair(empty).count() == 0
    row = repair.repair(empty, spark.createDataFrame([(3,)], "conv_id long")).collect()
    assert [tuple(r) for r in row] == [(3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repaired_turns(empty, repair.repair(empty)).count() == 0


def test_damage_follows_its_rule(spark):
    import zlib

    rows = [(c, t, "assistant", "Two. Stops!") for c in (1, 2, None) for t in [*range(60), None]]
    got = sorted((str(r.conv_id), str(r.turn), r.role, r.text)
                 for r in repair.damage(spark.createDataFrame(rows, SCHEMA)).collect())
    want = []
    for c, t, role, text in rows:
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        one = (str(c), str(t), "user" if f == 4 else role, {1: "", 2: "Two Stops"}.get(f, text))
        want += [one] * {0: 0, 3: 2}.get(f, 1)
    assert got == sorted(want)


def test_query_covers_every_conversation(spark):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()
    assert op13_structure_repair(spark, sf).count() == n
