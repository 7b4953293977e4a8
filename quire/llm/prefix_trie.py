"""Prefix trie of conversations as a distributed z-fast trie.

Conversations are strings of turns. The compacted trie keeps a node where a
conversation ends or two of them part; the edge above a node spans many turns.
A prefix is named by a *point*: its depth, a 112-bit fingerprint and its bytes.

1. Turns become digests; positions and running fingerprints are computed over
   blocks of 64 turns and blocks of blocks, so no task holds a conversation.
   Equal conversations become one string with a count.
2. Every edge is filed under its *handle*, the prefix whose depth is the
   two-fattest number on the edge (the multiple of the largest power of two).
   A string finds its exit edge by fat binary search: it asks for the handle
   at the two-fattest depth between its bounds; a hit moves the lower bound to
   the end of the edge found, a miss the upper one below the depth asked for.
   That takes a logarithmic number of joins in the longest conversation.
3. Strings are inserted in batches: located in the trie so far, each is
   compared with its exit edge (binary search over blocks, then within one);
   edges are split where strings leave them. Strings that leave at one point
   by one turn form a bundle: one member, picked by hash, becomes the new leaf
   edge, the others are compared with it in the next round. A random member's
   path halves a bundle on average, so rounds grow with the logarithm of the
   table, whatever the shape (chains of ever longer conversations included).
4. Subtree sums by pointer doubling over compacted nodes; edges are expanded
   to one row per depth, with the sums along an edge in closed form.

Joins whose one side may repeat a hot key (a first turn or a copy shared by a
third of all rows) meet a written table or a plain shuffle, never an aggregate,
so Spark's skew handling can split them.

Defined cases: null role or text counts as empty, rows without conv_id take no
part; turns are ordered by turn (null first), ties by their digest, repeated
rows all stay; equal (role, text) means equal turns; conversations without
turns are members of the root; an empty table gives no rows; other columns are
ignored. Distinct prefixes are told apart by 112 bits of fingerprint, summed
from SHA-256 digests.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import shuffle_partitions
from quire.operators.common import ordered_rank
from quire.session import cut

BLOCK = 64
MASK = (1 << 56) - 1            # 64 terms of 56 bits add up within a long
FIRST_BATCH = 8                 # one string in so many is inserted first
POINT = "struct<d:long,a:long,b:long,n:long>"
EDGE = "struct<p:%s,e:%s,y:long>" % (POINT, POINT)


def _root() -> Column:
    return F.struct(*[F.lit(0).cast("long").alias(c) for c in "dabn"])


# -- turns, positions, running fingerprints ---------------------------------

def numbered_turns(turns: DataFrame) -> DataFrame:
    """``(conv_id, pos, digest, n_bytes)``: turns by position, from 1, within
    their conversation. Texts do not travel further than here."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes")).filter("conv_id IS NOT NULL")
    return (ordered_rank(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("digest")], out="pos")
            .select("conv_id", "pos", "digest", "n_bytes"))


def shared_heads(numbered: DataFrame, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings, by a rule over their ids, to build
    tries of: conversation c is the first h = crc32(c) % (most + 1) turns of
    conversation c - c % 5, then its own turns after its first h. Returns the
    numbered turns and all conversation ids."""
    numbered = cut(numbered, "numbered")
    ids = cut(numbered.groupBy("conv_id").agg(F.max("pos").alias("own")).select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"),
        (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).alias("h"), "own"), "conversations")
    size = ids.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    plan = cut(ids.join(size, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("base_own", F.lit(0))).alias("head")), "heads")
    heads = (numbered.filter((F.col("conv_id") % 5 == 0) & (F.col("pos") <= most))
             .withColumnRenamed("conv_id", "base").join(plan, "base").filter("pos <= h")
             .select("conv_id", "pos", "digest", "n_bytes"))
    own = (numbered.join(plan.select("conv_id", "h", "head"), "conv_id").filter("pos > h")
           .select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "digest", "n_bytes"))
    return heads.unionByName(own), plan.select("conv_id")


def _masked(total: Column, c: str) -> Column:
    return (total if c == "n" else total.bitwiseAND(F.lit(MASK))).alias(f"o{c}")


def _before(sums: DataFrame, top: int) -> DataFrame:
    """Sums of all earlier blocks of the conversation, for each block; groups
    of at most 64 rows, one level of blocks of blocks after the other."""
    def earlier(*keys):
        w = Window.partitionBy(*keys).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
        return [_masked(F.coalesce(F.sum(c).over(w), F.lit(0)), c) for c in "abn"]

    if top < BLOCK:
        return sums.select("conv_id", "blk", *earlier("conv_id"))
    up = sums.withColumn("up", F.shiftright("blk", 6))
    above = _before(up.groupBy("conv_id", F.col("up").alias("blk")).agg(
        *[F.sum(c).bitwiseAND(F.lit(MASK)).alias(c) if c != "n" else F.sum(c).alias(c) for c in "abn"]), top >> 6)
    above = above.select("conv_id", F.col("blk").alias("up"), *[F.col(f"o{c}").alias(f"u{c}") for c in "abn"])
    return (up.select("conv_id", "up", "blk", *earlier("conv_id", "up")).join(above, ["conv_id", "up"])
            .select("conv_id", "blk", *[_masked(F.col(f"o{c}") + F.col(f"u{c}"), c) for c in "abn"]))


def point_blocks(numbered: DataFrame) -> DataFrame:
    """``(conv_id, blk, before, items)``: the points at the depths of each
    block of 64 turns and the first one of the next block, in order; ``before``
    is the bytes up to the block."""
    terms = numbered.select(
        "conv_id", F.col("pos").alias("d"), F.shiftright(F.col("pos") - 1, 6).alias("blk"),
        F.xxhash64("digest", "pos").bitwiseAND(F.lit(MASK)).alias("a"),
        F.xxhash64("pos", F.lit("second"), "digest").bitwiseAND(F.lit(MASK)).alias("b"), F.col("n_bytes").alias("n"))
    raw = cut(terms.groupBy("conv_id", "blk").agg(F.sort_array(F.collect_list(F.struct("d", "a", "b", "n"))).alias("t")),
              "terms")
    top = raw.agg(F.max("blk")).first()[0] or 0

    def total(arr, c):
        return F.aggregate(arr, F.lit(0).cast("long"), lambda s, t: s + t[c])

    sums = raw.select("conv_id", "blk", *[(total("t", c).bitwiseAND(F.lit(MASK)) if c != "n" else total("t", c)).alias(c)
                                          for c in "abn"])
    following = raw.select("conv_id", (F.col("blk") - 1).alias("blk"), F.element_at("t", 1).alias("then"))
    x = (raw.join(_before(sums, top), ["conv_id", "blk"]).join(following, ["conv_id", "blk"], "left")
         .withColumn("t", F.when(F.col("then").isNull(), F.col("t")).otherwise(F.concat("t", F.array("then")))))

    def point(t, i):
        upto = F.slice(F.col("t"), 1, i + 1)
        return F.struct(t["d"].alias("d"), *[(total(upto, c) + F.col(f"o{c}")).bitwiseAND(F.lit(MASK)).alias(c)
                                             for c in "ab"], (total(upto, "n") + F.col("on")).alias("n"))

    return cut(x.select("conv_id", "blk", F.col("on").alias("before"), F.transform("t", point).alias("items")), "points")


def _point_at(df: DataFrame, blocks: DataFrame, conv: Column, depth: Column, out: str) -> DataFrame:
    """``df`` with the point of conversation ``conv`` at ``depth`` (null
    where there is none)."""
    b = blocks.select(F.col("conv_id").alias("_c"), F.col("blk").alias("_b"), F.col("items").alias("_i"))
    j = df.join(b, (conv == F.col("_c")) & (F.shiftright(depth - 1, 6) == F.col("_b")), "left")
    return j.withColumn(out, F.get("_i", ((depth - 1) % BLOCK).cast("int"))).drop("_c", "_b", "_i")


# -- the z-fast trie --------------------------------------------------------

def fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that the largest power of two divides."""
    step = F.pow(F.lit(2), F.length(F.bin(low.bitwiseXOR(high))) - 1).cast("long")
    return high - high % step


def _filed(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Edges with their first point (one turn down) and their handle."""
    at = _point_at(edges, blocks, F.col("y"), F.col("p.d") + 1, "first")
    return cut(_point_at(at, blocks, F.col("y"), fattest(F.col("p.d"), F.col("e.d")), "handle"), "trie")


def locate(strings: DataFrame, trie: DataFrame, blocks: DataFrame) -> DataFrame:
    """The exit edge of every string ``(x, end)`` by fat binary search:
    ``(x, end, edge, lo, at)``. ``edge`` is the edge (p, e, y) that the string
    leaves or ends in and ``lo`` a depth on it that it still shares; where it
    leaves at a node instead, ``edge`` is null and ``at`` that node's point.
    Strings that end at a node are in the trie already and are left out."""
    handles = trie.select(F.col("handle").alias("_h"), F.struct("p", "e", "y").alias("_edge"))
    state = strings.select("x", "end", F.lit(0).cast("long").alias("l"), F.col("end.d").alias("r"),
                           F.lit(None).cast(EDGE).alias("hit"))
    done = []
    while True:
        state = state.withColumn("f", fattest(F.col("l"), F.col("r")))
        state = _point_at(state, blocks, F.col("x"), F.col("f"), "asked")
        state = state.join(handles, F.col("asked") == F.col("_h"), "left")
        found = F.col("_edge").isNotNull()
        state = cut(state.select("x", "end", F.when(found, F.col("_edge.e.d")).otherwise(F.col("l")).alias("l"),
                                 F.when(found, F.col("r")).otherwise(F.col("f") - 1).alias("r"),
                                 F.coalesce("_edge", "hit").alias("hit")), "search")
        done.append(state.filter("l >= r"))
        state = state.filter("l < r")
        if state.isEmpty():
            break
    # the deepest node whose handle the string has: passed whole, or left on its edge
    s = reduce(DataFrame.unionByName, done)
    node = F.coalesce("hit.e", _root())
    s = _point_at(s.withColumn("node", node), blocks, F.col("x"), F.col("node.d"), "here")
    whole = (F.col("node.d") == 0) | F.coalesce(F.col("here") == F.col("node"), F.lit(False))
    s = s.withColumn("whole", whole).filter(~(F.col("whole") & (F.col("node.d") == F.col("end.d"))))
    s = _point_at(s, blocks, F.col("x"), F.when(F.col("whole"), F.col("node.d") + 1), "next")
    firsts = trie.select(F.col("first").alias("_f"), F.struct("p", "e", "y").alias("_child"))
    s = s.join(firsts, F.col("next") == F.col("_f"), "left")
    onto = F.when(F.col("whole"), F.col("_child")).otherwise(F.col("hit"))
    lo = F.when(F.col("whole"), F.col("node.d") + 1).otherwise(fattest(F.col("hit.p.d"), F.col("hit.e.d")))
    return s.select("x", "end", onto.alias("edge"), lo.alias("lo"), "node").select(
        "x", "end", "edge", "lo", F.when(F.col("edge").isNull(), F.col("node")).alias("at"))


def _part(pending: DataFrame, blocks: DataFrame) -> DataFrame | None:
    """Where each pending string parts from its edge: ``(x, end, edge, at,
    next)``, ``at`` the last shared point and ``next`` the string's own one
    after it (null where it ends there). Null if nothing is pending."""
    far = F.col("edge").isNotNull() & (F.shiftright(F.col("hi") - 1, 6) > F.shiftright(F.col("lo") - 1, 6))
    far = F.coalesce(far, F.lit(False))
    p = cut(pending.withColumn("hi", F.least("edge.e.d", "end.d")), "pending")
    seen = p.agg(F.count(F.lit(1)).alias("n"), F.max(far).alias("far")).first()
    if not seen["n"]:
        return None
    ready = [p.filter(~far)]
    while seen["far"]:
        # binary search for the last block whose first turn is still shared
        p = p.filter(far)
        a, b = F.shiftright(F.col("lo") - 1, 6), F.shiftright(F.col("hi") - 1, 6)
        p = p.withColumn("mid", F.floor((a + b + 1) / 2) * BLOCK + 1)
        p = _point_at(p, blocks, F.col("x"), F.col("mid"), "_mine")
        p = _point_at(p, blocks, F.col("edge.y"), F.col("mid"), "_theirs")
        same = F.coalesce(F.col("_mine") == F.col("_theirs"), F.lit(False))
        p = cut(p.select("x", "end", "edge", "at", F.when(same, F.col("mid")).otherwise(F.col("lo")).alias("lo"),
                         F.when(same, F.col("hi")).otherwise(F.col("mid") - 1).alias("hi")), "pending")
        ready.append(p.filter(~far))
        seen = p.agg(F.max(far).alias("far")).first()
    p = reduce(DataFrame.unionByName, ready)
    # within one block: equal points up to the place where they part, none after
    b = blocks.select(F.col("conv_id").alias("_c"), F.col("blk").alias("_b"), F.col("items").alias("_i"))
    blk = F.shiftright(F.coalesce("lo", F.col("at.d") + 1) - 1, 6)
    p = p.join(b, (F.col("x") == F.col("_c")) & (blk == F.col("_b")), "left").drop("_c", "_b")
    b = b.withColumnRenamed("_i", "_y")
    p = p.join(b, (F.col("edge.y") == F.col("_c")) & (blk == F.col("_b")), "left").drop("_c", "_b")
    shared = F.size(F.filter(F.zip_with("_i", "_y", lambda u, v: u == v), lambda same: F.coalesce(same, F.lit(False))))
    # the block's 65th point belongs to the next block: strings that share it are not here
    shared = F.when(F.col("edge").isNull(), F.col("at.d") - blk * BLOCK).otherwise(shared)
    p = p.withColumn("at", F.coalesce("at", F.get("_i", (shared - 1).cast("int"))))
    return cut(p.select("x", "end", "edge", "at",
                        F.get("_i", (F.col("at.d") - blk * BLOCK).cast("int")).alias("next")), "parted")


def insert(strings: DataFrame, trie: DataFrame | None, blocks: DataFrame) -> DataFrame | None:
    """The trie with a batch of strings ``(x, end)`` put in (null: no trie)."""
    if trie is None:
        pending = strings.select("x", "end", F.lit(None).cast(EDGE).alias("edge"), F.lit(None).cast("long").alias("lo"),
                                 _root().alias("at"))
        open_edges = None
    else:
        pending = locate(strings, trie, blocks)
        open_edges = trie.select("p", "e", "y")
    closed = []
    while (parted := _part(pending, blocks)) is not None:
        splits = (parted.filter(F.col("edge").isNotNull() & (F.col("at.d") < F.col("edge.e.d")))
                  .select("edge", F.col("at").alias("e")).distinct())
        if open_edges is not None:
            cuts = splits.select(F.col("edge.e").alias("_e")).distinct()
            closed.append(open_edges.join(cuts, F.col("e") == F.col("_e"), "left_anti"))
        ends = splits.unionByName(splits.select("edge", F.col("edge.e").alias("e")).distinct())
        above = F.lag("e").over(Window.partitionBy("edge").orderBy("e.d"))
        closed.append(ends.select(F.coalesce(above, F.col("edge.p")).alias("p"), "e", F.col("edge.y").alias("y")))
        leaving = parted.filter(F.col("next").isNotNull())
        # one of each bundle, picked by hash, becomes the leaf the others are compared with
        leaves = cut(leaving.groupBy(F.col("next").alias("key")).agg(
            F.min(F.struct(F.xxhash64("x").alias("h"), F.col("x"), F.col("end"), F.col("at"))).alias("s"))
            .select("key", F.struct(F.col("s.at").alias("p"), F.col("s.end").alias("e"), F.col("s.x").alias("y"))
                    .alias("leaf")), "leaves")
        open_edges = leaves.select("leaf.*")
        pending = (leaving.join(leaves, F.col("next") == F.col("key")).filter(F.col("x") != F.col("leaf.y"))
                   .select("x", "end", F.col("leaf").alias("edge"), F.col("key.d").alias("lo"),
                           F.lit(None).cast(POINT).alias("at")))
    if not closed:
        return trie
    return _filed(reduce(DataFrame.unionByName, [*closed, open_edges]), blocks)


def build(strings: DataFrame, blocks: DataFrame) -> DataFrame:
    """The compacted trie ``(p, e, y, first, handle)`` of all strings: a row
    per edge, from point p to its node e, spelled by string y."""
    first = F.pmod(F.xxhash64("x", F.lit("batch")), F.lit(FIRST_BATCH)) == 0
    trie = insert(strings.filter(~first), insert(strings.filter(first), None, blocks), blocks)
    return strings.sparkSession.createDataFrame([], f"p {POINT}, e {POINT}, y long") if trie is None else trie


# -- numbers of every prefix ------------------------------------------------

def _subtrees(trie: DataFrame, ends: DataFrame) -> DataFrame:
    """Every node with the sums over its subtree: members, smallest member,
    leaves, ``s1`` = bytes of all members' whole paths, ``s2`` = bytes of all
    edges. Pointer doubling: after k rounds a node has summed the descendants
    less than 2**k nodes below, and knows its ancestor that far up."""
    kids = cut(trie.groupBy(F.col("p").alias("_p")).agg(F.count(F.lit(1)).alias("kids")), "children")
    v = trie.join(ends.select(F.col("end").alias("_end"), "n", "least"), F.col("e") == F.col("_end"), "left")
    v = v.join(kids, F.col("e") == F.col("_p"), "left")
    n, none = F.coalesce("n", F.lit(0)), F.col("kids").isNull()
    v = cut(v.select("p", "e", "y", F.coalesce("kids", F.lit(0)).alias("kids"), n.alias("n"), F.col("least"),
                     F.when(none, 1).otherwise(0).cast("long").alias("leaves"), (n * F.col("e.n")).alias("s1"),
                     (F.col("e.n") - F.col("p.n")).alias("s2"),
                     F.when(F.col("p.d") > 0, F.col("p")).alias("up")), "nodes")
    sums = ("n", "leaves", "s1", "s2")
    while not v.filter("up IS NOT NULL").isEmpty():
        below = cut(v.filter("up IS NOT NULL").groupBy(F.col("up").alias("_up")).agg(
            *[F.sum(c).alias(f"_{c}") for c in sums], F.min("least").alias("_least")), "below")
        far = v.select(F.col("e").alias("_e"), F.col("up").alias("_far"))
        v = (v.join(far, F.col("up") == F.col("_e"), "left").drop("_e")
             .join(below, F.col("e") == F.col("_up"), "left"))
        v = cut(v.select("p", "e", "y", "kids", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums],
                         F.least("least", "_least").alias("least"), F.col("_far").alias("up")), "nodes")
    return v.drop("up")


OUT = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
       "saved_tokens long, ends_sha256 string")
EMPTY = hashlib.sha256(b"").hexdigest()
HASHES = "d long, a long, b long, n long, sha string"


def _member_hashes(batches):
    """Sorted (end, conv_id) -> the digest of each end's ids, streamed."""
    key = digest = None
    out: list = []

    def batch():
        cols = list(zip(*out)) if out else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string()])],
                                          names=["d", "a", "b", "n", "sha"])

    for b in batches:
        for *at, conv_id in zip(*(c.to_pylist() for c in b.columns)):
            if at != key:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = at, hashlib.sha256()
                digest.update(str(conv_id).encode())
            else:
                digest.update(f",{conv_id}".encode())
        yield batch()
        out = []
    if key is not None:
        out.append((*key, digest.hexdigest()))
    yield batch()


def prefix_nodes(numbered: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations ``conv_ids`` with the
    turns ``numbered(conv_id, pos, digest, n_bytes)``: ``(conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256)``; members go by their smallest conv_id."""
    spark = numbered.sparkSession
    blocks = point_blocks(numbered)
    last = F.element_at(F.slice("items", 1, BLOCK), -1)
    members = blocks.groupBy("conv_id").agg(F.max_by(last, "blk").alias("end"))
    members = cut(conv_ids.join(members, "conv_id", "left").select("conv_id", F.coalesce("end", _root()).alias("end")),
                  "members")
    ends = cut(members.groupBy("end").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")), "ends")
    trie = build(ends.filter("end.d > 0").select(F.col("least").alias("x"), "end"), blocks)
    nodes = _subtrees(trie, ends)
    hashed = cut(members.select("end.*", "conv_id").repartition(shuffle_partitions(spark), "d", "a", "b", "n")
                 .sortWithinPartitions("d", "a", "b", "n", "conv_id").mapInArrow(_member_hashes, HASHES)
                 .select(F.struct("d", "a", "b", "n").alias("_end"), "sha"), "hashes")
    nodes = cut(nodes.join(hashed, F.col("e") == F.col("_end"), "left").drop("_end"), "nodes")
    whole = ends.agg(F.sum("n").alias("n"), F.min("least").alias("least")).first()
    below = nodes.agg(F.count_if(F.col("p.d") == 0).alias("kids"), F.count_if(F.col("kids") == 0).alias("leaves"),
                      F.sum((F.col("n") - 1) * (F.col("e.n") - F.col("p.n"))).alias("saved")).first()
    nothing = F.lit(EMPTY)
    turnless = hashed.filter("_end.d = 0").first()
    root = spark.createDataFrame([(whole["least"], 0, None, whole["n"], below["kids"], max(1, below["leaves"]),
                                   below["saved"] or 0, turnless["sha"] if turnless else EMPTY)]
                                 if whole["n"] else [], OUT)
    # one row per depth of every edge, block by block of the string that spells it
    b = blocks.select(F.col("conv_id").alias("_c"), F.col("blk").alias("_b"), F.transform(
        F.slice("items", 1, BLOCK), lambda t, i: F.struct(
            t["d"].alias("d"), F.when(i == 0, F.col("before")).otherwise(F.get("items", i - 1)["n"]).alias("n"))
        ).alias("_turns"))
    parents = nodes.select(F.col("e").alias("_e"), F.col("least").alias("_above"))
    x = nodes.join(parents, F.col("p") == F.col("_e"), "left").drop("_e")
    x = x.withColumn("blk", F.explode(F.sequence(F.shiftright(F.col("p.d"), 6), F.shiftright(F.col("e.d") - 1, 6))))
    x = (x.join(b, (F.col("y") == F.col("_c")) & (F.col("blk") == F.col("_b")))
         .withColumn("t", F.explode("_turns")).filter((F.col("t.d") > F.col("p.d")) & (F.col("t.d") <= F.col("e.d"))))
    at_node = F.col("t.d") == F.col("e.d")
    inner = F.col("s1") - F.col("e.n") * F.col("n") - F.col("s2") + F.col("e.n") - F.col("p.n")
    return root.unionByName(x.select(
        F.col("least").alias("conv_id"), F.col("t.d").alias("depth"),
        F.when(F.col("t.d") > F.col("p.d") + 1, F.col("least")).when(F.col("p.d") == 0, F.lit(whole["least"]))
        .otherwise(F.col("_above")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(at_node, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        ((F.col("n") - 1) * (F.col("e.n") - F.col("t.n")) + inner).alias("saved_tokens"),
        F.when(at_node, F.coalesce("sha", nothing)).otherwise(nothing).alias("ends_sha256")))
