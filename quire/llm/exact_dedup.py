"""Exact deduplication by deterministic block naming (DataFrame functions only).

Every text is cut into blocks of ``block_bytes`` bytes. All distinct blocks
are sorted, by (hash, content), and a block's place in that order is its
integer name: equal names mean equal bytes, a hash collision only adds a
place. Then adjacent names are paired, the distinct pairs sorted into new
integer names, and so on until each document has one name; with its number
of blocks it identifies the text without any chance of collision.

Only the first naming moves text, once, and copies of a block are merged on
the map side before it moves; all later rounds move integers. The number of
rounds is the logarithm of the longest text's blocks.

Defined cases: null text counts as empty, and all empty texts are equal; the
row with the largest doc_id stays (null is smallest; of repeated rows with
one doc_id exactly one stays); an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import fresh
from quire.operators.common import ordered_rank
from quire.session import cut

BLOCK_BYTES = 16384


def _with_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / F.lit(block_bytes)).cast("int"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw.alias("_raw"), n.alias("n_blocks")).withColumn(
        "blocks", F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1),
                              lambda i: F.substring("_raw", i * block_bytes + 1, F.lit(block_bytes))))


def _names(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys -> dense integer names in key order."""
    return ordered_rank(distinct, [], [F.col(k) for k in keys], out="name")


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(rid, doc_id, text_sha256, n_blocks, name)`` per row of ``docs``:
    texts are equal exactly where ``(n_blocks, name)`` are."""
    blocked = _with_blocks(docs, block_bytes)
    # the one step that moves text: distinct (hash, content), merged map-side
    contents = (blocked.select(F.explode("blocks").alias("block"))
                .select(F.xxhash64("block").alias("h"), "block").distinct())
    per_hash = cut(contents.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "block-hashes")
    collided = per_hash.filter("n > 1").select("h")
    has_collisions = not collided.isEmpty()

    keep = ["blocks"] if has_collisions else []
    rows = cut(blocked.select(F.monotonically_increasing_id().alias("rid"), "doc_id",
                              F.sha2("_raw", 256).alias("text_sha256"), "n_blocks",
                              F.transform("blocks", lambda b: F.xxhash64(b)).alias("hs"), *keep), "block-rows")
    seq = rows.select("rid", "n_blocks", F.posexplode("hs").alias("pos", "h"))
    if has_collisions:
        # blocks of different content under one hash: the content decides
        inside = (rows.select("rid", F.posexplode("blocks").alias("pos", "block"))
                  .withColumn("h", F.xxhash64("block")).join(collided, "h", "left_semi"))
        sub = (inside.select("h", "block").distinct()
               .withColumn("sub", F.row_number().over(Window.partitionBy("h").orderBy("block"))))
        placed = inside.join(sub, ["h", "block"]).select("rid", "pos", "sub")
        seq = seq.join(placed, ["rid", "pos"], "left").fillna(1, ["sub"])
        keys = per_hash.select("h", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("sub"))
        named = _names(keys, ["h", "sub"])
        seq = seq.join(named, ["h", "sub"])
    else:
        seq = seq.join(_names(per_hash.select("h"), ["h"]), "h")
    seq = seq.select("rid", "n_blocks", "pos", "name")

    longest = rows.agg(F.max("n_blocks")).first()[0] or 1
    done = seq.filter("n_blocks = 1").select("rid", "name")
    level = cut(seq.filter("n_blocks > 1").select("rid", "pos", "name"), "names") if longest > 1 else None
    while longest > 1:
        # name adjacent pairs; an unpaired last name is paired with 0
        pair = (level.groupBy("rid", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
                .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                     F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(0)).alias("b")))
        named = _names(pair.select("a", "b").distinct(), ["a", "b"])
        level = cut(pair.join(named, ["a", "b"]).select("rid", "pos", "name"), "names")
        longest = -(-longest // 2)
    if level is not None:
        done = done.unionByName(level.select("rid", "name"))
    return rows.select("rid", "doc_id", "text_sha256", "n_blocks").join(done, "rid")


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(rid, doc_id, keep_id, group_size, kept, text_sha256)``, one row per
    row of ``docs(doc_id, text)``."""
    ids = cut(identities(docs, block_bytes), "identities")
    # written: a plain shuffle of both tables is one that skew handling splits
    groups = cut(ids.groupBy("n_blocks", "name").agg(
        F.max(F.struct("doc_id", "rid")).alias("top"), F.count(F.lit(1)).alias("group_size")), "text-groups")
    return ids.join(groups, ["n_blocks", "name"]).select(
        "rid", "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size",
        (F.col("rid") == F.col("top.rid")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, all columns (as a filter stage).

    The decision joins back on (doc_id, text hash); of repeated rows with one
    doc_id and text one is returned.
    """
    ids = cut(exact_dedup(docs, block_bytes), "dedup")
    kept = ids.filter("kept").select(F.col("doc_id").alias("_k"), F.col("text_sha256").alias("_s"))
    sha = fresh(docs, "_sha")
    x = docs.withColumn(sha, F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    out = x.join(kept, x["doc_id"].cast("long").eqNullSafe(kept["_k"]) & (x[sha] == kept["_s"]), "left_semi")
    repeated = ids.groupBy("doc_id", "text_sha256").count().filter("count > 1")
    if not repeated.isEmpty():
        out = out.dropDuplicates(["doc_id", sha])
    return out.drop(sha)
