"""URL filter rules behind a blocked Bloom filter.

Listed entries are canonical URLs (lower-case host, path) with a verdict; an
entry fits its host and all subdomains, and paths that start with its path.
A page's URL therefore can be hit under few keys: its host's last labels, as
many as any entry has, by the path's first characters, in the lengths that
entries have.

The filter has blocks of 256 bits; a key sets and tests 8 bits of one block,
so a probe reads one row. It is built in Spark (bit-or by block) and holds
``BITS_PER_ENTRY`` bits per entry. Possible hits go to an exact hash join
with the entries, which removes false positives; the longest entry wins
(host and path together; of equals the longer host, then the smaller).

Filter and entries are broadcast only while the entries' count keeps them
below ``BROADCAST_ENTRIES``; beyond it the same joins run without the hint.

Defined cases: null url or one without ``://``: host and path empty, no rule;
equal urls and page_ids are judged row by row; entries listed twice count
once (block before allow); no entries: every verdict is the default; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import cut

BITS_PER_ENTRY = 16
BITS = 8                 # bits of a key in its block of 256
BROADCAST_ENTRIES = 200_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _bit_columns(h: Column) -> list[Column]:
    """The four 64-bit words of a block with the bits of a key hash set."""
    second = F.xxhash64(h, F.lit("bits"))
    words = [F.lit(0).cast("long")] * 4
    for i in range(BITS):
        bit = F.shiftrightunsigned(second, 8 * i).bitwiseAND(F.lit(255))
        for w in range(4):
            one = F.when(F.shiftright(bit, 6) == w, F.call_function(
                "shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long"))
            words[w] = words[w].bitwiseOR(one)
    return words


def bloom_blocks(entries: DataFrame, n_entries: int) -> tuple[DataFrame, int]:
    """``(block, w0..w3)`` for the non-empty blocks, and the number of
    blocks."""
    blocks = max(1, -(-n_entries * BITS_PER_ENTRY // 256))
    h = F.xxhash64("host", "path")
    x = entries.select(F.pmod(h, F.lit(blocks)).alias("block"),
                       *[w.alias(f"w{i}") for i, w in enumerate(_bit_columns(h))])
    return x.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)]), blocks


def judge(pages: DataFrame, entries: DataFrame, default: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` per row of ``pages(page_id,
    url)``; ``entries(host, path, verdict)`` are the listed rules."""
    host, path = host_and_path(F.col("url"))
    rows = cut(pages.select(F.monotonically_increasing_id().alias("rid"), F.col("page_id").cast("long").alias("page_id"),
                            host.alias("host"), path.alias("path")), "urls")
    listed = cut(entries.groupBy("host", "path").agg(F.max("verdict").alias("verdict")), "entries")
    shape = listed.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.split("host", r"\."))).alias("labels"),
                       F.collect_set(F.length("path")).alias("lengths")).first()
    small = shape["n"] <= BROADCAST_ENTRIES
    hint = F.broadcast if small else (lambda df: df)
    blocks, n_blocks = bloom_blocks(listed, shape["n"])
    if not small:
        blocks = cut(blocks, "bloom")    # a popular host's probes then come from a plain shuffle, which can be split

    labels = F.least(F.size(F.split("host", r"\.")), F.lit(shape["labels"] or 1))
    lengths = F.array(*[F.lit(n) for n in sorted(shape["lengths"])]).cast("array<int>")
    keys = (rows.filter("host <> ''")
            .select("rid", "host", "path", F.explode(F.sequence(F.lit(1), labels)).alias("k"))
            .select("rid", F.expr("substring_index(host, '.', -k)").alias("host"), "path")
            .select("rid", "host", "path", F.explode(F.filter(lengths, lambda n: n <= F.length("path"))).alias("n"))
            .select("rid", "host", F.expr("substring(path, 1, n)").alias("path")))
    h = F.xxhash64("host", "path")
    probe = keys.select("*", F.pmod(h, F.lit(n_blocks)).alias("block"),
                        *[w.alias(f"p{i}") for i, w in enumerate(_bit_columns(h))])
    tested = probe.join(hint(blocks), "block")
    for i in range(4):
        tested = tested.filter(F.col(f"p{i}").bitwiseAND(F.col(f"w{i}")) == F.col(f"p{i}"))
    # the exact join: only keys that really are listed remain
    hits = tested.select("rid", "host", "path").join(hint(listed), ["host", "path"])
    rule = F.concat("host", "path")
    best = hits.groupBy("rid").agg(F.min(F.struct(-F.length(rule), -F.length("host"), rule.alias("rule"),
                                                  "verdict")).alias("b"))
    return (rows.join(best, "rid", "left")
            .select("page_id", "host", "path", F.col("b.rule").alias("rule"),
                    F.coalesce("b.verdict", F.lit(default)).alias("verdict")))
