"""Record linkage: exact-id anti joins (J1), word-set similarity join
and greedy keep-first dedup inside a batch (J3).

J2 is an exact prefix-filter set-similarity join (Chaudhuri et al. 2006,
Bayardo et al. 2007, Xiao et al. 2008): order the words of every set alike;
any pair with Jaccard >= t shares one of the first ``n - ceil(t*n) + 1`` words
of each set and has ``min(n1, n2) >= t * max(n1, n2)``. Candidates come from an
equi-join on prefix words and are verified exactly; nothing is sampled or
capped. Any total order is exact; a good one puts frequent words last. Word
hashes are counted in a fixed number of slots (``word_table``), and words are
ordered by (frequency class of their slot, hash) inside each row, so no word
is ever shuffled to learn its frequency.

A group of sets that share a prefix word is compared pair by pair only where
the probing or the held side is small, so that the work is linear in the
group. A large group first tries one held set on every probe (``search``); the
probes left over are told apart by a second shared word, then a third (any
pair that shares k words has its k smallest ones in the first
``n - ceil(t*n) + k`` of both), until the groups are small.

J3 (keep a row unless an *accepted* earlier row matches it) runs in rounds. A
round searches each undecided row's earlier matches: all of them in small
groups, one in large groups. Rows whose matches are all known are then decided
along the links found, however long their chains are; a row that a large
group's first holder blocks waits for the next round. Each round decides at
least the first undecided row.
"""

from __future__ import annotations

import functools
import os
from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text
from quire.session import cut, drop_cuts, shuffles_go

def _dec(t) -> Column:
    d = Decimal(str(t))
    return F.lit(d)


def prefix_length(n: Column, threshold) -> Column:
    """``n - ceil(t * n) + 1`` with exact decimal arithmetic (a float product
    just above an integer would shorten the prefix and lose pairs)."""
    return (n - F.ceil(_dec(threshold) * n) + 1).cast("int")


def size_bucket(n: Column, threshold) -> Column:
    """Geometric size bucket: sets with ``min(n1,n2) >= t*max(n1,n2)`` fall
    in buckets at most 1 apart in exact arithmetic; see ``bucket_reach`` for
    how far callers look."""
    import math

    step = math.log(1.0 / float(threshold))
    return F.floor(F.log(n.cast("double")) / F.lit(step)).cast("int")


#: a group is compared pair by pair if one side has at most so many sets
SMALL_GROUP = 16
#: shared words after which a group is compared pair by pair whatever its size
LEVELS = 6
#: slots of the word frequency table, one byte each
SLOTS = 1 << 18
#: longs of a set's signature, and of that of a set of ``WIDE_FROM`` words or more
LANES = 8
WIDE_LANES = 32
WIDE_FROM = 1000
#: longs of a signature that go with every prefix word
MARKS = [f"m{k}" for k in range(4)]
#: so many pairs are sent to every task, which spares moving the words of all sets
FEW_PAIRS = 100_000
#: what joins the words of a set to one string where they move; no word has it
SEPARATOR = "\x1f"
#: a join of all sets takes the words in one more turn for so many sets, in ``MOST_TURNS`` at most
TURN_SETS = 50_000
MOST_TURNS = 4


def _dealt(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: both sides are dealt by the
    key. Left to its estimate, Spark takes a written table of row ids for small
    (they compress well) and sends it whole through the driver, many a round."""
    return df.hint("merge")


def bucket_reach(strict: bool) -> int:
    """Buckets to look either way. With a strict threshold a similar pair
    has size ratio strictly above t (by at least 1/n), so its buckets are at
    most 1 apart even after float rounding; only pairs exactly at t sit on
    the edge, and those are matches only in the inclusive (>=) form."""
    return 1 if strict else 2


def _near_buckets(b: Column, reach: int = 2) -> Column:
    return F.explode(F.sequence(b - reach, b + reach))


def slot(word: Column, slots: int) -> Column:
    """Slot of a word in a frequency table of so many."""
    return F.pmod(F.xxhash64(word), F.lit(slots))


def word_table(*sets: DataFrame) -> bytes:
    """Frequency class (eighths of a power of two) of every slot of word
    hashes over the ``(rid, words)`` frames: ``SLOTS`` bytes, whatever the
    number of words. Counted map-side; only slot counts move."""
    u = functools.reduce(DataFrame.unionByName, [s.select(F.explode("words").alias("w")) for s in sets])
    counts = u.groupBy(slot(F.col("w"), SLOTS).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    cls = F.least(F.lit(255), 1 + F.floor(4 * F.log2("n"))).cast("int").alias("cls")
    counts = counts.select("slot", cls)                     # at most SLOTS rows
    with shuffles_go(counts.sparkSession):
        found = counts.select("*").toArrow()
    table = np.zeros(SLOTS, np.uint8)
    table[found.column("slot").to_numpy()] = found.column("cls").to_numpy()
    return table.tobytes()


def signature(hashes: Column) -> Column:
    """Longs of word parities, more of them for a large set, which would fill
    a few: a word flips one bit. Two sets differ in at least as many words as
    their signatures do in bits."""
    def longs(lanes):
        def lane(k):
            return lambda acc, h: acc.bitwiseXOR(F.when(
                F.shiftright(h, 6).bitwiseAND(lanes - 1) == k,
                F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")))
                .otherwise(F.lit(0).cast("long")))

        return F.array(*[F.aggregate(hashes, F.lit(0).cast("long"), lane(k)) for k in range(lanes)])

    return F.when(F.size(hashes) < WIDE_FROM, longs(LANES)).otherwise(longs(WIDE_LANES))


def _folded(sig: Column, lanes: int, of: int) -> Column:
    """A signature of ``of`` longs in ``lanes`` ones: their bits in pairs, as
    if it had been made so."""
    return F.array(*[functools.reduce(lambda a, b: a.bitwiseXOR(b), [F.get(sig, k) for k in range(j, of, lanes)])
                     for j in range(lanes)])


def _differing_bits(l_sig: Column, r_sig: Column) -> Column:
    """Bits in which two signatures differ, in the length of the shorter one."""
    def short(sig):
        return F.when(F.size(sig) == LANES, sig).otherwise(_folded(sig, LANES, WIDE_LANES))

    def apart(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)

    return (F.when((F.size(l_sig) == WIDE_LANES) & (F.size(r_sig) == WIDE_LANES), apart(l_sig, r_sig))
            .otherwise(apart(short(l_sig), short(r_sig))))


def _room(n: Column, apart: Column, threshold) -> Column:
    """Sets of ``n`` words together, ``apart`` of them at least in one only,
    may still be similar."""
    return n - apart >= _dec(threshold) * (n + apart)


def prefix_rows(sets: DataFrame, table: bytes, threshold, more: int = 0) -> DataFrame:
    """``(rid, n, p, bucket, tokens, sig)`` for every non-empty set: the hashes of
    its first words in the common order, of which the first ``p`` are the
    prefix and up to ``more`` further ones follow. A set too small for any
    inexact match has one token, all its words: short titles that merely share
    a word never meet."""
    freq = F.lit(bytearray(table))
    n = F.size("words")
    ordered = F.sort_array(F.transform("words", lambda w: F.struct(
        F.substr(freq, (slot(w, len(table)) + 1).cast("int"), F.lit(1)).alias("f"), F.xxhash64(w).alias("h"), w.alias("w"))))
    whole = F.xxhash64(F.lit("="), F.array_join(F.sort_array("words"), " "))
    small = n < only_equal_below(threshold)
    p = F.when(small, 1).otherwise(prefix_length(n, threshold))
    tokens = F.when(small, F.array(whole)).otherwise(
        F.transform(F.slice(ordered, F.lit(1), prefix_length(n, threshold) + more), lambda x: x["h"]))
    return (sets.filter(n > 0).select("rid", n.alias("n"), p.cast("int").alias("p"),
                                      size_bucket(n, threshold).alias("bucket"), tokens.alias("tokens"),
                                      signature(F.transform("words", lambda w: F.xxhash64(w))).alias("sig")))


def entries(rows: DataFrame) -> DataFrame:
    """``(rid, n, p, bucket, m0.., key, pos)``: one row per prefix word, with
    the set's signature folded to a few longs."""
    mark = F.when(F.size("sig") == LANES, _folded(F.col("sig"), len(MARKS), LANES)).otherwise(
        _folded(F.col("sig"), len(MARKS), WIDE_LANES))
    rows = rows.withColumn("_mark", mark)
    return rows.select("rid", "n", "p", "bucket", *[F.get("_mark", k).alias(m) for k, m in enumerate(MARKS)],
                       F.posexplode(F.slice("tokens", F.lit(1), F.col("p"))).alias("pos", "key")
                       ).withColumn("pos", F.col("pos") + 1)


def near_entries(rows: DataFrame, strict: bool = True) -> DataFrame:
    """As ``entries``, once for every size bucket a match may be in."""
    return entries(rows).withColumn("bucket", _near_buckets(F.col("bucket"), bucket_reach(strict)))


def _longer(shared: DataFrame, rows: DataFrame, level: int) -> DataFrame:
    """Entries with one more shared word, at a later place than their last."""
    e = shared.join(_dealt(rows.select("rid", "tokens")), "rid")
    end = F.least(F.col("p") + (level - 1), F.size("tokens"))
    e = e.filter(F.col("pos") < end).withColumn("at", F.explode(F.sequence(F.col("pos") + 1, end)))
    return e.select("rid", "n", "p", "bucket", *MARKS, F.xxhash64("key", F.get("tokens", F.col("at") - 1)).alias("key"),
                    F.col("at").alias("pos"))


def can_match(threshold) -> Column:
    """Sizes and places of the shared word leave room for enough overlap."""
    t = _dec(threshold)
    most = F.least("l_pos", "r_pos") + F.least(F.col("l_n") - F.col("l_pos"), F.col("r_n") - F.col("r_pos"))
    return ((F.least("l_n", "r_n") >= t * F.greatest("l_n", "r_n"))
            & (most * (1 + t) >= t * (F.col("l_n") + F.col("r_n"))))


def worth_a_look(threshold) -> Column:
    """``can_match``, and the folded signatures do not differ too much: most
    pairs that merely share a word end where they meet."""
    apart = functools.reduce(lambda a, b: a + b, [F.bit_count(F.col(f"l_{m}").bitwiseXOR(F.col(f"r_{m}"))) for m in MARKS])
    return can_match(threshold) & _room(F.col("l_n") + F.col("r_n"), apart, threshold)


def only_equal_below(threshold) -> int:
    """Sets of fewer words than this can only match an equal set: one word
    more or less already falls below the threshold (n / (n + 1) < t)."""
    t = Decimal(str(threshold))
    return int((t / (1 - t)).to_integral_value(rounding="ROUND_CEILING")) if t < 1 else 1 << 30


def _with_ends(pairs: DataFrame, left: DataFrame, right: DataFrame, *cols: str) -> DataFrame:
    """Written pairs with columns of the sets at both ends. At most
    ``FEW_PAIRS`` go to the sets; more meet them by shuffles."""
    send = F.broadcast if pairs.count() <= FEW_PAIRS else _dealt
    ends = _ends(pairs, right, "r", cols, send)
    return _part(left, "l", cols).join(send(pairs), "l_rid").join(_dealt(ends), "r_rid")


def _part(sets: DataFrame, side: str, cols) -> DataFrame:
    return sets.select(*[F.col(c).alias(f"{side}_{c}") for c in ("rid", *cols)])


def _ends(pairs: DataFrame, sets: DataFrame, side: str, cols, send) -> DataFrame:
    """The sets at one end of the pairs."""
    return _part(sets, side, cols).join(send(pairs.select(f"{side}_rid").distinct()), f"{side}_rid", "left_semi")


def _with_words(pairs: DataFrame, left: DataFrame, right: DataFrame, scope: list) -> DataFrame:
    """Written pairs with the size and the words of the sets at both ends. The
    words move as one string, a third of what an array of them takes. Of more
    than ``FEW_PAIRS``, the sets that occur in a pair are written first, those of
    either end by themselves: their words alone move on, and what moved all
    words is gone by then."""
    left, right = (s.select("rid", F.size("words").alias("n"), F.array_join("words", SEPARATOR).alias("words")) for s in (left, right))
    cols = ("n", "words")
    if pairs.count() <= FEW_PAIRS:
        p = _with_ends(pairs, left, right, *cols)
    else:
        l, r = (cut(_ends(pairs, s, side, cols, _dealt), f"{side}-ends", scope) for s, side in ((left, "l"), (right, "r")))
        p = l.join(_dealt(pairs), "l_rid").join(_dealt(r), "r_rid")
    return p.withColumns({f"{side}_words": F.split(f"{side}_words", SEPARATOR) for side in "lr"})


def _verify(pairs: DataFrame, left: DataFrame, right: DataFrame, left_rows: DataFrame, right_rows: DataFrame,
            threshold, strict: bool, scope: list | None = None) -> DataFrame:
    """Pairs whose sets are similar. The signatures, a few numbers a set, rule
    out most pairs; what is left is compared word by word. Both lists of pairs
    are written and counted."""
    p = _with_ends(cut(pairs, "pairs", scope), left_rows, right_rows, "n", "sig")
    p = cut(p.filter(_room(F.col("l_n") + F.col("r_n"), _differing_bits(F.col("l_sig"), F.col("r_sig")), threshold))
            .select("l_rid", "r_rid"), "alike", scope)
    p = _with_words(p, left, right, scope)
    inter = F.size(F.array_intersect("l_words", "r_words"))
    # float division compares like the reference: 17/20 equals the literal 0.85
    p = p.withColumn("similarity", inter.cast("double") / (F.col("l_n") + F.col("r_n") - inter).cast("double"))
    cond = F.col("similarity") > float(threshold) if strict else F.col("similarity") >= float(threshold)
    return p.filter(cond).select("l_rid", "r_rid", "similarity")


def _side(rows: DataFrame, side: str, *more: str) -> DataFrame:
    return rows.select("key", "bucket", *[F.col(c).alias(f"{side}_{c}") for c in ("rid", "n", "pos", *MARKS, *more)])


def similar_pairs(left: DataFrame, right: DataFrame | None, threshold="0.85", strict: bool = True,
                  only: DataFrame | None = None, only_right: DataFrame | None = None) -> DataFrame:
    """All pairs ``(l_rid, r_rid, similarity)`` with word-set Jaccard
    above (``strict``) or at least ``threshold``.

    ``left``/``right`` have ``rid`` and ``words`` (distinct words; empty sets
    never match). With ``right=None`` it is a self join and only pairs with
    ``l_rid < r_rid`` are returned. ``only`` (and ``only_right``) names the
    ``rid`` that take part.
    """
    self_join = right is None
    right, only_right = (left, only) if self_join else (right, only_right)
    table = word_table(left) if self_join else word_table(left, right)

    def rows(sets, named):
        found = prefix_rows(sets, table, threshold)
        return cut(found if named is None else found.join(_dealt(named.select("rid")), "rid"), "prefix-rows")

    # equi-join on (word, size bucket): one side visits its neighbouring
    # buckets, so a frequent prefix word only pairs sets of similar size; in a
    # self join the set in the lower bucket visits the other one
    left_rows = rows(left, only)
    right_rows = left_rows if self_join else rows(right, only_right)
    own, reach = F.col("own"), bucket_reach(strict)
    near = entries(left_rows).withColumnRenamed("bucket", "own").withColumn("bucket", F.explode(
        F.sequence(own if self_join else own - reach, own + reach))).withColumn("here", F.col("bucket") == own)
    lp, rp = _side(near, "l", "here"), _side(entries(right_rows), "r")
    # the words take turns: the entries of one turn are on disk at a time
    turns, scope = min(MOST_TURNS, 1 + max(left_rows.count(), right_rows.count()) // TURN_SETS), []

    def meet(turn):
        l, r = (e.filter(F.pmod("key", F.lit(turns)) == turn) for e in (lp, rp))
        cand = l.join(_dealt(r), ["key", "bucket"]).filter(worth_a_look(threshold))
        if self_join:
            cand = cand.filter(~F.col("l_here") | (F.col("l_rid") < F.col("r_rid"))).select(
                F.least("l_rid", "r_rid").alias("l_rid"), F.greatest("l_rid", "r_rid").alias("r_rid"))
        return cand.select("l_rid", "r_rid").distinct()

    cand = meet(0) if turns == 1 else functools.reduce(
        DataFrame.unionByName, [cut(meet(turn), "turn", scope) for turn in range(turns)]).distinct()
    # the candidates are written again before this returns
    found = _verify(cand, left, right, left_rows, right_rows, threshold, strict)
    drop_cuts(left.sparkSession, scope)
    return found


def _meet(probing: DataFrame, held: DataFrame, *keys: str) -> DataFrame:
    """Join on a hash of the keys: dealt anew, the rows of both sides come
    straight from a shuffle, which Spark's skew handling needs to split a hot
    group. Pairs that only share the hash are left to the exact check."""
    h = F.xxhash64(*keys)
    return probing.withColumn("_h", h).drop(*keys).join(_dealt(held.withColumn("_h", h).drop(*keys)), "_h").drop("_h")


def search(probes: DataFrame, held: DataFrame, probe_rows: DataFrame, held_rows: DataFrame, probe_words: DataFrame,
           held_words: DataFrame, threshold, strict: bool, earlier: bool, scope: list | None = None,
           on_candidates=None) -> tuple[DataFrame, DataFrame]:
    """Matches ``(l_rid, r_rid)`` of held set l and probe r, among the row
    ids ``probes`` and ``held`` of the prefix rows; with ``earlier`` only
    l < r. Returns the matches found in small groups and those with the one
    held set that a large group tries. A probe without any match in the second
    table has all its matches in the first; else it may have more. Without
    ``earlier`` one match is enough for a probe, it is searched no further."""
    pe = entries(probe_rows.join(_dealt(probes), "rid", "left_semi"))
    he = entries(held_rows.join(_dealt(held), "rid", "left_semi"))
    found, tried, level = [], [], 1
    while True:
        near = _side(pe.withColumn("bucket", _near_buckets(F.col("bucket"), bucket_reach(strict))), "r")
        # the first held set decides most in a batch; any other one will do
        one = F.min("rid") if earlier else F.min_by("rid", F.xxhash64("rid", "key"))
        # written, so that hot groups meet it by plain shuffles that can be split
        groups = cut(near.groupBy("key", "bucket").agg(F.count(F.lit(1)).alias("probing")).join(
            _dealt(he.groupBy("key", "bucket").agg(F.count(F.lit(1)).alias("holding"), one.alias("one"))), ["key", "bucket"])
            .withColumn("small", (F.least("probing", "holding") <= SMALL_GROUP) | F.lit(level >= LEVELS)), "groups", scope)
        small, large = _dealt(groups.filter("small").select("key", "bucket")), groups.filter("NOT small")
        cand = _meet(near.join(small, ["key", "bucket"]), _side(he, "l"), "key", "bucket").filter(worth_a_look(threshold))
        cand = (cand.filter(F.col("l_rid") < F.col("r_rid")) if earlier else cand).select("l_rid", "r_rid").distinct()
        found.append(cut(_verify(cand, held_words, probe_words, held_rows, probe_rows, threshold, strict, scope).select("l_rid", "r_rid"),
                         "matches", scope))
        if on_candidates is not None:
            on_candidates(cand.count())
        if large.isEmpty():
            break
        cand = near.join(_dealt(large), ["key", "bucket"]).select(F.col("one").alias("l_rid"), "r_rid")
        cand = (cand.filter(F.col("l_rid") < F.col("r_rid")) if earlier else cand).distinct()
        hit = cut(_verify(cand, held_words, probe_words, held_rows, probe_rows, threshold, strict, scope).select("l_rid", "r_rid"), "tried", scope)
        tried.append(hit)
        if on_candidates is not None:
            on_candidates(cand.count())
        done = hit.select(F.col("r_rid").alias("rid"))
        if not earlier:
            done = done.unionByName(found[-1].select(F.col("r_rid").alias("rid")))
        keys = _dealt(large.select("key", "bucket"))
        still = (pe.withColumn("own", F.col("bucket")).withColumn("bucket", _near_buckets(F.col("own"), bucket_reach(strict)))
                 .join(keys, ["key", "bucket"], "left_semi").drop("bucket").withColumnRenamed("own", "bucket").distinct()
                 .join(_dealt(done.distinct()), "rid", "left_anti"))
        level += 1
        pe = cut(_longer(still, probe_rows, level), "probes", scope)
        he = cut(_longer(he.join(keys, ["key", "bucket"], "left_semi"), held_rows, level), "held", scope)
    union = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    return union(found), union(tried) if tried else found[0].limit(0)


def distinct_sets(rows: DataFrame, name: str = "sets", scope: list | None = None,
                  written: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Collapse identical non-empty word sets: ``sets(rid, words)`` of all
    rows, ``names(rid, members)`` of one row per distinct set, its smallest,
    and ``members(rid, sid)``, each row with the row that stands for its set.

    A group of identical copies, however large, becomes one set with a
    member count, so no later join ever pairs the copies with each other.
    Sets are equal where the SHA-256 of their words is; the words themselves
    are written once and not moved, not at all where ``rows`` read a table that
    is ``written`` already.
    """
    # written before any filter: the words may come from whole texts, and a
    # filter on them would make them twice
    d = rows.select("rid", "words") if written else cut(rows.select("rid", "words"), f"{name}-rows", scope)
    d = d.filter(F.size("words") > 0)
    members = cut(d.select("rid", F.sha2(F.array_join(F.sort_array("words"), " "), 256).alias("_sha")), f"{name}-hashes", scope)
    names = cut(members.groupBy("_sha").agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("members")), name, scope)
    return (d, names.select("rid", "members"),
            members.join(_dealt(names.select("_sha", F.col("rid").alias("sid"))), "_sha").select("rid", "sid"))


def similar_to_any(left: DataFrame, right: DataFrame, threshold="0.85", strict: bool = True,
                   on_candidates=None, written: bool = False) -> DataFrame:
    """Semi-join form of J2: ``rid`` of ``left`` rows with at least one
    ``right`` row above the threshold. Identical sets are collapsed on both
    sides first, and one match ends the search for a set, so neither copies
    nor near copies multiply the candidate pairs. ``written`` says that ``left``
    reads a written table. The tables of the search go once the answer is
    written."""
    scope: list = []
    ls, ln, lm = distinct_sets(left, "left-sets", scope, written)
    rs, rn, _ = distinct_sets(right, "right-sets", scope)
    table = word_table(ls, rs)
    lp = cut(prefix_rows(ls, table, threshold, LEVELS).join(_dealt(ln.select("rid")), "rid"), "left-prefixes", scope)
    rp = cut(prefix_rows(rs, table, threshold, LEVELS).join(_dealt(rn.select("rid")), "rid"), "right-prefixes", scope)
    found, tried = search(ln.select("rid"), rn.select("rid"), lp, rp, ls, rs, threshold, strict, False, scope,
                          on_candidates=on_candidates)
    sids = found.unionByName(tried).select(F.col("r_rid").alias("sid")).distinct()
    result = cut(lm.join(_dealt(sids), "sid", "left_semi").select("rid"), "similar")
    drop_cuts(left.sparkSession, scope)
    return result


def similar_counts(rows: DataFrame, threshold="0.85", strict: bool = True) -> DataFrame:
    """J2 as a per-row answer: ``(rid, n_similar)`` = number of *other* rows
    whose word set is above the threshold. Computed on distinct sets
    (copies counted through member counts), never by listing pairs of
    copies."""
    rows = cut(rows.select("rid", "words"), "count-rows")
    sets, names, members = distinct_sets(rows, "count-sets", written=True)
    pairs = similar_pairs(sets, None, threshold, strict, only=names)
    m = names
    ends = [F.struct(F.col(a).alias("sid"), F.col(b).alias("other")) for a, b in
            (("l_rid", "r_rid"), ("r_rid", "l_rid"))]
    both = pairs.select(F.explode(F.array(*ends)).alias("p")).select("p.*")
    nb = (both.join(_dealt(m.withColumnRenamed("rid", "other")), "other")
          .groupBy("sid").agg(F.sum("members").alias("from_others")))
    # an identical copy is similar (J = 1) unless the set is empty
    per_set = m.withColumnRenamed("rid", "sid").join(_dealt(nb), "sid", "left").select(
        "sid", (F.col("members") - 1 + F.coalesce("from_others", F.lit(0))).cast("bigint").alias("n_similar"))
    out = members.join(_dealt(per_set), "sid").select("rid", "n_similar")
    empty = rows.filter(F.size("words") == 0).select("rid", F.lit(0).cast("bigint").alias("n_similar"))
    return out.unionByName(empty)


def exact_key_rows(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Melt ``rid`` + key expressions into ``(rid, kind, key)`` rows, empty
    keys dropped."""
    parts = [F.struct(F.lit(k).alias("kind"), v.cast("string").alias("key")) for k, v in keys.items()]
    return (df.select("rid", F.explode(F.array(*parts)).alias("kk"))
            .select("rid", "kk.kind", "kk.key")
            .filter(F.col("key").isNotNull() & (F.col("key") != "")))


def anti_by_keys(batch_keys: DataFrame, index_keys: DataFrame) -> DataFrame:
    """``rid`` of batch rows that share any (kind, key) with the index."""
    return batch_keys.join(index_keys.select("kind", "key"), ["kind", "key"], "left_semi").select("rid").distinct()


def _shared_keys(keys: DataFrame, undecided: DataFrame, held: DataFrame, scope: list) -> tuple[DataFrame, DataFrame]:
    """As ``search``, for shared exact keys: a shared key is a match."""
    p, h = keys.join(_dealt(undecided), "rid", "left_semi"), keys.join(_dealt(held), "rid", "left_semi")
    groups = cut(p.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("probing")).join(
        _dealt(h.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("holding"), F.min("rid").alias("one"))), ["kind", "key"])
        .filter("holding > 1").withColumn("small", F.least("probing", "holding") <= SMALL_GROUP), "key-groups", scope)
    p = p.withColumnRenamed("rid", "r_rid")
    h = h.select(F.col("rid").alias("l_rid"), F.col("kind").alias("l_kind"), F.col("key").alias("l_key"), "kind", "key")
    own = [F.col("kind").alias("r_kind"), F.col("key").alias("r_key")]
    found = _meet(p.select("*", *own).join(_dealt(groups.filter("small").select("kind", "key")), ["kind", "key"]), h, "kind", "key") \
        .filter("l_kind = r_kind AND l_key = r_key")
    tried = p.join(_dealt(groups.filter("NOT small")), ["kind", "key"]).withColumn("l_rid", F.col("one"))
    return tuple(x.filter("l_rid < r_rid").select("l_rid", "r_rid").distinct() for x in (found, tried))


def greedy_keep_first(rows: DataFrame, keys: DataFrame, threshold="0.85", strict: bool = True,
                      max_rounds: int | None = None, on_round=None, written: bool = False) -> DataFrame:
    """The rows kept by "walk in priority order; drop a row if an
    already *kept* row matches it".

    ``rows``: ``rid`` (priority; smaller wins, unique), ``words``; ``written``
    says that they read a written table.
    ``keys``: ``(rid, kind, key)`` exact keys (a shared key is a match).
    A match is a shared key or word-set Jaccard above ``threshold``.
    Returns ``(rid, kept)`` for every row. Each round cuts lineage by
    writing its small state tables under the session's checkpoint directory.
    """
    spark = rows.sparkSession
    scope: list = []   # per-round tables, deleted once the answer is written
    words = rows.select("rid", "words") if written else cut(rows.select("rid", "words"), "words", scope)
    prefixes = cut(prefix_rows(words, word_table(words), threshold, LEVELS), "prefix", scope)
    keys = cut(keys.select("rid", "kind", "key"), "keys", scope)
    undecided = cut(rows.select("rid"), "undecided", scope)
    seen = undecided.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rid").alias("d")).first()
    if seen["n"] != seen["d"]:
        raise ValueError("greedy dedup needs a unique, non-null rid in every row")
    n_left, rounds = seen["n"], 0
    kept = undecided.limit(0)
    decided: DataFrame | None = None
    while n_left:
        rounds += 1
        if max_rounds is not None and rounds > max_rounds:
            raise RuntimeError(f"greedy dedup did not finish in {max_rounds} rounds")
        if on_round is not None:
            on_round(rounds, n_left)
        elif os.environ.get("QUIRE_TRACE"):
            print(f"greedy round {rounds}: {n_left} undecided", flush=True)
        held = undecided.unionByName(kept)
        found, tried = search(undecided, held, prefixes, prefixes, words, words, threshold, strict, True, scope)
        same, first = _shared_keys(keys, undecided, held, scope)
        waits = tried.unionByName(first).select(F.col("r_rid").alias("rid"), F.lit(True).alias("waits")).distinct()
        links = cut(found.unionByName(tried).unionByName(same).unionByName(first).distinct(), "links", scope)
        state = cut(undecided.join(_dealt(waits), "rid", "left").select("rid", F.coalesce("waits", F.lit(False)).alias("waits"),
                                                                F.lit("U").alias("st"))
                    .unionByName(kept.select("rid", F.lit(False).alias("waits"), F.lit("A").alias("st"))), "state", scope)
        left, before = n_left, None
        while left and left != before:
            # a row goes with an accepted earlier match; it stays once all its
            # earlier matches have gone
            above = (links.join(_dealt(state.select(F.col("rid").alias("l_rid"), "st")), "l_rid")
                     .groupBy(F.col("r_rid").alias("rid"))
                     .agg(F.max(F.col("st") == "A").alias("gone"), F.max(F.col("st") == "U").alias("open")))
            st = (F.when(F.col("st") != "U", F.col("st")).when(F.col("gone"), F.lit("D"))
                  .when(F.col("open") | F.col("waits"), F.lit("U")).otherwise(F.lit("A")))
            state = cut(state.join(_dealt(above), "rid", "left").select("rid", "waits", st.alias("st")), "state", scope)
            before, left = left, state.filter("st = 'U'").count()
        if left == n_left:
            raise RuntimeError(f"greedy dedup decided none of {n_left} rows in a round")
        step = state.join(_dealt(undecided), "rid", "left_semi").filter("st <> 'U'").select("rid", (F.col("st") == "A").alias("kept"))
        decided = step if decided is None else decided.unionByName(step)
        kept = state.filter("st = 'A'").select("rid")
        undecided, n_left = state.filter("st = 'U'").select("rid"), left
    if decided is None:
        drop_cuts(spark, scope)
        return spark.createDataFrame([], "rid bigint, kept boolean")
    result = cut(decided, "kept")
    drop_cuts(spark, scope)
    return result


def title_keys(df: DataFrame, title: str = "title") -> DataFrame:
    """Helper: add ``norm`` (H1) and ``words`` (H2) columns."""
    return (df.withColumn("norm", text.normalize_title(title))
            .withColumn("words", text.word_set(title)))
