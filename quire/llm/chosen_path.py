"""Similarity self-join on word shingles by chosen paths (Christiani, Pagh and
Sivertsen 2018): sets are split recursively on sampled shared tokens, small
buckets are compared directly, and independent runs bring the recall up.

* A set is its text's shingles of ``width`` words (lower case, runs of letters
  and digits), kept here as ``POSITIONS`` min-hashes: two sets agree in a
  position with probability equal to their Jaccard similarity.
* Each run samples positions (``BRANCH`` on average); every sampled position
  sends a set to the bucket of its value there. A bucket with more than
  ``LEAF`` sets is split again by positions sampled from the bucket's own key,
  down to ``DEPTH`` levels.
* In a bucket of at most ``LEAF`` sets all pairs of sketches are compared; a
  bucket still larger after ``DEPTH`` splits holds sets agreeing in that many
  random positions and is passed on whole.
* What buckets connect forms a group of candidates. Every group is verified
  exactly, each pair once, on the full shingle sets: groups are cut into tiles
  of ``TILE`` x ``TILE`` sets, intersection sizes are one matrix product, and a
  tile returns one row per set (links counted, smallest linked set), never
  pairs. A large group is thus spread over many tasks, and a path missed by
  all runs loses nothing while both sets are in one group.

With 12 runs of 1.5 positions a pair at similarity 0.8 shares no bucket with
probability exp(-14); if all its buckets are over-full and split to the last
level, with less than 0.001.

Sets that are equal are one set with a number of copies before anything else.
All links between different sets are found within the recall above, and
counted; copies are never expanded into pairs.

Defined cases: null text counts as empty; a text of fewer than ``width`` words
is one shingle of all its words; a text without words equals only itself
(copies of it are one class); repeated rows are copies; equal doc_ids are
separate rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.components import connected_components
from quire.llm.shared import fresh, shuffle_partitions
from quire.session import cut

WIDTH = 5
THRESHOLD = 0.8
POSITIONS = 64
RUNS = 12
BRANCH = 1.5
LEAF = 64
DEPTH = 4
SLACK = 0.22      # a sketch estimate this far below the threshold still passes
TILE = 128
SEED = 20160

_U = np.uint64


def word_hashes(col: Column) -> Column:
    """Hashes of the words of a text, in order (JVM side)."""
    words = F.split(F.lower(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingles(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a sequence of word hashes."""
    w = words.view(_U) if words.dtype == np.int64 else words.astype(_U)
    n = len(w)
    if n == 0:
        return np.zeros(0, _U)
    k = min(width, n)
    g = np.full(n - k + 1, 7 + k, _U)
    with np.errstate(over="ignore"):
        for i in range(k):
            g = (g ^ w[i:n - k + 1 + i]) * _U(0x9E3779B97F4A7C15)
            g ^= g >> _U(29)
    return np.unique(g)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _multipliers() -> np.ndarray:
    return _mix(np.arange(1, POSITIONS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(SEED)) | _U(1)


def sketch(s: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """Min-hash values (uint32) of a shingle set in every position."""
    out = np.full(POSITIONS, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 2048):
            v = (s[None, at:at + 2048] * mult[:, None]) >> _U(32)
            np.minimum(out, v.min(axis=1).astype(np.uint32), out=out)
    return out


def _arrays(column) -> list[np.ndarray]:
    """Rows of an Arrow list<long> column as numpy views."""
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offs = col.offsets.to_numpy()
    flat = col.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(offs[:-1], offs[1:])]


def _signatures(width: int):
    def run(batches):
        import hashlib

        mult = _multipliers()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys, sizes, sketches = [], [], []
                for words, sha in zip(_arrays(part.column(2)), part.column(1).to_pylist()):
                    s = shingles(words, width)
                    # without shingles only the very same text is equal
                    keys.append(hashlib.blake2b(s.tobytes() if len(s) else b"text" + sha, digest_size=16).digest())
                    sizes.append(len(s))
                    sketches.append(sketch(s, mult).tobytes() if len(s) else b"")
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()),
                     pa.array(sketches, pa.binary())], names=["doc_id", "sha", "skey", "n", "sketch"])

    return run


def _sampled(keys: np.ndarray) -> np.ndarray:
    """(rows, POSITIONS) mask: positions that the node of each key samples."""
    with np.errstate(over="ignore"):
        x = _mix(keys[:, None] ^ (np.arange(1, POSITIONS + 1, dtype=_U) * _U(0xD1B54A32D192ED03))[None, :])
    return x < _U(int(BRANCH / POSITIONS * 2**64))


def _children(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and child keys of rows in nodes ``keys``."""
    row, pos = np.nonzero(_sampled(keys))
    with np.errstate(over="ignore"):
        child = _mix(_mix(keys[row] + _U(0x632BE59BD9B4E019) * (pos + 1).astype(_U)) ^ values[row, pos].astype(_U))
    return row, child


def _values(column) -> np.ndarray:
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    raw = b"".join(col.to_pylist())
    return np.frombuffer(raw, "<u4").reshape(-1, POSITIONS)


def _node_rows(node: np.ndarray, sid: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(sid)], names=["node", "sid"])


def _roots(runs: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sid, values = part.column(0).to_numpy(), _values(part.column(1))
                for r in range(runs):
                    keys = np.full(len(sid), _mix(np.array([SEED + 1000 * r + 1], _U))[0], _U)
                    row, child = _children(keys, values)
                    yield _node_rows(child, sid[row])

    return run


def _split(batches):
    """Rows (node, sid, sketch) of over-full nodes -> rows of their children."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            row, child = _children(part.column(0).to_numpy().view(_U), _values(part.column(2)))
            yield _node_rows(child, part.column(1).to_numpy()[row])


def _union_roots(ids: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Smallest id connected to each id by the boolean matrix ``linked``."""
    root = np.asarray(ids).copy()
    while True:
        nxt = np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        nxt = np.minimum(root, nxt)
        if (nxt == root).all():
            return root
        root = nxt


def _groups(batches, n_keys: int):
    """Consecutive rows with equal first ``n_keys`` columns, across batches
    (the input is sorted by them)."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        bounds = [0, *np.nonzero(change)[0].tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            k = tuple(c[a] for c in cols)
            if k != key:
                if held:
                    yield key, held
                held, key = [], k
            held.append(batch.slice(a, b - a))
    if held:
        yield key, held


def _leaves(threshold: float):
    """Rows (node, sid, sketch bytes) sorted by node -> links (a, b) along
    one tree per connected part of the node."""
    def run(batches):
        least = int(np.ceil((threshold - SLACK) * POSITIONS))
        a, b = [], []
        for _, parts in _groups(batches, 1):
            sid = np.concatenate([p.column(1).to_numpy() for p in parts])
            if len(sid) > 1:
                x = np.frombuffer(b"".join(v for p in parts for v in p.column(2).to_pylist()),
                                  np.uint8).reshape(len(sid), POSITIONS)
                near = (x[:, None, :] == x[None, :, :]).sum(axis=2) >= least
                root = _union_roots(sid, near)
                far = root != sid
                a += root[far].tolist()
                b += sid[far].tolist()
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, as products of 0/1 matrices over
    the shingles that occur twice or more."""
    n = len(sets)
    out = np.zeros((n, n), np.float32)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, col, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[col] > 1
    place = np.cumsum(counts > 1) - 1
    row, col = row[shared], place[col[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        lo, hi = np.searchsorted(col, [at, at + 4096])
        m = np.zeros((n, int(col[hi - 1]) - at + 1), np.float32)
        m[row[lo:hi], col[lo:hi] - at] = 1
        out += m @ m.T
    return out


def _verify(threshold: float, width: int):
    """Rows (grp, i, j, block, blocks, sid, copies, words) sorted by tile ->
    one row (sid, links, root) per set and tile."""
    def run(batches):
        for (_, i, j), parts in _groups(batches, 3):
            block = np.concatenate([p.column(3).to_numpy() for p in parts])
            blocks = parts[0].column(4)[0].as_py()
            sid = np.concatenate([p.column(5).to_numpy() for p in parts])
            copies = np.concatenate([p.column(6).to_numpy() for p in parts])
            sets = [shingles(w, width) for p in parts for w in _arrays(p.column(7))]
            sizes = np.array([len(s) for s in sets], np.float64)
            inter = intersections(sets).astype(np.float64)
            linked = inter >= threshold * (sizes[:, None] + sizes[None, :] - inter) - 1e-9
            np.fill_diagonal(linked, False)
            if i != j:   # pairs inside one block belong to its own tile
                linked &= block[:, None] != block[None, :]
            yield pa.RecordBatch.from_arrays(
                [pa.array(sid), pa.array((linked * copies[None, :]).sum(axis=1).astype(np.int64)),
                 pa.array(_union_roots(sid, linked)), pa.array(np.full(len(sid), blocks > 1))],
                names=["sid", "links", "root", "tiled"])

    return run


def candidate_links(reps: DataFrame, threshold: float, runs: int) -> DataFrame:
    """Links (a, b) between sets of ``reps(sid, sketch)`` that share a leaf of
    some run and look similar there."""
    parts = shuffle_partitions(reps.sparkSession)
    # the leaves compare one byte of each position
    bytes_ = reps.select("sid", "sketch")
    level = reps.select("sid", "sketch").mapInArrow(_roots(runs), "node long, sid long")
    found = None
    for depth in range(1, DEPTH + 1):
        level = cut(level, "paths")
        # written, so that a node of many sets meets it by a plain shuffle that can be split
        stats = cut(level.groupBy("node").agg(F.count(F.lit(1)).alias("m"), F.min("sid").alias("leader"))
                    .filter("m > 1"), "node-sizes")
        shared = cut(level.join(stats, "node"), "nodes")
        small = (shared.filter(F.col("m") <= LEAF).select("node", "sid")
                 .join(bytes_, "sid").select("node", "sid", "sketch")
                 .mapInArrow(_low_bytes, "node long, sid long, low binary")
                 .repartition(parts, "node").sortWithinPartitions("node", "sid"))
        links = small.mapInArrow(_leaves(threshold), "a long, b long")
        large = shared.filter(F.col("m") > LEAF)
        if depth == DEPTH:
            links = links.unionByName(large.filter("sid != leader").select(F.col("leader").alias("a"),
                                                                           F.col("sid").alias("b")))
        links = cut(links.distinct(), "candidates")
        found = links if found is None else found.unionByName(links)
        if depth == DEPTH or large.isEmpty():
            return found
        level = large.select("node", "sid").join(bytes_, "sid").select("node", "sid", "sketch").mapInArrow(
            _split, "node long, sid long")
    return found


def _low_bytes(batches):
    for part in batches:
        low = _values(part.column(2)).astype(np.uint8) if part.num_rows else np.zeros((0, POSITIONS), np.uint8)
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1),
                                          pa.array([r.tobytes() for r in low], pa.binary())],
                                         names=["node", "sid", "low"])


def similarity_classes(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH,
                       runs: int = RUNS) -> DataFrame:
    """``(doc_id, sha, class_id, n_links)`` per row of ``docs(doc_id, text)``.

    ``n_links`` is the number of other rows at ``threshold`` or more;
    ``class_id`` the smallest doc_id connected by such links; ``sha`` the
    SHA-256 of the text (binary), with doc_id the row's identity.
    """
    return _classes(docs, threshold, width, runs).drop("first_sha")


def _classes(docs: DataFrame, threshold: float, width: int = WIDTH, runs: int = RUNS) -> DataFrame:
    """``similarity_classes`` with ``first_sha``: that of the class's first
    row by (doc_id, sha), null ids last."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                    F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), "text")
    rows = cut(x.select("doc_id", "sha", word_hashes(F.col("text")).alias("words"))
               .mapInArrow(_signatures(width), "doc_id long, sha binary, skey binary, n long, sketch binary"),
               "signatures")
    # equal sets become one, with its copies and one row that stands for it
    reps = cut(rows.groupBy("skey").agg(F.min(F.struct("doc_id", "sha")).alias("rep"), F.max("n").alias("n"),
                                        F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"))
               .withColumn("sid", F.monotonically_increasing_id()), "sets")
    links = candidate_links(reps.filter("n > 0"), threshold, runs)
    groups = cut(connected_components(links), "groups")
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    members = (groups.join(sizes, "root")
               .join(reps.select(F.col("sid").alias("id"), "copies", "rep"), "id")
               .select(F.col("id").alias("sid"), F.col("root").alias("grp"), "copies",
                       F.greatest(F.lit(1), F.ceil(F.col("m") / F.lit(TILE))).cast("int").alias("blocks"),
                       F.col("rep.doc_id").alias("r_doc"), F.col("rep.sha").alias("r_sha")))
    # whole texts of the sets in groups, one row each
    texts = (x.join(members, x["doc_id"].eqNullSafe(members["r_doc"]) & (x["sha"] == members["r_sha"]))
             .select("grp", "sid", "copies", "blocks", "text"))
    block = F.pmod(F.xxhash64("sid"), F.col("blocks").cast("long")).cast("int")
    if _has_repeated(rows):
        texts = texts.dropDuplicates(["sid"])
    # a set meets every block of its group, its own included, in one tile each
    tiles = (texts.withColumn("block", block)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")))
    verified = cut(tiles.select("grp", "i", "j", "block", "blocks", "sid", "copies", "text")
                   .repartition(parts, "grp", "i", "j").sortWithinPartitions("grp", "i", "j", "sid")
                   .select("grp", "i", "j", "block", "blocks", "sid", "copies", word_hashes(F.col("text")).alias("words"))
                   .mapInArrow(_verify(threshold, width), "sid long, links long, root long, tiled boolean"), "verified")
    counts = verified.groupBy("sid").agg(F.sum("links").alias("links"), F.min("root").alias("root"),
                                         F.max("tiled").alias("tiled"))
    # groups of one tile are settled there; links between tiles meet in components
    joined = connected_components(verified.filter("tiled and root != sid").select(
        F.col("root").alias("a"), F.col("sid").alias("b"))) if not verified.filter("tiled").isEmpty() else None
    per_set = reps.select("sid", "skey", "copies", F.struct(
        F.col("rep.doc_id").isNull().alias("no_id"), "rep.doc_id", "rep.sha").alias("first")).join(counts, "sid", "left")
    if joined is not None:
        per_set = per_set.join(joined.select(F.col("id").alias("sid"), F.col("root").alias("joint")), "sid", "left")
        per_set = per_set.withColumn("root", F.coalesce("joint", F.when(F.col("tiled"), F.col("sid")), "root"))
    per_set = cut(per_set.select("sid", "skey", "first", F.coalesce("root", "sid").alias("root"),
                                 (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "linked")
    classes = per_set.groupBy("root").agg(F.min("first").alias("first")).select(
        "root", F.col("first.doc_id").alias("class_id"), F.col("first.sha").alias("first_sha"))
    per_set = per_set.join(classes, "root").select("skey", "class_id", "first_sha", "n_links")
    return rows.select("doc_id", "sha", "skey").join(per_set, "skey").select(
        "doc_id", "sha", "class_id", "first_sha", "n_links")


def _has_repeated(rows: DataFrame) -> bool:
    """Whether some row (doc_id and text) occurs more than once."""
    return not rows.groupBy("doc_id", "sha").count().filter("count > 1").isEmpty()


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The row of each class with the smallest (doc_id, sha), null ids last
    (as a filter stage): one document of each class, all columns. Rows that
    repeat its doc_id and text stay with it."""
    found = _classes(docs, threshold).filter(
        F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("sha") == F.col("first_sha"))).select(
        F.col("doc_id").alias("_k"), F.col("sha").alias("_s")).distinct()
    sha = fresh(docs, "_sha")
    x = docs.withColumn(sha, F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)))
    return x.join(found, x["doc_id"].cast("long").eqNullSafe(found["_k"]) & (x[sha] == found["_s"]),
                  "left_semi").drop(sha)
