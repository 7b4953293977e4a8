"""Exact top-k inner-product search by no-random-access aggregation (Fagin,
Lotem and Naor 2001).

Candidates are dealt into shards. A shard has, for every dimension, its
candidates sorted by value: a query with a positive component reads that list
from the largest value down, with a negative one from the smallest up, so
every list is read by falling contribution; where the component is zero it is
not read. Lists are read in steps of equal depth, once for a whole block of
queries. What has been read fills four tables, values and "not met yet" for
either direction; a candidate's score so far is the product with the values,
its lower bound adds the lists' ends, its upper bound the reading fronts, for
the lists it was not met in. A query stops once few candidates' upper bounds
reach its k-th lower bound: no other can qualify, and those few alone get
their final scores. Scores are integers, so bounds and ties are exact.

The k-th score that a query reaches in a first shard is its floor in all
others: there reading stops against the better of the two.

Work is a grid of (shard, block of queries); rows are dealt by hashes of
their content, never by a value of the data that could be hot.

Defined cases: vectors that are null, empty, or hold a null or non-finite
component take no part; components missing against the longest vector count
as 0; every row counts, repeated ids and vectors too, and each query row has
a list of its own (``query_rid``); a query's candidates are all rows but its
own; equal scores go to the smaller vec_id; fewer than k candidates: all are
returned; a null vec_id takes no part; an empty table gives no rows; other
columns are ignored. Component sums must fit in a 64-bit integer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.chosen_path import _groups
from quire.session import cut

SHARD_ROWS = 8192
QUERY_BLOCK = 16384     # queries of one grid cell
STEP_QUERIES = 128      # queries that read the lists together
FEW = 64                # candidates that may be left when reading stops
STEPS = 16              # steps in which a list is read at most


def integer_vectors(table: DataFrame, id_col: str, vec_col: str, scale: float = 256.0) -> DataFrame:
    """``(rid, vec_id, v array<long>)`` of the usable rows: floor(scale * x),
    written once so that row ids are the same wherever they are read."""
    x = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"))
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return cut(x.filter(F.col("vec_id").isNotNull() & (F.size("x") > 0) & ~bad)
               .select(F.monotonically_increasing_id().alias("rid"), "vec_id",
                       F.transform("x", lambda e: F.floor(e * scale)).alias("v")), "vectors")


def _matrix(lists: list, dim: int) -> np.ndarray:
    out = np.zeros((len(lists), dim), np.int64)
    for row, v in zip(out, lists):
        row[:len(v)] = v
    return out


class Shard:
    """Candidates with their sorted lists. ``touched`` counts the values read."""

    def __init__(self, rids: np.ndarray, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.rids, self.ids = rids[order], ids[order]
        # products exact in doubles where they fit, else in 64-bit integers
        big = x.size and float(np.abs(x).max()) ** 2 * x.shape[1] >= 2**52
        self.x = x[order] if big else x[order].astype(np.float64)
        # cells of the table in the order in which a list meets them, a row per depth
        up = np.argsort(self.x, axis=0, kind="stable") * self.x.shape[1] + np.arange(self.x.shape[1])
        self.lists = (up[::-1], up)        # from the largest value down, from the smallest up
        self.touched = 0

    def top(self, own: np.ndarray, q: np.ndarray, k: int, floors: np.ndarray | None = None) -> list[tuple]:
        """Per query (candidate positions, scores) of its k best here, best
        first; those below its floor may be missing."""
        n, dim = self.x.shape
        flat = self.x.reshape(-1)
        q = q.astype(self.x.dtype)
        parts = (np.maximum(q, 0), np.minimum(q, 0))
        ends = (self.x.min(axis=0), self.x.max(axis=0))
        # read values and places not met yet, for both directions
        read = np.zeros((n, 4 * dim), self.x.dtype)
        read[:, 2 * dim:] = 1
        step = max(k, -(-n // STEPS))
        few = max(FEW, 2 * k, step)        # final scores of so many cost what another step does
        out: list = [None] * len(q)
        left = np.arange(len(q))
        for at in range(0, n, step):
            last = at + step >= n
            fronts = []
            for way, (cells, part) in enumerate(zip(self.lists, parts)):
                used = part.any(axis=0)     # lists that some query reads this way
                new = cells[at:at + step, used]
                self.touched += new.size
                row, col = np.divmod(new, dim)
                read[row, way * dim + col] = flat[new]
                read[row, (2 + way) * dim + col] = 0
                fronts.append(flat[cells[min(at + step, n) - 1]])
            # bounds are compared at every second step, once half is read
            if not last and (at + step < n // 2 or at // step % 2 == 0):
                continue
            p = [part[left] for part in parts]
            low = np.hstack([*p, *(x * e for x, e in zip(p, ends))]) @ read.T
            high = np.hstack([*p, *(x * f for x, f in zip(p, fronts))]) @ read.T
            mine = self.rids[None, :] == own[left][:, None]
            none = np.iinfo(np.int64).min // 2 if low.dtype.kind == "i" else -np.inf
            low[mine] = none
            kth = np.partition(low, max(0, n - k), axis=1)[:, max(0, n - k)]
            if floors is not None:
                kth = np.maximum(kth, floors[left])
            can = (high >= kth[:, None]) & ~mine
            stop = (can.sum(axis=1) <= few) | last
            for r in np.nonzero(stop)[0].tolist():
                where = np.nonzero(can[r])[0]
                self.touched += len(where) * dim
                final = self.x[where] @ q[left[r]]
                best = np.lexsort((self.ids[where], -final))[:k]
                out[left[r]] = where[best], final[best]
            left = left[~stop]
            if not len(left):
                break
        return out


def _cells(k: int, dim: int):
    """Rows (shard, qblock, kind, rid, vec_id, v, floor), candidates of a cell
    before its queries -> each query's k best of the shard."""
    def run(batches):
        for _, parts in _groups(batches, 2):
            table = pa.Table.from_batches(parts)
            kind, rids, ids = (table.column(i).to_numpy() for i in (2, 3, 4))
            floors = table.column(6).to_pylist()
            x = _matrix(table.column(5).to_pylist(), dim)
            if not (kind == 0).any() or not (kind == 1).any():
                continue
            shard = Shard(rids[kind == 0], ids[kind == 0], x[kind == 0])
            least = np.iinfo(np.int64).min // 2
            asked = np.nonzero(kind == 1)[0]
            for at in range(0, len(asked), STEP_QUERIES):
                block = asked[at:at + STEP_QUERIES]
                floor = np.array([least if floors[r] is None else floors[r] for r in block.tolist()])
                cols: tuple = ([], [], [], [])
                for row, (where, score) in zip(block.tolist(), shard.top(rids[block], x[block], k, floor)):
                    cols[0].extend([int(rids[row])] * len(where))
                    cols[1].extend([int(ids[row])] * len(where))
                    cols[2].extend(shard.ids[where].tolist())
                    cols[3].extend(int(s) for s in score)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                                 names=["query_rid", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``(query_rid, query_id, rank, vec_id, score)``: the k best of
    ``vectors(rid, vec_id, v)`` for each row of ``queries``, of the same
    columns, but the row itself."""
    shape = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    asked = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    dim = max(shape["dim"] or 1, asked["dim"] or 1)
    shards = max(1, -(-shape["n"] // SHARD_ROWS))
    qblocks = max(1, -(-asked["n"] // QUERY_BLOCK))
    h = F.xxhash64("vec_id", "v", "rid")
    dealt = vectors.select(F.pmod(h, F.lit(shards)).cast("int").alias("shard"), "rid", "vec_id", "v")

    def numbers(a, b):
        return F.explode(F.sequence(F.lit(a), F.lit(b)))

    def search(asked_rows, first, last):
        cells = (dealt.filter(F.col("shard").between(first, last))
                 .select("shard", numbers(0, qblocks - 1).alias("qblock"), F.lit(0).alias("kind"), "rid", "vec_id", "v",
                         F.lit(None).cast("long").alias("floor"))
                 .unionByName(asked_rows.select(numbers(first, last).alias("shard"),
                                                F.pmod(h, F.lit(qblocks)).cast("int").alias("qblock"),
                                                F.lit(1).alias("kind"), "rid", "vec_id", "v", "floor")))
        return (cells.repartition((last - first + 1) * qblocks, "shard", "qblock")
                .sortWithinPartitions("shard", "qblock", "kind")
                .mapInArrow(_cells(k, dim), "query_rid long, query_id long, vec_id long, score long"))

    found = cut(search(queries.withColumn("floor", F.lit(None).cast("long")), 0, 0), "found")
    if shards > 1:
        # a query's k-th score in the first shard; none where it has fewer
        floors = cut(found.groupBy("query_rid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor"))
                     .filter(F.col("n") == k).select(F.col("query_rid").alias("rid"), "floor"), "floors")
        found = found.unionByName(search(queries.join(floors, "rid", "left"), 1, shards - 1))
    w = Window.partitionBy("query_rid").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_rid", "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
