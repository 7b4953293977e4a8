"""Best-fit packing of documents into fixed-length token sequences.

Length-histogram planning: documents are tokenised once into pieces (only a
document longer than a sequence is cut; its first piece is the short one).
The histogram of piece lengths, at most ``seq_len`` numbers however many
documents there are, goes to the driver, which plans best-fit decreasing over
*counts*: "ranks 0-99 of length 700 go to sequences 12-111 at offset 1348".
Pieces then take their slots by joining the plan on their rank within their
length. No piece, token or text passes through the driver.

Defined cases: a null or empty text is the closing id alone (length 1);
documents of equal length are ranked by (doc_id, piece), repeated rows each
get a slot of their own; an empty table gives no rows; other columns are
ignored. Whole texts are tokenised.
"""

from __future__ import annotations

import zlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import text_rows
from quire.llm.vocab import encode_whole, worker_encoder
from quire.operators.common import ordered_rank
from quire.session import cut

SEQ_LEN = 2048
EOT = 0            # closing id of every document
PLAN_SCHEMA = "length int, rank_from long, rank_to long, seq_from long, per_seq long, offset_from long"
PIECE_SCHEMA = "doc_id long, piece int, start long, length int, ids_crc32 long"


def cut_points(n: int, seq_len: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: whole
    sequences, preceded by the shorter rest if there is one."""
    first = n % seq_len or min(n, seq_len)
    return [(0, first)] + [(s, seq_len) for s in range(first, n, seq_len)]


def pieces(docs: DataFrame, ranks: bytes, pattern: str, specials: dict[str, int],
           seq_len: int = SEQ_LEN) -> DataFrame:
    """Every document's pieces: (doc_id, piece, start, length, ids_crc32)."""

    def run(batches):
        enc = worker_encoder(ranks, pattern)
        end = array("I", [EOT]).tobytes()
        for part, texts in text_rows(batches):
            out = ([], [], [], [], [])
            for doc_id, text in zip(part.column(0).to_pylist(), texts):
                ids = encode_whole(enc, text, specials) + end
                for k, (start, length) in enumerate(cut_points(len(ids) // 4, seq_len)):
                    for col, v in zip(out, (doc_id, k, start, length,
                                            zlib.crc32(ids[4 * start:4 * (start + length)]))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE_SCHEMA)


def plan_best_fit(counts: dict[int, int], seq_len: int = SEQ_LEN) -> list[tuple]:
    """Best-fit decreasing over a length histogram.

    Equal sequences are held as one group (first id, how many), by free
    space. A length goes to the fullest groups that have room, as many items
    in each sequence as fit; new sequences are opened for the rest. Every
    step uses up a length or a group, and a length leaves at most three new
    groups, so the plan's size depends on ``seq_len`` and not on the counts
    (a few thousand rows for 2048).
    """
    free: list[list[tuple[int, int]]] = [[] for _ in range(seq_len + 1)]
    plan, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        for room in range(length, seq_len + 1):
            if not left:
                break
            if not free[room]:
                continue
            groups, free[room] = free[room], []
            per = room // length
            for first, n in groups:
                if not left:
                    free[room].append((first, n))
                    continue
                rank, left = _place(plan, free, length, rank, left, first, n, per, room, seq_len)
        if left:
            per = seq_len // length
            n = -(-left // per)
            _place(plan, free, length, rank, left, sequences, n, per, seq_len, seq_len)
            sequences += n
    return plan


def _place(plan, free, length, rank, left, first, n, per, room, seq_len):
    """Put up to ``per`` items into each of ``n`` sequences with ``room``."""
    take = min(left, n * per)
    plan.append((length, rank, rank + take, first, per, seq_len - room))
    whole, rest = divmod(take, per)
    for start, size, items in ((first, whole, per), (first + whole, 1 if rest else 0, rest),
                               (first + whole + (1 if rest else 0), n - whole - (1 if rest else 0), 0)):
        if size:
            free[room - items * length].append((start, size))
    return rank + take, left - take


def pack(pieces_df: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """Give each row of (doc_id, piece, length, ...) a ``sequence_id`` and a
    gapless ``offset``; keeps all columns."""
    spark = pieces_df.sparkSession
    rows = cut(pieces_df, "pieces")
    # at most seq_len rows reach the driver
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = spark.createDataFrame(plan_best_fit(counts, seq_len), PLAN_SCHEMA)
    ranked = ordered_rank(rows, ["length"], [F.col("doc_id"), F.col("piece")], out="_rank")
    at = F.col("_rank") - 1
    # the plan's size depends on seq_len, not on the data, so it is broadcast
    slots = ranked.alias("r").join(F.broadcast(plan.alias("p")),
                                   (F.col("r.length") == F.col("p.length"))
                                   & (at >= F.col("p.rank_from")) & (at < F.col("p.rank_to")))
    k = at - F.col("p.rank_from")
    return slots.select("r.*",
                        (F.col("p.seq_from") + F.floor(k / F.col("p.per_seq"))).cast("long").alias("sequence_id"),
                        (F.col("p.offset_from") + k % F.col("p.per_seq") * F.col("p.length")).cast("long")
                        .alias("offset")).drop("_rank")


def pack_documents(docs: DataFrame, ranks: bytes, pattern: str, specials: dict[str, int],
                   seq_len: int = SEQ_LEN) -> DataFrame:
    """Tokenise and pack ``docs(doc_id, text)``: one row per piece."""
    out = pack(pieces(docs, ranks, pattern, specials, seq_len), seq_len)
    return out.withColumn("length", F.col("length").cast("long"))


def public_vocabulary(json_name: str = "byte_bpe_50k.json", ranks_name: str = "byte_bpe_50k.tiktoken"
                      ) -> dict:
    """Arguments of ``pack_documents`` for an installed public vocabulary:
    the tokeniser's own added strings, and the same vocabulary as ranks."""
    import json

    import public_tokenizers as P

    with open(P.path(json_name), encoding="utf-8") as f:
        specials = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    with open(P.path(ranks_name), "rb") as f:
        return {"ranks": f.read(), "pattern": P.PATTERN, "specials": specials}
