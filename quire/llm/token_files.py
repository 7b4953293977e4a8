"""Token ids as binary files: one concatenated id array per file, document
boundaries and document ids in Elias-Fano code beside it.

A store is a folder ``segments/`` of files and a small Parquet ``manifest``.
A file holds at most about ``SEGMENT_IDS`` ids of whole documents (one longer
document is a file of its own):

    header    64 bytes: magic, shard, segment, ids of the shard before this
              file, documents, ids, documents without an id, bytes per id,
              places of the two Elias-Fano parts, smallest document id
    ids       every id of every document, 2 bytes each where the vocabulary
              has at most 65,536 entries, else 4, little-endian
    bounds    Elias-Fano: the n + 1 boundaries of the n documents
    doc ids   Elias-Fano: each document id less the smallest one
    trailer   4 bytes

``TokenFile`` reads a file from any buffer, a memory map too: ``bounds.get``
finds a document's place by ``select`` in constant steps, ``find`` its number
from its id. No 64-bit offset is stored anywhere.

Writing: documents are dealt by ranges of doc_id, sorted, encoded and packed
where they arrive, and written by Spark's own file sink (a binary row and its
trailer a file), so a retried or duplicated task never leaves half a file.
Reading: Spark reads the files whole; the manifest gives each shard's start
(one row per shard is summed up in order, never one per document).

Defined cases: a null or empty text is the closing id alone; documents come in
ascending doc_id, null ids first, equal ids by a hash of their text (repeated
rows are interchangeable and each keeps a place); any 64-bit id, also negative;
an empty table writes a store without documents; other columns are ignored.
Whole texts are encoded; runs of white space too long for the splitting
pattern's matcher are split off by its own rule (``vocab.encode_text``).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import elias_fano
from quire.llm.shared import shuffle_partitions, text_rows
from quire.llm.vocab import encode_whole, worker_encoder
from quire.session import ensure_checkpoint_dir

EOT = 0                        # closing id of every document
SEGMENT_IDS = 4_000_000
MAGIC, TRAILER = b"TOKIDS01", "TEND"
# big-endian, so that SQL reads the fields from the file's first bytes
HEADER = struct.Struct(">8sIIQIQIBxxxIIq")
PIECE_SCHEMA = "doc_id long, shard int, at long, n_tokens long, ids_crc32 long"


class FileBuilder:
    """One file in the making: ids are appended in their final width, the
    Elias-Fano parts and the header follow in ``finish``."""

    def __init__(self, shard: int, segment: int, before: int, width: int):
        self.shard, self.segment, self.before, self.width = shard, segment, before, width
        self.data, self.n_ids, self.sizes, self.doc_ids = bytearray(HEADER.size), 0, array("q"), []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """A document's ids as uint32 bytes."""
        self.doc_ids.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.n_ids += len(ids) // 4
        self.data += np.frombuffer(ids, "<u4").astype("<u2").data.cast("B") if self.width == 2 else ids

    def finish(self) -> bytearray:
        """The whole file without its trailer."""
        named = [d for d in self.doc_ids if d is not None]
        least = named[0] if named else 0
        bounds_at = len(self.data)
        self.data += elias_fano.encode(np.concatenate([[0], np.cumsum(np.frombuffer(self.sizes, np.int64))]))
        names_at = len(self.data)
        self.data += elias_fano.encode(np.array([d - least for d in named], np.uint64))
        HEADER.pack_into(self.data, 0, MAGIC, self.shard, self.segment, self.before, len(self.doc_ids), self.n_ids,
                         len(self.doc_ids) - len(named), self.width, bounds_at, names_at, least)
        return self.data


class TokenFile:
    """A file of documents, read from a buffer."""

    def __init__(self, buffer):
        (magic, self.shard, self.segment, self.before, self.n_docs, self.n_ids, self.n_null, self.width,
         bounds_at, names_at, self.least) = HEADER.unpack_from(buffer, 0)
        if magic != MAGIC or bytes(buffer[-len(TRAILER):]) != TRAILER.encode():
            raise ValueError("not a whole token file")
        self.ids = np.frombuffer(buffer, "<u2" if self.width == 2 else "<u4", self.n_ids, HEADER.size)
        self.bounds = elias_fano.EliasFano(buffer, bounds_at)
        self.names = elias_fano.EliasFano(buffer, names_at)

    def doc_ids(self, i: np.ndarray) -> list[int | None]:
        """Ids of the documents number ``i``."""
        named = self.names.get(i[i >= self.n_null] - self.n_null).tolist()
        return [None] * int((i < self.n_null).sum()) + [v + self.least for v in named]

    def document(self, i: int) -> np.ndarray:
        """Token ids of document number ``i``."""
        a, b = self.bounds.get(np.array([i, i + 1])).tolist()
        return self.ids[a:b]

    def find(self, doc_id: int) -> int | None:
        """Number of the (first) document with this id."""
        if doc_id < self.least:
            return None
        i = self.names.first_at_least(doc_id - self.least)
        found = i < self.names.n and int(self.names.get(np.array([i]))[0]) == doc_id - self.least
        return i + self.n_null if found else None


def _one_row(data: bytearray) -> pa.RecordBatch:
    """A batch of one binary value, without another copy of it."""
    offsets = pa.py_buffer(array("i", [0, len(data)]).tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.Array.from_buffers(pa.binary(), 1, [None, offsets, pa.py_buffer(data)])], names=["file"])


def _files(ranks: bytes, pattern: str, specials: dict[str, int], width: int, segment_ids: int):
    """Sorted (doc_id, text) of one partition -> its files, one row each."""
    def run(batches):
        from pyspark import TaskContext

        enc = worker_encoder(ranks, pattern)
        shard = TaskContext.get().partitionId()
        end = array("I", [EOT]).tobytes()
        now = FileBuilder(shard, 0, 0, width)
        for part, texts in text_rows(batches):
            for doc_id, text in zip(part.column(0).to_pylist(), texts):
                ids = encode_whole(enc, text, specials) + end
                if now.n_ids and now.n_ids + len(ids) // 4 > segment_ids:
                    following = FileBuilder(shard, now.segment + 1, now.before + now.n_ids, width)
                    yield _one_row(now.finish())
                    now = following
                now.add(doc_id, ids)
        if now.n_ids:
            yield _one_row(now.finish())

    return run


def write(docs: DataFrame, path: str, ranks: bytes, pattern: str, specials: dict[str, int],
          segment_ids: int = SEGMENT_IDS) -> None:
    """Encode ``docs(doc_id, text)`` into a new store at ``path``."""
    spark = docs.sparkSession
    n_ids = max([len([x for x in ranks.splitlines() if x]), EOT + 1, *(i + 1 for i in specials.values())])
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the row number only splits ranges of equal rows, so its values need not repeat
    keys = ["doc_id", "h", "n"]
    dealt = (d.withColumn("h", F.xxhash64("text")).withColumn("n", F.monotonically_increasing_id())
             .repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys).select("doc_id", "text"))
    files = dealt.mapInArrow(_files(ranks, pattern, specials, 2 if n_ids <= 1 << 16 else 4, segment_ids),
                             "file binary")
    # the sink writes a row's bytes as they are, then the trailer
    (files.select(F.col("file").cast("string").alias("file")).write.mode("errorifexists")
     .option("lineSep", TRAILER).option("maxRecordsPerFile", 1).option("compression", "none")
     .text(f"{path}/segments"))
    _write_manifest(spark, path)


def _contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/segments")


def _write_manifest(spark: SparkSession, path: str) -> None:
    """A row per file with the ids before it in the whole store."""
    def field(at: int, size: int):
        return F.conv(F.hex(F.substring("content", at + 1, size)), 16, 10).cast("long")

    files = _contents(spark, path).filter(F.length("content") > HEADER.size).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), field(8, 4).alias("shard"), field(12, 4).alias("segment"),
        field(16, 8).alias("before"), field(24, 4).alias("n_docs"), field(28, 8).alias("n_ids"))
    # one row per shard, so at most one per partition of the writing job
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("shard", F.coalesce(F.sum("ids").over(w), F.lit(0)).alias("start"))
    (files.join(starts, "shard").withColumn("start", F.col("start") + F.col("before")).drop("before")
     .coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(file, shard, segment, n_docs, n_ids, start)`` of a store's files."""
    return spark.read.parquet(f"{path}/manifest")


def _places(batches, step: int = 4096):
    """Whole files -> each document's place, length and checksum."""
    for batch in batches:
        for content in batch.column(0):
            f = TokenFile(content.as_buffer())
            for at in range(0, f.n_docs, step):
                i = np.arange(at, min(at + step, f.n_docs))
                bounds = f.bounds.get(np.append(i, i[-1] + 1)).astype(np.int64)
                flat = memoryview(f.ids[bounds[0]:bounds[-1]].astype("<u4")).cast("B")
                cuts = ((bounds - bounds[0]) * 4).tolist()
                sums = [zlib.crc32(flat[a:b]) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f.doc_ids(i), pa.int64()), pa.array(np.full(len(i), f.shard, np.int32)),
                     pa.array(bounds[:-1] + f.before), pa.array(np.diff(bounds)), pa.array(sums, pa.int64())],
                    names=["doc_id", "shard", "at", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a store: ``(doc_id, start, n_tokens, ids_crc32)``."""
    # a row per shard: no more than the writing job had partitions
    starts = (manifest(spark, path).filter("segment = 0")
              .select(F.col("shard").cast("int").alias("shard"), F.col("start").alias("_start")))
    return (_contents(spark, path).filter(F.length("content") > HEADER.size).select("content")
            .mapInArrow(_places, PIECE_SCHEMA).join(starts, "shard")
            .select("doc_id", (F.col("at") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32"))


def new_store(spark: SparkSession) -> str:
    """A fresh folder in the session's shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/quire-token-files-{uuid.uuid4().hex}"
