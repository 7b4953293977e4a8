"""Byte-level BPE encoding and decoding over a global distinct-word shuffle.

1. Texts are split into pre-tokens (``words``) in blocks of some documents.
   A block numbers its distinct words; a document becomes the list of its
   words' numbers by position.
2. Each block's distinct words are dealt by word hash, so that all blocks'
   copies of a word meet in one task, which encodes it once.
3. The ids join back to the blocks by block, and every document's ids are
   put together by position.
4. Decoding joins ids to the token-byte table and puts the bytes together.

Words of one block and bucket, and the numbers of one document, travel as
one packed binary: a row for each (document, position) would write several
times the input. A word is dealt once per block, so the most frequent words
weigh no more than rare ones; hot documents or sources make no hot key.
Blocks are cut from the scan's own order, which Spark repeats for a retried
task; both passes number their words alike and the join checks that
(``fingerprint``), so a differing order fails instead of mixing words up.

Defined cases: null text counts as empty (no ids, empty bytes); repeated rows
and equal texts are encoded row by row; a very long text or word is one value
throughout; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import shuffle_partitions, text_rows

BLOCK_CHARS = 12_000_000
ROW_SCHEMA = "block long, kind int, bucket int, doc_id long, n_words long, blob binary"
OUT_SCHEMA = "doc_id long, ids binary, decoded binary"


def vocabulary(ranks_name: str = "byte_bpe_multi_50k.tiktoken") -> dict:
    """``ranks`` and ``pattern`` of an installed public vocabulary."""
    import public_tokenizers as P

    with open(P.path(ranks_name), "rb") as f:
        return {"ranks": f.read(), "pattern": P.PATTERN}


def token_bytes(ranks: bytes) -> list[tuple[bytes, int]]:
    import base64

    return [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in ranks.splitlines() if line)]


class Spaced(Exception):
    """White space meets a space: a chunk does not stand alone."""


class _Words(dict):
    """Numbers of a block's words by space-delimited chunk: chunk -> numbers
    as uint32 bytes. ``index`` numbers words by first occurrence."""

    def __init__(self, find):
        super().__init__()
        self.find, self.index = find, {}

    def numbers(self, text: str) -> bytes:
        index = self.index
        return array("I", [index.setdefault(w, len(index)) for w in self.find(text)]).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise Spaced
        out = self.numbers(" " + chunk)
        if len(chunk) <= 64:
            self[chunk] = out
        return out

    def text(self, text: str) -> bytes:
        """Numbers of a text's words by position. A single space between two
        other characters always begins a word, so chunks are looked up one by
        one; where white space meets a space the whole text is split."""
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            try:
                return self.numbers(first) + b"".join(map(self.__getitem__, rest))
            except Spaced:
                pass
        return self.numbers(text)


def _blocks(batches, pattern: str, n_buckets: int, with_docs: bool) -> Iterator[tuple]:
    """Per block of documents: (block id, words in bucket order, the buckets'
    sizes, documents as (doc_id, numbers in that order))."""
    import regex

    find = regex.compile(pattern).findall
    words, docs, chars, k, partition = _Words(find), [], 0, 0, 0

    def block():
        listed = list(words.index)
        bucket = np.fromiter((zlib.crc32(w.encode()) % n_buckets for w in listed), np.int32, len(listed))
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(listed), np.uint32)
        place[order] = np.arange(len(listed), dtype=np.uint32)
        return (partition << 24 | k, [listed[i] for i in order.tolist()], np.bincount(bucket, minlength=n_buckets),
                [(d, place[np.frombuffer(b, np.uint32)]) for d, b in docs])

    for part, texts in text_rows(batches):
        partition = part.column(2)[0].as_py()
        for doc_id, text in zip(part.column(0).to_pylist(), texts):
            if chars and chars + len(text) > BLOCK_CHARS:
                yield block()
                words, docs, chars, k = _Words(find), [], 0, k + 1
            chars += len(text) + 1
            numbers = words.text(text)
            docs.append((doc_id, numbers if with_docs else b""))
    if docs:
        yield block()


def _fingerprint(words: list[str]) -> int:
    return zlib.crc32("\0".join(words).encode())


def _pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, compressed."""
    import zstandard

    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    cols = list(zip(*rows)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                      names=["block", "kind", "bucket", "doc_id", "n_words", "blob"])


def _emit(batches, pattern: str, n_buckets: int, kind: str):
    """Rows of one pass: the blocks' distinct words by bucket, or their
    documents as numbers by position."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    for block, words, sizes, docs in _blocks(batches, pattern, n_buckets, kind == "docs"):
        if kind == "docs":
            mark = _fingerprint(words)
            for at in range(0, len(docs), 256):
                yield _rows([(block, 1, mark - 2**31, d, len(words), _pack(numbers))
                             for d, numbers in docs[at:at + 256]])
            continue
        at, out = 0, []
        mark = _fingerprint(words)
        for bucket, size in enumerate(sizes.tolist()):
            if size:
                raw = [w.encode() for w in words[at:at + size]]
                lens = np.fromiter(map(len, raw), np.uint32, size)
                out.append((block, 0, bucket, mark, size,
                            squeeze(struct.pack("<I", size) + lens.tobytes() + b"".join(raw))))
                at += size
        yield _rows(out)


def _split(flat: bytes, lens: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lens, dtype=np.int64).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


DICT_WORDS = 400_000   # words remembered at once in a task; beyond it a word may be encoded again


def _encode_words(batches, ranks: bytes, pattern: str):
    """Rows of distinct words, all copies of a word in one task -> rows of
    their ids."""
    import tiktoken
    import zstandard

    piece = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=dict(token_bytes(ranks)),
                              special_tokens={})._encode_single_piece

    class Ids(dict):
        def __missing__(self, word: bytes) -> array:
            if len(self) >= DICT_WORDS:
                self.clear()
            v = self[word] = array("I", piece(word))
            return v

    known, bucket_now = Ids(), None
    unsqueeze, squeeze = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        out = []
        for block, bucket, mark, size, blob in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
            if bucket != bucket_now:
                known, bucket_now = Ids(), bucket
            raw = unsqueeze(blob)
            lens = np.frombuffer(raw, "<u4", size, 4)
            ids = [known[w] for w in _split(raw[4 + 4 * size:], lens)]
            counts = np.fromiter(map(len, ids), np.uint32, size)
            flat = np.frombuffer(b"".join(i.tobytes() for i in ids), np.uint32)
            a, b = _pack(counts), _pack(flat)
            out.append((block, 0, bucket, mark, size, struct.pack("<I", len(a)) + a + b))
        yield _rows(out)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the concatenation of ranges ``[start, start + len)``."""
    total = int(lens.sum())
    ends = np.cumsum(lens)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)


def _assemble(batches, ranks: bytes):
    """Rows by block, its word ids first, then its documents -> documents
    with ids and the bytes decoded from them."""
    table = sorted(token_bytes(ranks), key=lambda x: x[1])
    tok_len = np.zeros(table[-1][1] + 1, np.int64)
    tok_len[[i for _, i in table]] = [len(b) for b, _ in table]
    tok_at = np.cumsum(tok_len) - tok_len
    tok_flat = np.frombuffer(b"".join(b for b, _ in table), np.uint8)

    block_now, parts, word_len, word_at, flat, mark_now = None, [], None, None, None, None
    for batch in batches:
        out, size = ([], [], []), 0
        for block, kind, bucket, doc_id, n, blob in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if block != block_now:
                block_now, parts, word_len = block, [], None
            if kind == 0:
                at, = struct.unpack_from("<I", blob)
                parts.append((_unpack(blob[4:4 + at]), _unpack(blob[4 + at:])))
                mark_now = doc_id
                continue
            if word_len is None:   # the block's words are complete
                word_len = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.uint32)]).astype(np.int64)
                flat = np.concatenate([p[1] for p in parts] or [np.zeros(0, np.uint32)])
                word_at, parts = np.cumsum(word_len) - word_len, []
            if n != len(word_len) or n and mark_now != bucket + 2**31:
                raise RuntimeError(f"block {block}: its words differ between two passes over the input")
            numbers = _unpack(blob)
            ids = flat[ragged(word_at[numbers], word_len[numbers])]
            decoded = tok_flat[ragged(tok_at[ids], tok_len[ids])]
            for col, v in zip(out, (doc_id, ids.astype("<u4").tobytes(), decoded.tobytes())):
                col.append(v)
            size += len(out[1][-1])
            if size > 16_000_000:
                yield _result(out)
                out, size = ([], [], []), 0
        if out[0]:
            yield _result(out)


def _result(out) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()),
                                       pa.array(out[2], pa.binary())], names=["doc_id", "ids", "decoded"])


def _digest(batches):
    for part in batches:
        ids, decoded = part.column(1).to_pylist(), part.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays([
            part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()),
            pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
            pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str, digest: bool = False,
                     n_buckets: int | None = None) -> DataFrame:
    """``(doc_id, ids binary, decoded binary)`` per row of ``docs(doc_id,
    text)``; ids are little-endian uint32. With ``digest`` the token count and
    the two SHA-256 digests instead (computed where the ids are)."""
    parts = shuffle_partitions(docs.sparkSession)
    buckets = n_buckets or max(32, parts)
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().alias("part"))

    def words(batches):
        return _emit(batches, pattern, buckets, "words")

    def positions(batches):
        return _emit(batches, pattern, buckets, "docs")

    def encode(batches):
        return _encode_words(batches, ranks, pattern)

    def assemble(batches):
        rows = _assemble(batches, ranks)
        return _digest(rows) if digest else rows

    # all copies of a word meet in its bucket
    dealt = x.mapInArrow(words, ROW_SCHEMA).repartition(parts, "bucket").sortWithinPartitions("bucket")
    encoded = dealt.mapInArrow(encode, ROW_SCHEMA)
    back = (encoded.unionByName(x.mapInArrow(positions, ROW_SCHEMA))
            .repartition(parts, "block").sortWithinPartitions("block", "kind", "bucket"))
    return back.mapInArrow(assemble, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
                           if digest else OUT_SCHEMA)
