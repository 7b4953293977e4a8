"""Exact dedup by block naming, byte-level BPE, packing."""

import hashlib
import random
import struct
import zlib

import pytest
import tiktoken

from quire.llm import bpe, exact_dedup, packing, vocab


def brute_dedup(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    return sorted((d, max(groups[t or ""], key=lambda x: -1 if x is None else x), len(groups[t or ""]),
                   hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows if d is not None)


@pytest.mark.parametrize("block_bytes", [3, 16384])
def test_exact_dedup_matches_grouping_by_text(spark, docs, block_bytes):
    got = exact_dedup.exact_dedup(docs if block_bytes > 3 else docs.filter("length(text) < 100 or text is null"),
                                  block_bytes).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect() if block_bytes > 3 or len(r.text or "") < 100]
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got
                  if r.doc_id is not None) == brute_dedup(rows)
    # one row of each group stays, also where a row is repeated
    kept = [r for r in got if r.kept]
    assert len(kept) == len({t or "" for _, t in rows}) and all(r.doc_id == r.keep_id for r in kept)


def test_names_survive_hash_collisions(spark, monkeypatch):
    """With a hash that is the same for all blocks, the content decides."""
    from pyspark.sql import functions as F

    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: real(F.lit(1)) + F.length(c[0]) * 0)
    texts = ["aaabbb", "aaaccc", "aaabbb", "bbbaaa", "", None, "aaabbbcccd", "aaabbbccce"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(df, 3).collect()}
    assert got == {0: (2, 2), 2: (2, 2), 1: (1, 1), 3: (3, 1), 4: (5, 2), 5: (5, 2), 6: (6, 1), 7: (7, 1)}


def test_exact_dedup_as_a_stage_and_on_an_empty_table(spark, docs):
    out = exact_dedup.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(len(r.text or "") for r in out.collect()) == sorted(len(t) for t in {r.text or "" for r in docs.collect()})
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def encoding(name):
    v = bpe.vocabulary(name)
    return tiktoken.Encoding("t", pat_str=v["pattern"], mergeable_ranks=dict(bpe.token_bytes(v["ranks"])),
                             special_tokens={}), v


def test_encoding_is_the_library_s_and_decodes_back(spark, docs, monkeypatch):
    enc, v = encoding("byte_bpe_multi_50k.tiktoken")
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 200)       # many blocks
    extra = spark.createDataFrame([(100, "it's  we'll\r\n\u2003x \u00a0y 1234 a_b émigré\u0301 " * 3), (101, "\0\0 \0")],
                                  "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(extra).repartition(3)
    got = bpe.encode_documents(df.cache(), **v, n_buckets=5).collect()
    assert len(got) == 16
    texts = {(r.doc_id, r.text) for r in df.collect()}
    for r in got:
        text = bytes(r.decoded).decode()
        assert (r.doc_id, text) in texts or text == "" and (r.doc_id, None) in texts
        assert list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)) == enc.encode_ordinary(text)
    assert bpe.encode_documents(df.limit(0), **v, digest=True).count() == 0


def test_whole_words_are_split_as_the_library_splits_texts():
    """The shortcut at single blanks holds for odd white space and signs."""
    import regex

    enc, v = encoding("byte_bpe_multi_50k.tiktoken")
    pieces = [" ", "  ", "\n", " \n", "\u2003", "\x1c", "a", "é", "1", "'s", "'S", "_", "!", "日", "\u0301", "."]
    rnd = random.Random(3)
    for _ in range(4000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 9)))
        w = bpe._Words(regex.compile(v["pattern"]).findall)
        numbers = w.text(text)
        words = list(w.index)
        ids = [t for n in struct.unpack(f"<{len(numbers) // 4}I", numbers) for t in enc._encode_single_piece(words[n])]
        assert ids == enc.encode_ordinary(text), text


def test_packing_tokens_are_the_tokenizer_s():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    v = packing.public_vocabulary()
    enc = vocab.worker_encoder(v["ranks"], v["pattern"])
    pieces = [" ", "  ", "\n", "a", "é", "1", "'s", "!", "日", "<|endoftext|>", "word", ".", "\u2003"]
    rnd = random.Random(4)
    for _ in range(2000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 9)))
        ids = vocab.encode_whole(enc, text, v["specials"])
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == t.encode(text, add_special_tokens=False).ids, text


def test_packing_is_gapless_complete_and_tight(spark, docs):
    v = packing.public_vocabulary()
    out = packing.pack_documents(docs, **v, seq_len=64).collect()
    by_seq, by_doc = {}, {}
    for r in out:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for slots in by_seq.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 64
    assert set(by_doc) == {r.doc_id for r in docs.collect()}
    long = sorted(by_doc[6], key=lambda r: r.piece)
    assert [r.length for r in long[1:]] == [64] * (len(long) - 1) and [r.start for r in long] == [
        sum(x.length for x in long[:i]) for i in range(len(long))]
    total = sum(r.length for r in out)
    assert len(by_seq) <= -(-total // 64) + 1
    empty = by_doc[1][0]
    assert empty.length == 1 and empty.ids_crc32 == zlib.crc32(bytes(4))
    assert packing.pack_documents(docs.limit(0), **v).count() == 0


def test_plan_is_best_fit_decreasing():
    rnd = random.Random(1)
    for seq_len in (10, 64):
        counts = {n: rnd.randint(1, 30) for n in rnd.sample(range(1, seq_len + 1), min(seq_len, 20))}
        plan = packing.plan_best_fit(counts, seq_len)
        rooms, used = [], {}
        for n in sorted(counts, reverse=True):       # one by one
            for _ in range(counts[n]):
                fit = [i for i, r in enumerate(rooms) if r >= n]
                if not fit:
                    rooms.append(seq_len)
                    fit = [len(rooms) - 1]
                i = min(fit, key=lambda j: rooms[j])
                rooms[i] -= n
        for n, a, b, first, per, at in plan:
            for k in range(b - a):
                used.setdefault(first + k // per, []).append((at + k % per * n, n))
        assert sum(b - a for _, a, b, *_ in plan) == sum(counts.values()) and len(used) == len(rooms)
        for slots in used.values():
            end = 0
            for at, n in sorted(slots):
                assert at == end
                end += n
            assert end <= seq_len
