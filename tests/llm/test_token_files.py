"""Elias-Fano code and binary token files."""

import random
import zlib
from array import array

import numpy as np
import pytest
from tokenizers import Tokenizer

from quire.llm import elias_fano, packing, token_files, vocab


def sequences():
    rng = random.Random(3)
    yield []
    yield [0]
    yield [0] * 2000
    yield [2**64 - 1]
    yield [0, 2**63, 2**64 - 1]
    yield list(range(5000))
    # a few huge gaps among many small steps: stretches with written-out positions
    yield sorted([rng.randrange(100) for _ in range(3000)] + [10**6 * i for i in range(5)])
    yield sorted(rng.randrange(2**40) for _ in range(4000))
    yield sorted([5] * 600 + [2**33] * 600 + [rng.randrange(2**34) for _ in range(100)])


@pytest.mark.parametrize("values", list(sequences()), ids=range(9))
def test_elias_fano_returns_what_it_was_given(values):
    data = b"xyz" + elias_fano.encode(np.array(values, np.uint64)) + b"tail"
    ef = elias_fano.EliasFano(data, 3)
    assert ef.end == len(data) - 4
    assert ef.get(np.arange(len(values))).tolist() == values
    shuffled = np.random.default_rng(1).permutation(len(values))
    assert ef.get(shuffled).tolist() == [values[i] for i in shuffled]
    for probe in {0, 1, 5, 10**6, 2**33} | set(values[:20]):
        assert ef.first_at_least(probe) == sum(v < probe for v in values)


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(0).integers(0, 1000, 100_000))
    assert len(elias_fano.encode(values)) * 8 / len(values) < 2 + 9 + 1


def library():
    import public_tokenizers as P

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_whole_texts_and_very_long_white_space_encode_as_the_library_does():
    v = packing.public_vocabulary()
    enc, lib = vocab.worker_encoder(v["ranks"], v["pattern"]), library()
    n = vocab.LONG_RUN
    for text in ["", "a" + " " * (n + 7) + "b", " " * n + "x", "x\n" + " \n" * n, "a" + " " * n + ". b" + "\t" * n + "c",
                 "<|endoftext|><|endoftext|> a<|endoftext|>", "It's 12 o'clock…  \x1c\x85 ok"]:
        got = np.frombuffer(vocab.encode_whole(enc, text, v["specials"]), "<u4").tolist()
        assert got == lib.encode(text, add_special_tokens=False).ids
    assert len(vocab.encode_text(enc, "a" + " " * 1_500_000 + "b")) == 1_500_001


def expected(rows):
    lib, out, start = library(), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = array("I", lib.encode(text or "", add_special_tokens=False).ids + [0])
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("segment_ids", [token_files.SEGMENT_IDS, 300])
def test_documents_are_read_back_from_the_files(spark, docs, segment_ids):
    # doc ids of both signs and far apart, beside null and a repeated row
    rows = [(r.doc_id if r.doc_id is None or r.doc_id % 4 else r.doc_id * 10**17 - 10**18, r.text)
            for r in docs.collect()]
    path = token_files.new_store(spark)
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), path, segment_ids=segment_ids,
                      **packing.public_vocabulary())
    got = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    assert [tuple(r) for r in got] == expected(rows)
    # random access in the files themselves
    lib, n = library(), 0
    for r in token_files._contents(spark, path).collect():
        f = token_files.TokenFile(bytes(r.content))
        n += f.n_docs
        for i, d in enumerate(f.doc_ids(np.arange(f.n_docs))):
            if d is not None:
                first = f.find(d)
                assert first <= i and f.doc_ids(np.array([first])) == [d]
                texts = [t or "" for x, t in rows if x == d]
                assert f.document(i).tolist() in [lib.encode(t, add_special_tokens=False).ids + [0] for t in texts]
        assert f.find(123_456_789) is None
    assert n == len(rows)


def test_an_empty_table_gives_an_empty_store(spark, docs):
    path = token_files.new_store(spark)
    token_files.write(docs.limit(0), path, **packing.public_vocabulary())
    assert token_files.read(spark, path).count() == 0 and token_files.manifest(spark, path).count() == 0


def test_a_torn_file_is_refused():
    b = token_files.FileBuilder(0, 0, 0, 2)
    b.add(7, array("I", [5, 0]).tobytes())
    data = bytes(b.finish())
    assert token_files.TokenFile(data + b"TEND").find(7) == 0
    with pytest.raises(ValueError):
        token_files.TokenFile(data[:-4] + b"TENX")
