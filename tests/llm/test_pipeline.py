"""The pipeline against a brute-force version, and the registration."""

import random

import __spark_entry__ as E
import corpus_pipeline
from quire.llm import langid, packing, pii, queries
from test_dedup_and_search import brute_classes

WORDS = {"en": "the of and for that with this from have are was not but all can had her one our out day get has him",
         "de": "der die und das mit sich auf ist im dem den nicht ein eine als auch es an werden aus er hat dass sie"}


def corpus(spark, path):
    rnd = random.Random(8)
    rows = []
    for d in range(160):
        lang = rnd.choice(["en", "de"])
        text = " ".join(rnd.choice(WORDS[lang].split()) + rnd.choice(["", "", str(d)]) for _ in range(rnd.randint(8, 60)))
        if d % 9 == 0:
            text += f" write to user{d}@mail.example.org or +1 (212) 555-01{d % 90 + 10}"
        rows.append((d, text, lang if d % 11 else None))
    rows += [(200 + i, rows[i][1], "en") for i in range(0, 30, 3)]                       # copies
    near = "alpha beta gamma delta " + " ".join(f"n{i}" for i in range(80))
    rows += [(300 + i, near.replace(f"n{i * 3}", "changed"), "en") for i in range(9)]    # near copies
    rows += [(400, None, "en"), (401, "", None), (402, "12 34 !!", "de"), (403, "long text " * 3000, "en")]
    rows = [(d, t, lang, "s", None if t is None else len(t)) for d, t, lang in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{path}/documents.parquet")
    return rows


def test_every_stage_matches_brute_force(spark, tmp_dir):
    rows = corpus(spark, tmp_dir)
    docs = spark.read.parquet(f"{tmp_dir}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tmp_dir)
        out.write.parquet(f"{tmp_dir}/{name}")
        docs = spark.read.parquet(f"{tmp_dir}/{name}")
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r.doc_id: r for r in docs.collect()} if name != "best_fit_packing" else docs.collect())
    lang, exact, near, pii_, packed = kept
    # language ID: what has a letter stays, labelled rows keep their language
    assert set(lang) == {d for d, t, *_ in rows if any(c.isalpha() for c in t or "")}
    known = [(lang[d].lang, x) for d, t, x, *_ in rows if d in lang and x and d < 160]
    assert sum(a == b for a, b in known) >= 0.97 * len(known) and all(r.lang in ("en", "de") for r in lang.values())
    # exact dedup: the largest doc_id of equal texts
    last = {}
    for d in sorted(lang):
        last[lang[d].text] = d
    assert set(exact) == set(last.values())
    # near duplicates: the smallest doc_id of each class of linked texts
    assert set(near) == {c for _, c, _ in brute_classes([(d, r.text) for d, r in exact.items()])}
    assert len(near) < len(exact)
    # personal data: every row stays, its spans are gone and nothing else
    assert set(pii_) == set(near)
    for d, r in pii_.items():
        text = near[d].text
        assert r.text == pii.redact_text(text, pii.base_spans(text)) and r.n_chars == len(r.text)
    assert not any(pii.base_spans(r.text) for r in pii_.values()) and any("<EMAIL>" in r.text for r in pii_.values())
    # packing: all ids of all documents, gapless
    assert {r.doc_id for r in packed} == set(pii_)
    seqs = {}
    for r in packed:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for slots in seqs.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= packing.SEQ_LEN
    again = corpus_pipeline.run(spark, tmp_dir)
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in again.collect()) == sorted(
        (r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed)


def test_stages_and_queries_are_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_duplicates", "personal_data",
                                                      "best_fit_packing"]
    names = E.queries()
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert set(queries.ORACLES) == {"op2_url_filter", "op3_chat_format", "op4_exact_dedup", "op7_exact_top_k"}


def test_nothing_learned_from_an_empty_table(spark, tmp_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_dir}/documents.parquet")
    assert corpus_pipeline.run(spark, tmp_dir).count() == 0
    assert langid.train(spark.read.parquet(f"{tmp_dir}/documents.parquet")) is None
