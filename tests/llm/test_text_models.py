"""Chat formatting, personal data, toxicity, language ID."""

import hashlib
import random
import re

import numpy as np

from quire.llm import chat, langid, pii, toxicity

# ------------------------------------------------------------------- chat


def test_escaping_is_reversible_and_hides_control_strings():
    rnd = random.Random(1)
    for _ in range(3000):
        text = "".join(rnd.choice(["<", "|", "\\", ">", "im_end", "n", "\n", "é"]) for _ in range(rnd.randint(0, 10)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        role = text[:6]
        turn = chat.format_turn(role, [{"kind": "text", "text": text}])
        assert chat.read_turn(turn["formatted"]) == (role, text)


def test_conversations_read_back_from_the_output(spark):
    rows = [(1, 1, "assistant", "b <|im_end|>\n"), (1, 0, "user", "a"), (1, 2, "assistant", None), (2, 0, None, ""),
            (3, 5, "user", "tie b"), (3, 5, "user", "tie a"), (3, 5, "user", "tie a"), (None, 0, "user", "no id"),
            (4, 0, "assistant", "é" * 70_000),
            # ties that sort otherwise once formatted
            (5, 1, "user", "a b"), (5, 1, "user", "a"), (5, 2, "user", "<ax"), (5, 2, "user", "<|x"), (5, None, "user", "z")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, loss string")
    formatted = chat.format_conversations(chat.text_parts(df))
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    for conv, r in got.items():
        mine = [(role or "", text or "") for c, _, role, text in order if c == conv]
        turns = "".join(f"{role}\n{text}\n" for role, text in mine)
        loss = "".join(text for role, text in mine if role == "assistant")
        assert r.n_turns == len(mine) and r.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.format_turn(a, [{"text": t}])["formatted"]) for a, t in mine)
    assert chat.digests(chat.format_conversations(chat.text_parts(df.limit(0)))).count() == 0


def test_parts_become_ordered_placeholders_with_attachments():
    parts = [{"kind": "text", "text": "see <|image_1|> "}, {"kind": "image", "ref": "s3/a.png", "width": 57, "height": 28},
             {"kind": "audio", "ref": "b.wav", "seconds": 1.01}, {"kind": "text", "text": None},
             {"kind": "document", "ref": None, "pages": 3}, {"kind": None, "text": "end"}]
    turn = chat.format_turn("assistant", parts)
    assert turn["formatted"] == ("<|im_start|>assistant\nsee <\\|image_1|> <|image_1|><|audio_2|><|document_3|>end"
                                 "<|im_end|>\n")
    assert [(a["kind"], a["ref"], a["tokens"]) for a in turn["attachments"]] == [
        ("image", "s3/a.png", 3), ("audio", "b.wav", 26), ("document", "", 768)]
    for a in turn["attachments"]:
        assert turn["formatted"][a["at"]:].startswith(f"<|{a['kind']}_{a['n']}|>")
    masked = [turn["formatted"][s["start"]:s["end"]] for s in turn["loss"]]
    assert "".join(map(chat.unescape, masked)) == "see <|image_1|> end"    # placeholders carry no loss


def test_attachments_are_numbered_through_a_conversation_and_odd_sizes_are_one_unit(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0, "user", [("image", None, "a", 10, None, None, None), ("audio", None, "b", None, None, nan, None)]),
            (1, 1, "assistant", [("audio", None, "c", None, None, inf, None), ("image", None, "d", -5, 60, None, None)]),
            (2, 0, "user", [("document", None, "e", None, None, None, -1), ("audio", None, "f", None, None, -inf, None)])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = {(r.conv_id, r.turn): r for r in chat.format_conversations(df).collect()}
    assert [(a.n, a.ref, a.tokens) for k in sorted(got) for a in got[k].attachments] == [
        (1, "a", 1), (2, "b", 1), (3, "c", 1), (4, "d", 3), (1, "e", 256), (2, "f", 1)]
    assert "<|audio_3|><|image_4|>" in got[1, 1].formatted and "<|document_1|>" in got[2, 0].formatted


# --------------------------------------------------------------------- pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def keeps(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "phone":
            return 9 <= len(d) <= 15
        if kind == "card":
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1]))
            return 12 <= len(d) <= 19 and total % 10 == 0
        return True

    return sorted(((m.start(), m.end(), k) for k, p in PLAIN.items() for m in re.finditer(p, text) if keeps(k, m[0])),
                  key=lambda s: (s[0], list(PLAIN).index(s[2])))


def test_base_spans_are_those_of_the_plain_patterns():
    rnd = random.Random(6)
    pieces = ["@", ".", "a", "B.c", "-", "+", "1", "25", "256", " ", "(", ")", "4111 1111 1111 1111", "x@y.z", "@q.r",
              "10.0.0.1", ".7", "+1 (212) 555-0188", "é", "%", "_", "00"]
    for _ in range(20_000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 12)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_loose_spans_take_linear_time_and_never_overlap():
    import time

    line = "call 555-123-4567 or 0049 30 1234567, a@b.org, 10.0.0.1 and 4111 1111 1111 1111; "
    text = line * 30_000
    base = pii.base_spans(text)
    t = time.process_time()
    loose = pii.loose_spans(text, base)
    assert time.process_time() - t < 5 and len(loose) >= 30_000
    every = sorted((a, b) for a, b, _ in loose)
    assert all(x[1] <= y[0] for x, y in zip(every, every[1:]))
    short = line * 3
    base = pii.base_spans(short)
    assert not [1 for a, b, _ in pii.loose_spans(short, base) for x, y, _ in base if a < y and x < b]


def test_base_spans_take_linear_time():
    import time

    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+" * 400_000, "@" * 400_000, "a@" * 200_000):
        began = time.time()
        pii.base_spans(text)
        assert time.time() - began < 20


def test_votes_are_weighed_without_labels():
    # a labeler that is always right, one that guesses: EM tells them apart
    rnd = random.Random(2)
    counts = {}
    for _ in range(5000):
        y = rnd.random() < 0.5
        good = lambda p: (1 if y else -1) if rnd.random() < p else (-1 if y else 1)
        sig = (3, int(y), good(0.95), good(0.9), rnd.choice([-1, 0, 1]), good(0.8), 2, 1)
        counts[sig] = counts.get(sig, 0) + 1
    post = pii.reliabilities(counts)
    right = sum(n for s, n in counts.items() if (post[s] >= 0.5) == bool(s[1]))
    assert right > 0.97 * 5000
    model = pii.span_classifier(counts, post)
    assert sum(n for s, n in counts.items() if (model[s] >= 0.5) == bool(s[1])) > 0.95 * 5000
    assert pii.span_classifier({}, {}) == {}


def test_looser_spans_need_evidence_and_base_spans_stay(spark):
    rows = [(i, f"call me: +1 (212) 555-01{i:02d} or mail ann.{i}@mail.example.com from 10.0.{i}.7") for i in range(60)]
    rows += [(100, "phone (212) 555-0199 any time"), (101, "order no. 012-155-0199/7 of part 7444-4444-4444-4443_x"),
             (102, None), (103, ""), (104, "nothing here"), (100, "phone (212) 555-0199 any time")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.detect(df, pii.learn(df)).collect()}
    assert got[7].n_phone == 1 and got[7].n_email == 1 and got[7].n_ip == 1 and got[7].n_added == 0
    assert got[100].spans == "phone:6:20" and got[100].n_phone == 0 and got[101].spans == ""
    assert got[102].spans == got[103].spans == got[104].spans == ""
    assert got[102].base_sha256 == hashlib.sha256(b"").hexdigest()
    empty = df.limit(0)
    assert pii.learn(empty) == {} and pii.detect(empty, {}).count() == 0


def test_redaction_keeps_rows_and_columns(spark, docs):
    df = docs.unionByName(spark.createDataFrame(
        [(50, "ask bob@corp.example.org now", "en", "s", 28, 1, 1, "c")], docs.schema))
    out = pii.redact(df, pii.learn(df))
    assert out.columns == df.columns and out.count() == df.count()
    r = out.filter("doc_id = 50").first()
    assert (r.text, r.n_chars) == ("ask <EMAIL> now", 15)
    assert out.filter("doc_id = 0").first().text is None
    assert pii.redact_text("abcdef", [(0, 3, "email"), (2, 5, "ip")]) == "<EMAIL>f"


# ---------------------------------------------------------------- toxicity


def toxic_corpus(n=900):
    rnd = random.Random(9)
    clean = [f"{a}{b}" for a in ("mor", "tel", "san", "vir", "pol", "kre") for b in ("a", "en", "ist", "ung", "o", "ix")]
    bad = ["zukk", "brakk", "vurrk"]
    rows, labels = [], []
    for d in range(n):
        words = [rnd.choice(clean) for _ in range(rnd.randint(5, 60))]
        y = int(d % 3 == 0)
        for _ in range(3 * y):
            words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        rows.append((d, " ".join(words), rnd.choice(["en", "de", None])))
        labels.append((d, y))
    return rows, labels


def test_toxicity_separates_held_out_texts(spark):
    rows, labels = toxic_corpus()
    more = [(5000, None, "en"), (5001, "", None), (5002, "mora " * 60_000, "en"), (3, rows[3][1], "en")]
    df = spark.createDataFrame([(*r, 1) for r in rows + more], "doc_id long, text string, lang string, toxic int")
    marks = spark.createDataFrame(labels + [(3, 1), (7, None), (8000, 1)], "doc_id long, toxic int")
    model = toxicity.train(df, marks)
    got = toxicity.score_documents(df, model).collect()
    assert len(got) == len(rows) + len(more) and all(0 <= r.score <= 1 for r in got)
    y = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in y]
    assert len(held) > 100 and sum(r.predicted == y[r.doc_id] for r in held) > 0.97 * len(held)
    assert all(r.predicted == (r.score >= 0.5) for r in got)
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[5000] == by_id[5001] and by_id[5002] < 0.5
    # language and source of a row are no inputs
    other = toxicity.score_documents(df.selectExpr("doc_id", "text", "'xx' as lang"), model).collect()
    assert sorted((r.doc_id, r.score) for r in other) == sorted((r.doc_id, r.score) for r in got)


def test_thresholds_come_from_all_labelled_rows(spark):
    # 75 texts of each label train; the other labelled rows are many in both languages
    rows, labels = toxic_corpus()
    rows = [(d, (text if d % 2 else " ".join("x" + w for w in text.split()) + " xend"), "de" if d % 2 else "en")
            for d, text, _ in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"), train_docs=75)
    de, en, common = model.thresholds
    assert model.langs == ["de", "en"] and len({de, en, common}) > 1


def test_thresholds_keep_the_true_ratio_of_labels():
    # 40 toxic and 100 clean texts share a bin; 4 of 5 toxic ones were used for training
    counts = [(0, -5, 0, 500), (0, 10, 1, 40), (0, 10, 0, 100), (0, 30, 1, 60)]
    few, true = toxicity.thresholds(counts, [0, 0], 1), toxicity.thresholds(counts, [0, 400], 1)
    assert 10 / toxicity.BINS < few[0] <= 30 / toxicity.BINS and true[0] <= 10 / toxicity.BINS
    assert (true[0], few[0]) == (true[1], few[1])
    # a language with few toxic texts goes by all
    assert toxicity.thresholds(counts + [(1, 90, 1, 3), (1, 80, 0, 9)], [0, 0], 2)[1] == few[0]


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "a b", "en"), (2, None, None)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(df, none)
    assert [r.score for r in toxicity.score_documents(df, model).collect()] == [0.0, 0.0]
    assert toxicity.score_documents(df.limit(0), model).count() == 0


def test_pooled_filters_match_a_plain_loop():
    net = toxicity.Net()
    rnd = np.random.default_rng(3)
    docs = [rnd.integers(1, 500, (n, 2)).astype(np.int32) for n in (0, 1, 2, 7, 40)]
    for d, z in zip(docs, net.logits(docs)):
        x = net.inputs(np.concatenate([d, toxicity.PAD]))
        want = float(net.c)
        for i, k in enumerate(toxicity.WIDTHS):
            best = np.max([np.concatenate(x[t:t + k]) @ net.w[i] + net.b[i] for t in range(len(x) - k + 1)], axis=0)
            want += np.maximum(best, 0) @ net.v[i * toxicity.FILTERS:(i + 1) * toxicity.FILTERS]
        assert abs(z - want) < 1e-4


# ------------------------------------------------------------- language ID


def plain_viterbi(scores, penalty):
    n, k = scores.shape
    best = {(0, j): (scores[0, j], [j]) for j in range(k)}
    for t in range(1, n):
        for j in range(k):
            best[t, j] = max(((best[t - 1, i][0] - penalty * (i != j) + scores[t, j], best[t - 1, i][1] + [j])
                              for i in range(k)), key=lambda x: x[0])
    return max(best[n - 1, j][0] for j in range(k))


def test_labels_have_the_best_path_s_score():
    rnd = np.random.default_rng(5)
    for k in (1, 2, 3, 4):
        texts = [rnd.normal(0, 3, (rnd.integers(1, 9), k)).astype(np.float32) for _ in range(100)]
        for s, labels in zip(texts, langid.label_words(texts, 2.5)):
            got = s[np.arange(len(s)), labels].sum() - 2.5 * (labels[1:] != labels[:-1]).sum()
            assert abs(got - plain_viterbi(s, 2.5)) < 1e-3


def test_two_languages_beat_a_third_that_is_in_neither_half():
    s = np.array([[0, 10, -20], [0, -20, 10]], np.float32)
    assert [x.tolist() for x in langid.label_words([s], 12)] == [[1, 2]]
    # short texts whose best path seldom pays a switch
    rnd = np.random.default_rng(8)
    texts = [rnd.normal(0, 6, (rnd.integers(2, 6), 4)).astype(np.float32) for _ in range(400)]
    for s, labels in zip(texts, langid.label_words(texts, 12)):
        got = s[np.arange(len(s)), labels].sum() - 12 * (labels[1:] != labels[:-1]).sum()
        assert abs(got - plain_viterbi(s, 12)) < 1e-3


ENGLISH = "the quick brown fox jumps over the lazy dog and this is what they have been waiting for with great hope"
GERMAN = "der schnelle braune fuchs springt ueber den faulen hund und das ist worauf sie schon lange gewartet haben"
RUSSIAN = "быстрая лиса прыгает через ленивую собаку и это то чего они давно ждали"


def sentences(words, n, seed):
    rnd = random.Random(seed)
    words = words.split()
    return [" ".join(rnd.choice(words) for _ in range(rnd.randint(6, 25))) for _ in range(n)]


def test_language_of_held_out_and_mixed_texts(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate(
        [(t, "en") for t in sentences(ENGLISH, 60, 1)] + [(t, "de") for t in sentences(GERMAN, 60, 2)]
        + [(t, "ru") for t in sentences(RUSSIAN, 60, 3)])]
    mixed = " ".join(sentences(ENGLISH, 3, 4)) + " " + " ".join(sentences(RUSSIAN, 6, 5))
    odd = [(900, None, "en"), (901, "", None), (902, "123 !!", "de"), (903, mixed, None), (904, "日本語", None),
           (905, "собаку", None), (906, ENGLISH + " " + "hope " * 30_000, None), (None, ENGLISH, "en"), rows[0]]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "doc_id long, text string, lang string, score string")
    model = langid.train(df)
    assert model.langs == ["de", "en", "ru"]
    got = {r.doc_id: r for r in langid.detect(df, model).collect()}
    held = [(got[i].lang_pred, lang) for i, _, lang in rows if got[i].held_out]
    assert len(held) > 15 and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"} and got[902].score == 0
    assert got[903].lang_pred == "ru" and [s["lang"] for s in got[903].spans][0] == "en"
    assert 0 < got[903].score < 1 and got[904].lang_pred in model.langs and got[905].lang_pred == "ru"
    assert got[906].lang_pred == "en" and got[None].lang_pred == "en" and not got[None].held_out
    empty = df.limit(0)
    assert langid.train(empty) is None
    assert {r.lang_pred for r in langid.detect(df, None).collect()} == {"und"} and langid.detect(empty, model).count() == 0


def test_language_stage_drops_only_texts_without_letters(spark, docs):
    out = langid.relabel(docs, langid.train(docs))
    assert out.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in out.collect()) == [-1, 3, 3, 4, 5, 6, 7, 8, 10, 11]
    assert all(r.lang is not None for r in out.collect())
    kept = langid.relabel(docs, None)
    assert kept.count() == out.count() and kept.filter("doc_id = 5").first().lang is None
