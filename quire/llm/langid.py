"""Language identification of whole, possibly mixed-language texts.

Every white-space word gets a score per language from character trigrams;
the script of its letters narrows the languages it can be (``SCRIPTS``). A
Viterbi pass over the words with a penalty for each switch labels spans; the
text's language is the one with most letters.

Learning: trigram counts per language over a bounded sample of labelled rows
(``PER_LANG`` texts of each language at most on average, chosen by a hash of
the id; their whole texts). Only a table of ``BUCKETS`` counts per language
reaches the driver, however large the sample.

Most texts stay in one language. Where no stretch of words, each in the best
other language for it, gains as much as one switch costs, the constant
labelling is the Viterbi path, so the pass itself only runs for texts where
some stretch does, many texts side by side.

Defined cases: null text or text without a letter: ``und``, score 0, no
spans; letters of a script no learned language uses: all languages compete;
nothing to learn from: ``und`` for all; equal scores: the alphabetically
first language; repeated rows and very long texts need nothing special; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import held_out, learnable, text_rows

PER_LANG = 4000
BUCKETS = 1 << 16
SWITCH_PENALTY = 12.0
SMOOTHING = 0.5
SCRIPT_SHARE = 0.01     # a language uses a script that has this share of its letters
CACHE_WORDS = 200_000

# First code point of each run and the script of its letters (a rough public
# division of the Basic Multilingual Plane; "" is any other).
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, ""), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, ""), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, ""),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, ""), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""),
    (0x2C60, "latin"), (0x2C80, ""), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"),
    (0x3190, ""), (0x31F0, "kana"), (0x3200, ""), (0x3400, "han"), (0xA000, ""), (0xAC00, "hangul"), (0xD7B0, ""),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB13, ""), (0xFB50, "arabic"), (0xFE00, ""), (0xFE70, "arabic"),
    (0xFF00, ""), (0xFF21, "latin"), (0xFF5B, ""), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, ""),
    (0x20000, "han"), (0x32000, ""),
]
_STARTS = [s for s, _ in SCRIPTS]


def script_of(letters: str) -> str:
    """Script of most letters (the first of equals)."""
    found: dict[str, int] = {}
    for ch in letters:
        s = "latin" if ch < "Ͱ" else SCRIPTS[bisect.bisect_right(_STARTS, ord(ch)) - 1][1]
        found[s] = found.get(s, 0) + 1
    return max(found, key=found.get)


def letters_of(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash buckets of the character trigrams around every letter of all
    words (given as letters, none empty; a word's ends are blanks), where each
    word's begin, and the words' code points."""
    text = f" {' '.join(words)} ".lower()
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) \
        + c[2:] * np.uint64(0x165667B19E3779F9)
    inner = c[1:-1] != 32
    begins = np.nonzero(c[:-2][inner] == 32)[0]
    return ((h[inner] >> np.uint64(40)) & np.uint64(BUCKETS - 1)).astype(np.int64), begins, c[1:-1][inner]


class Model:
    """log-probabilities ``table[bucket, language]`` and each script's mask
    of possible languages."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: dict[str, np.ndarray]):
        self.langs = langs
        totals = counts.sum(axis=0, keepdims=True)
        self.table = np.log((counts + SMOOTHING) / (totals + SMOOTHING * BUCKETS)).astype(np.float32)
        letters = np.maximum(sum(scripts.values(), np.zeros(len(langs))), 1)
        self.masks = {s: n >= SCRIPT_SHARE * letters for s, n in scripts.items()}

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (word, language) and numbers of letters of words given as
        letters; far below the rest where the script rules a language out."""
        buckets, begins, chars = trigrams(words)
        scores = np.add.reduceat(self.table[buckets], begins, axis=0)
        sizes = np.diff(np.append(begins, len(buckets)))
        other = np.add.reduceat((chars >= 0x370).astype(np.int64), begins) > 0
        for s, rows in [("latin", np.nonzero(~other)[0])] + [
                (script_of(words[i]), np.array([i])) for i in np.nonzero(other)[0].tolist()]:
            mask = self.masks.get(s)
            if mask is not None and mask.any() and not mask.all():
                low = scores[rows].min(axis=1, keepdims=True) - 50.0 * sizes[rows][:, None]
                scores[rows] = np.where(mask[None, :], scores[rows], low)
        return scores, sizes


def viterbi(texts: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best label per word of each text (words x languages) when each change
    of label costs ``penalty``; texts advance side by side, shorter ones
    drop out."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lens = np.array([len(texts[i]) for i in order])
    n, k = len(texts), texts[0].shape[1]
    padded = np.zeros((lens[0], n, k), np.float32)
    for j, i in enumerate(order):
        padded[:lens[j], j] = texts[i]
    best = np.zeros((lens[0], n), np.int32)
    moved = np.zeros((lens[0], n, k), bool)
    alive = np.searchsorted(-lens, -np.arange(1, lens[0] + 1), side="right")   # texts with more than t words
    v = padded[0].astype(np.float64)
    rows = np.arange(n)
    for t in range(1, lens[0]):
        d = alive[t]
        top = v[:d].argmax(axis=1)
        jump = v[rows[:d], top][:, None] - penalty
        m = jump > v[:d]
        best[t, :d], moved[t, :d] = top, m
        v[:d] = np.where(m, jump, v[:d]) + padded[t, :d]
    labels = np.zeros((lens[0], n), np.int32)
    last = v.argmax(axis=1)
    for t in range(lens[0] - 1, -1, -1):
        d = alive[t]
        labels[t, :d] = last[:d]
        if t:
            last[:d] = np.where(moved[t, rows[:d], last[:d]], best[t, :d], last[:d])
    out: list = [None] * n
    for j, i in enumerate(order):
        out[i] = labels[:lens[j], j]
    return out


SIDE_BY_SIDE = 400_000    # words, with padding, of texts that advance together


def label_words(texts: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The Viterbi labels of the words of each text."""
    out: list = [None] * len(texts)
    mixed = []
    for i, scores in enumerate(texts):
        best = int(scores.sum(axis=0).argmax())
        # the most that a stretch of words gains by leaving the one language, each word for the
        # best other: a path has a switch for every such stretch at least, so where that is less
        # than a switch costs, no path with switches is better
        others = scores.copy()
        others[:, best] = -np.inf
        c = np.zeros(len(scores) + 1)
        np.cumsum(others.max(axis=1) - scores[:, best], dtype=np.float64, out=c[1:])
        if scores.shape[1] == 1 or (c - np.minimum.accumulate(c)).max() < penalty:
            out[i] = np.full(len(scores), best, np.int32)
        else:
            mixed.append(i)
    mixed.sort(key=lambda i: len(texts[i]))
    while mixed:
        group = [mixed.pop()]      # the longest left, and as many as fit beside it
        room = SIDE_BY_SIDE // len(texts[group[0]]) - 1
        if room > 0:
            group, mixed = group + mixed[-room:], mixed[:-room]
        for i, labels in zip(group, viterbi([texts[i] for i in group], penalty)):
            out[i] = labels
    return out


class _Words(dict):
    """Word -> row in ``scores`` and ``sizes``. New words are numbered when
    met and scored together (``settle``)."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.start()

    def start(self) -> None:
        self.clear()
        self.n, self.new = 0, []
        self.scores = np.zeros((CACHE_WORDS, len(self.model.langs)), np.float32)
        self.sizes = np.zeros(CACHE_WORDS, np.int64)

    def __missing__(self, word: str) -> int:
        at, self.n = self.n, self.n + 1
        self.new.append(word)
        if len(word) <= 64:
            self[word] = at
        return at

    def settle(self) -> None:
        while self.n > len(self.sizes):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        at = self.n - len(self.new)
        letters = [letters_of(w) for w in self.new]
        rows = np.array([at + i for i, x in enumerate(letters) if x], np.int64)
        if len(rows):   # words without letters keep size 0 and equal scores
            self.scores[rows], self.sizes[rows] = self.model.score([x for x in letters if x])
        self.new = []

    def label(self, texts: list[str], penalty: float) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Per text the labels of its words and their numbers of letters;
        None if it has no letter."""
        if self.n > CACHE_WORDS // 2:
            self.start()
        found = [np.fromiter(map(self.__getitem__, t.split()), np.int64) for t in texts]
        self.settle()
        sizes = [self.sizes[idx] for idx in found]
        lettered = [i for i, size in enumerate(sizes) if size.any()]
        out: list = [None] * len(texts)
        for i, labels in zip(lettered, label_words([self.scores[found[i]] for i in lettered], penalty)):
            out[i] = (labels, sizes[i])
        return out


def _spans(text: str, labels: np.ndarray, langs: list[str]) -> list[dict]:
    """Runs of words of one language, in code points; words without letters
    go with the word before them."""
    if len(labels) and (labels == labels[0]).all():
        return [{"start": 0, "end": len(text), "lang": langs[labels[0]]}]
    out: list[dict] = []
    for m, lab in zip(re.finditer(r"\S+", text), labels.tolist()):
        if out and out[-1]["lang"] == langs[lab]:
            out[-1]["end"] = m.end()
        else:
            out.append({"start": m.start(), "end": m.end(), "lang": langs[lab]})
    return out


def _train_counts(langs: list[str]):
    def run(batches):
        counts = np.zeros((BUCKETS, len(langs)), np.int64)
        scripts: dict[str, np.ndarray] = {}
        for part, texts in text_rows(batches):
            lang_of = part.column(1).to_pylist()
            for i in set(lang_of):
                at = langs.index(i)
                words = Counter(w for t, lang in zip(texts, lang_of) if lang == i for w in t.split())
                pairs = [(x, n) for x, n in ((letters_of(w), n) for w, n in words.items()) if x]
                if not pairs:
                    continue
                times = np.array([n for _, n in pairs], np.int64)
                buckets, begins, chars = trigrams([x for x, _ in pairs])
                sizes = np.diff(np.append(begins, len(buckets)))
                counts[:, at] += np.bincount(buckets, np.repeat(times, sizes), BUCKETS).astype(np.int64)
                other = np.add.reduceat((chars >= 0x370).astype(np.int64), begins) > 0
                tally = Counter({"latin": int((sizes * times)[~other].sum())})
                for k in np.nonzero(other)[0].tolist():
                    tally[script_of(pairs[k][0])] += int(sizes[k] * times[k])
                for name, n in tally.items():
                    scripts.setdefault(name, np.zeros(len(langs), np.int64))[at] += n
        b, l = np.nonzero(counts)
        rows = [(l, [""] * len(b), b, counts[b, l])]
        for s, n in scripts.items():
            rows.append((np.arange(len(langs)), [s] * len(langs), np.full(len(langs), -1), n))
        for l, s, b, n in rows:
            yield pa.RecordBatch.from_arrays([pa.array(l, pa.int32()), pa.array(s, pa.string()),
                                              pa.array(b, pa.int32()), pa.array(n, pa.int64())],
                                             names=["lang", "script", "bucket", "n"])

    return run


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Model | None:
    """Learn from ``docs(doc_id, text, lang)``: rows to learn from with a
    language and a text. None if there are none."""
    rows = docs.filter(learnable() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return None
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, per_lang / sizes[lang]))])
    picked = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1_000_000)) / 1e6 < share[F.col("lang")])
    got = (picked.select("text", "lang").mapInArrow(_train_counts(langs), "lang int, script string, bucket int, n long")
           .groupBy("lang", "script", "bucket").agg(F.sum("n").alias("n")).toPandas())
    counts = np.zeros((BUCKETS, len(langs)))
    scripts: dict[str, np.ndarray] = {}
    for lang, s, b, n in zip(got["lang"], got["script"], got["bucket"], got["n"]):
        if b >= 0:
            counts[b, lang] = n
        else:
            scripts.setdefault(s, np.zeros(len(langs)))[lang] = n
    return Model(langs, counts, scripts)


RESULT = "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"


def detect(docs: DataFrame, model: Model | None, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, spans)`` per row of
    ``docs(doc_id, text)``; score is the language's share of the letters."""
    def run(batches):
        words = _Words(model) if model else None
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for part, texts in text_rows(batches, slice_rows=1024):
            preds, scores, spans = [], [], []
            labelled = words.label(texts, penalty) if words is not None else [None] * len(texts)
            for text, got in zip(texts, labelled):
                pred, score, runs = "und", 0.0, []
                if got:
                    labels, size = got
                    per = np.bincount(labels, weights=size, minlength=len(model.langs))
                    top = int(per.argmax())
                    pred, score = model.langs[top], float(per[top] / size.sum())
                    runs = _spans(text, labels, model.langs)
                preds.append(pred)
                scores.append(score)
                spans.append(runs)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(preds, pa.string()),
                                              pa.array(scores, pa.float64()), pa.array(spans, kind)],
                                             names=["doc_id", "held_out", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       held_out().alias("held_out")).mapInArrow(run, RESULT)


def relabel(docs: DataFrame, model: Model | None, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """``docs`` without the rows that have no letter and so no language, with
    ``lang`` set to the identified one (as a filter stage): all columns, one
    pass. Where there was nothing to learn from, ``lang`` stays as it is."""
    def run(batches):
        words = _Words(model) if model else None
        for part, texts in text_rows(batches, slice_rows=1024):
            preds, keep = [], []
            labelled = (words.label(texts, penalty) if words is not None
                        else [any(map(str.isalpha, t)) for t in texts])
            for got, lang in zip(labelled, part.column("lang").to_pylist()):
                keep.append(bool(got))
                preds.append(model.langs[int(np.bincount(got[0], weights=got[1]).argmax())] if words is not None and got else lang)
            out = part.set_column(part.schema.get_field_index("lang"), "lang", pa.array(preds, pa.string()))
            yield out.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
