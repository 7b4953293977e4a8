"""Toxicity scores from a small convolutional text classifier, in numpy.

A word is embedded by two hash tables (``BUCKETS`` rows of ``DIM`` numbers
each, so that words sharing a row in one rarely share it in the other).
Filters over one, two and three words, a rectifier and max pooling over the
whole text feed one output. Training is gradient descent (Adagrad) on a
bounded sample of labelled rows, at most ``TRAIN_DOCS`` of each label on
average, chosen by a hash of the id; their whole texts. The first number of
each embedding row starts from how much more often the row's words occur in
toxic texts of the sample; everything is then trained.

Thresholds are calibrated per language: a word table learned from the same
rows guesses a text's language from its words alone, and each language's
threshold becomes score 0.5. It has the fewest errors over all labelled rows
to learn from that gradient descent did not use, however many there are:
Spark scores them, and counts per language, score bin and label reach the
driver. A label's counts are raised by the rows that gradient descent took of
it, so that toxic and clean keep their true ratio at every size of the table.

Scoring is one pass over all texts, without a shuffle; the model (a few MB,
whatever the data) travels with the function.

Defined cases: null text counts as empty; an empty text gets the score of no
words; a doc_id labelled more than once counts as toxic if any label says so;
null labels are not learned from; with labels of one kind only, every score
is that label's share (0 or 1), and 0 without any; repeated rows score alike;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.chosen_path import _arrays, word_hashes
from quire.llm.shared import held_out, learnable

BUCKETS = 1 << 17
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
TRAIN_DOCS = 4000
EPOCHS = 3
RATE = 0.05
EMB_RATE = 0.01      # embeddings move slowly: a mislabelled text must not be learned by heart
MIN_SEEN = 5         # sample texts with a word before its ratio counts
MIN_TOXIC = 20       # toxic calibration texts before a language has its own threshold
KEPT_OUT = 0.2       # share of the sample that gradient descent leaves to calibration
BINS = 64            # score bins to 1 of the score before the threshold
BIN_LIMIT = 64 * BINS
SEED = 5
BATCH_WORDS = 200_000
PAD = np.zeros((max(WIDTHS), 2), np.int32)


def _slots(words: np.ndarray) -> np.ndarray:
    """Rows in the two hash tables of 64-bit word hashes; row 0 of each is
    padding (all zero)."""
    w = words.view(np.uint64)
    a = w % np.uint64(BUCKETS - 1) + np.uint64(1)
    b = (w >> np.uint64(33)) % np.uint64(BUCKETS - 1) + np.uint64(1)
    return np.stack([a, b], axis=1).astype(np.int32)


class Net:
    """The classifier: two embedding tables, filters by width, output."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.emb = rng.normal(0, 0.01, (2, BUCKETS, DIM)).astype(np.float32)
        self.emb[:, 0] = 0
        self.w = [rng.normal(0, 0.15, (k * 2 * DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        for k, w in zip(WIDTHS, self.w):   # every filter starts by looking at the informed numbers
            for j in range(k):
                w[j * 2 * DIM] = w[j * 2 * DIM + DIM] = 0.5 / k
        self.b = [np.full(FILTERS, -0.5, np.float32) for _ in WIDTHS]
        self.v = np.full(len(WIDTHS) * FILTERS, 0.2, np.float32)
        self.c = np.float32(-1.0)

    def inputs(self, slots: np.ndarray) -> np.ndarray:
        return np.concatenate([self.emb[0][slots[:, 0]], self.emb[1][slots[:, 1]]], axis=1)

    def convolve(self, x: np.ndarray, k: int, i: int) -> np.ndarray:
        """Filter values at each start of ``k`` words in ``x``."""
        n = len(x) - k + 1
        d = 2 * DIM
        out = x[:n] @ self.w[i][:d]
        for j in range(1, k):
            out += x[j:n + j] @ self.w[i][j * d:(j + 1) * d]
        return out + self.b[i]

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        """Scores before the threshold of texts given as slots. Every text is
        followed by padding; windows that reach beyond it are left out, so a
        score never depends on the texts around."""
        if not docs:
            return np.zeros(0)
        ends = np.cumsum([len(d) + len(PAD) for d in docs])
        starts = np.concatenate([[0], ends[:-1]])
        x = self.inputs(np.concatenate([p for d in docs for p in (d, PAD)] + [PAD]))
        total = np.full(len(docs), self.c, np.float64)
        for i, k in enumerate(WIDTHS):
            y = self.convolve(x, k, i)[:ends[-1]]
            for j in range(1, k):
                y[ends - j] = -np.inf
            y = np.maximum.reduceat(y, starts, axis=0)
            total += np.maximum(y, 0) @ self.v[i * FILTERS:(i + 1) * FILTERS]
        return total

    def fit(self, docs: list[np.ndarray], labels: np.ndarray) -> None:
        """Adagrad over the texts in a fixed shuffled order, one at a time;
        only the windows that won the pooling get a gradient."""
        rng = np.random.default_rng(SEED)
        g_emb = np.full((2, BUCKETS), 1e-2, np.float32)
        g_w = [np.full(w.shape, 1e-2, np.float32) for w in self.w]
        g_v = np.full(self.v.shape, 1e-2, np.float32)
        d = 2 * DIM
        weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
        for _ in range(EPOCHS):
            for n in rng.permutation(len(docs)).tolist():
                slots = np.concatenate([docs[n], PAD])
                x = self.inputs(slots)
                tops, wins = [], []
                for i, k in enumerate(WIDTHS):
                    y = self.convolve(x, k, i)
                    at = y.argmax(axis=0)
                    wins.append(at)
                    tops.append(y[at, np.arange(FILTERS)])
                pooled = np.maximum(np.concatenate(tops), 0)
                p = 1 / (1 + np.exp(-np.clip(self.c + pooled @ self.v, -30, 30)))
                err = np.float32((p - labels[n]) * weight[n])
                if abs(err) < 1e-3:
                    continue
                grad_v, back = err * pooled, err * self.v * (pooled > 0)
                g_v += grad_v ** 2
                for i, k in enumerate(WIDTHS):
                    g = back[i * FILTERS:(i + 1) * FILTERS]
                    idx = wins[i][:, None] + np.arange(k)[None, :]          # filters x k words
                    xin = x[idx].reshape(FILTERS, k * d)
                    gx = (self.w[i].T * g[:, None]).reshape(FILTERS * k, 2, DIM)
                    gw = (xin * g[:, None]).T
                    g_w[i] += gw ** 2
                    self.w[i] -= RATE * gw / np.sqrt(g_w[i])
                    self.b[i] -= 0.1 * RATE * g
                    hit = slots[idx.ravel()]
                    for h in (0, 1):
                        rows = hit[:, h]
                        np.add.at(g_emb[h], rows, (gx[:, h] ** 2).sum(axis=1))
                        np.subtract.at(self.emb[h], rows, EMB_RATE * gx[:, h] / np.sqrt(g_emb[h][rows])[:, None])
                        self.emb[h, 0] = 0
                self.v = np.maximum(self.v - RATE * grad_v / np.sqrt(g_v), 0)
                self.c -= np.float32(0.1 * RATE * err)


def _inform(net: Net, docs: list[np.ndarray], labels: np.ndarray) -> None:
    """Start each embedding row's first number from the log ratio of toxic to
    other texts that use it (shrunk, 0 where it says little)."""
    seen = np.zeros((2, 2, BUCKETS))
    for d, y in zip(docs, labels.tolist()):
        for h in (0, 1):
            seen[h, y, np.unique(d[:, h])] += 1
    pos, neg = max(labels.sum(), 1), max((labels == 0).sum(), 1)
    for h in (0, 1):
        ratio = np.log((seen[h, 1] / pos + 1e-3) / (seen[h, 0] / neg + 1e-3))
        net.emb[h, :, 0] = np.clip(ratio / 2, -1, 2.5) * (seen[h].sum(axis=0) >= MIN_SEEN)
        net.emb[h, 0] = 0


class Model:
    def __init__(self, net: Net | None, base: float, langs: list[str], words: np.ndarray | None,
                 thresholds: np.ndarray, scale: float):
        self.net, self.base, self.langs, self.words = net, base, langs, words
        self.thresholds, self.scale = thresholds, scale

    def languages(self, docs: list[np.ndarray]) -> np.ndarray:
        """Guessed language of each text, by its words (the last row of
        ``thresholds`` is for texts without words)."""
        out = np.full(len(docs), len(self.langs))
        full = [i for i, d in enumerate(docs) if len(d)]
        if full and len(self.langs):
            flat = self.words[np.concatenate([docs[i][:, 0] for i in full])]
            starts = np.cumsum([0] + [len(docs[i]) for i in full[:-1]])
            out[full] = np.add.reduceat(flat, starts, axis=0).argmax(axis=1)
        return out

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        if self.net is None:
            return np.full(len(docs), self.base)
        z = (self.net.logits(docs) - self.thresholds[self.languages(docs)]) * self.scale
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _threshold(bins: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """Cut with the fewest errors, in the middle of its gap, over the numbers
    of toxic and clean texts in ascending score bins."""
    errors = np.concatenate([[0], np.cumsum(toxic)]) + np.concatenate([np.cumsum(clean[::-1])[::-1], [0]])
    best = np.nonzero(errors <= errors.min() + 1e-9 * (toxic.sum() + clean.sum()))[0]
    i = int(best[len(best) // 2])
    lo = (bins[i - 1] + 1) / BINS if i else bins[0] / BINS - 2.0
    hi = bins[i] / BINS if i < len(bins) else (bins[-1] + 1) / BINS + 2.0
    return float((lo + hi) / 2)


def thresholds(counts: list[tuple[int, int, int, int]], used: list[int], langs: int) -> np.ndarray:
    """Per guessed language (and for texts without words) the threshold, from
    ``(language, bin, toxic, n)`` and the numbers of clean and toxic texts
    that gradient descent used."""
    c = np.array(counts, np.int64).reshape(-1, 4)
    seen = np.array([c[c[:, 2] == y, 3].sum() for y in (0, 1)])
    weight = (seen + np.array(used)) / np.maximum(seen, 1)

    def cut(rows: np.ndarray) -> float:
        bins, at = np.unique(rows[:, 1], return_inverse=True)
        n = [weight[y] * np.bincount(at, rows[:, 3] * (rows[:, 2] == y), len(bins)) for y in (0, 1)]
        return _threshold(bins, n[1], n[0])

    out = np.full(langs + 1, cut(c) if len(c) else 0.0)
    for i in range(langs):
        mine = c[c[:, 0] == i]
        if mine[mine[:, 2] == 1, 3].sum() >= MIN_TOXIC and (mine[:, 2] == 0).any():
            out[i] = cut(mine)
    return out


def fit(docs: list[np.ndarray], labels: np.ndarray, langs_of: list[str | None], kept_out: np.ndarray) -> Model:
    """Train on texts as slots but those kept out; thresholds are still 0."""
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(None, float(labels.mean()) if len(labels) else 0.0, [], None, np.zeros(1), 1.0)
    net = Net()
    train = [d for d, k in zip(docs, kept_out) if not k]
    _inform(net, train, labels[~kept_out])
    net.fit(train, labels[~kept_out])
    langs = sorted({x for x in langs_of if x})
    counts = np.full((BUCKETS, max(len(langs), 1)), 0.5)
    for d, lang in zip(docs, langs_of):
        if lang:
            np.add.at(counts[:, langs.index(lang)], d[:, 0], 1)
    words = np.log(counts / counts.sum(axis=0, keepdims=True)).astype(np.float32)
    return Model(net, 0.0, langs, words, np.zeros(len(langs) + 1), 1.0)


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Learn from ``docs(doc_id, text, lang)`` and ``labels(doc_id, toxic)``;
    the driver gets the sample's word hashes, at most ``2 * train_docs``
    texts on average, and the counts that set the thresholds."""
    marked = (labels.filter(learnable() & F.col("toxic").isin(0, 1)).groupBy("doc_id")
              .agg(F.max("toxic").alias("toxic")))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, train_docs / max(sizes.get(1, 0), 1)))).otherwise(
        F.lit(min(1.0, train_docs / max(sizes.get(0, 0), 1))))

    def hashed(salt):
        return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000)) / 1e6

    marked = marked.withColumn("used", (hashed("toxicity") < share) & (hashed("calibration") >= KEPT_OUT))
    picked = marked.filter(hashed("toxicity") < share)
    # the sample is bounded by train_docs, so it is broadcast
    rows = (docs.select("doc_id", "text", "lang").join(F.broadcast(picked), "doc_id").filter(F.col("text").isNotNull())
            .select("doc_id", "toxic", "used", "lang", word_hashes(F.col("text")).alias("words")).toArrow())
    order = np.lexsort((rows.column("words").combine_chunks().value_lengths().to_numpy(zero_copy_only=False),
                        rows.column("doc_id").to_numpy()))
    words = _arrays(rows.column("words"))
    labels_ = rows.column("toxic").to_numpy().astype(np.int64)[order]
    langs = rows.column("lang").to_pylist()
    kept_out = ~rows.column("used").to_numpy(zero_copy_only=False).astype(bool)[order]
    if len(set(labels_[~kept_out].tolist())) < 2 or len(set(labels_[kept_out].tolist())) < 2:
        # too few to keep any apart: all rows train and calibrate
        kept_out[:] = False
        marked = marked.withColumn("used", F.lit(False))
    model = fit([_slots(words[i]) for i in order], labels_, [langs[i] for i in order], kept_out)
    return model if model.net is None else calibrate(model, docs, marked)


def calibrate(model: Model, docs: DataFrame, marked: DataFrame) -> Model:
    """``model`` with thresholds from all texts of ``marked(doc_id, toxic,
    used)``; those that gradient descent used count for the ratio only."""
    def bins(slots):
        at = np.floor(np.clip(model.net.logits(slots) * BINS, -BIN_LIMIT, BIN_LIMIT)).astype(np.int64)
        return np.stack([model.languages(slots), at], axis=1)

    def run(batches):
        for part, got in _per_text(batches, bins):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got[:, 0], pa.int32()),
                                              pa.array(got[:, 1], pa.int32())], names=["doc_id", "guess", "bin"])

    # texts are scored where they are read; ids and bins alone move to meet the labels
    scored = (docs.filter(learnable() & F.col("text").isNotNull())
              .select(F.col("doc_id").cast("long").alias("doc_id"), word_hashes(F.col("text")).alias("words"))
              .mapInArrow(run, "doc_id long, guess int, bin int"))
    rows = (scored.join(marked, "doc_id")
            .groupBy("used", "toxic", F.when(~F.col("used"), F.col("guess")).alias("guess"),
                     F.when(~F.col("used"), F.col("bin")).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect())
    used = [sum(r["n"] for r in rows if r["used"] and r["toxic"] == y) for y in (0, 1)]
    model.thresholds = thresholds([(r["guess"], r["bin"], r["toxic"], r["n"]) for r in rows if not r["used"]],
                                  used, len(model.langs))
    return model


def _per_text(batches, f):
    """Arrow slices and ``f`` of their texts (the last column, as slots),
    called for a bounded number of words at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            docs, got, size = [], [], 0
            for w in _arrays(part.column(part.num_columns - 1)):
                docs.append(_slots(w))
                size += len(w)
                if size > BATCH_WORDS:
                    got.append(f(docs))
                    docs, size = [], 0
            if docs or not got:
                got.append(f(docs))
            yield part, np.concatenate(got)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs(doc_id,
    text)``."""
    def run(batches):
        for part, s in _per_text(batches, model.scores):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s),
                                              pa.array((s >= 0.5).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
                       word_hashes(F.col("text")).alias("words")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")
