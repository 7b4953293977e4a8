"""Personal data by weak supervision.

Candidate spans come from the four base patterns and from looser forms of
them. Labelers vote on each (yes, no or nothing): the base pattern, the
span's own validity, gazetteers, the words around it, and how it is cut out of
its surroundings. How reliable each labeler is for a kind is estimated without
labels, by expectation-maximisation over the counts of vote patterns; the
posteriors then train the final span classifier, a logistic regression on the
votes and the span's shape. It decides about the looser spans; base spans are
always reported.

A pattern of votes and shape has a bounded number of values, so the corpus
reaches the driver as a small table of counts over *all* candidates of all
texts, whatever their number. Two passes over the texts and no shuffle of
text: one counts patterns, one reports spans.

Every scan is linear in the text: emails are found from their ``@``, dotted
numbers and cards as whole runs (tests hold them against the plain patterns).

Defined cases: null text counts as empty (no spans); spans are in code points,
end exclusive; a looser span that overlaps a base span or an earlier looser
one is not reported; without candidates nothing is learned and only base
spans are reported; repeated rows are judged row by row; an empty table gives
no rows; other columns are ignored (as a stage: kept).
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import text_rows

KINDS = ("email", "ip", "card", "phone")
ORDER = {k: i for i, k in enumerate(KINDS)}

# --- base patterns ---------------------------------------------------------

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def base_emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    return out


def base_ips(text: str) -> list[tuple[int, int]]:
    """Numbers of four dotted parts, from the left of each dotted run."""
    out = []
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        at, parts = m.start(), m[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(ch for ch in s if "0" <= ch <= "9")


def base_cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = digits_of(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append(m.span())
    return out


def base_phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` by start, then kind as listed."""
    found = [(a, b, "email") for a, b in base_emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(a, b, "ip") for a, b in base_ips(text)]
        found += [(a, b, "card") for a, b in base_cards(text)]
        if "+" in text:
            found += [(a, b, "phone") for a, b in base_phones(text)]
    return sorted(found, key=lambda s: (s[0], ORDER[s[2]]))


# --- looser candidates -----------------------------------------------------

_LOOSE = (
    ("phone", re.compile(r"(?<![0-9])[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9])00[1-9][0-9]{0,2}(?:[ .-]?[0-9]){7,12}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])")),
)
_LOOSE_EMAIL = re.compile(r"[\w.+-]{1,64} ?[\[(]at[\])] ?[\w-]{1,63}(?: ?(?:\.|[\[(]dot[\])]) ?[\w-]{1,63}){1,8}", re.I)
_IPV6 = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])")


def loose_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    found = []
    if _DIGIT.search(text):
        for kind, pattern in _LOOSE:
            found += [(m.start() - (kind == "phone" and ")" in m[0] and text[m.start() - 1:m.start()] == "("),
                       m.end(), kind) for m in pattern.finditer(text)]
        if text.count(":") >= 7:
            found += [(*m.span(), "ip") for m in _IPV6.finditer(text)]
    low = text.lower() if "at)" in text or "at]" in text or "AT" in text else ""
    if "(at)" in low or "[at]" in low:
        found += [(*m.span(), "email") for m in _LOOSE_EMAIL.finditer(text)]
    # base spans by start, with the furthest end up to each: one look-up a
    # candidate, however many spans a text has
    starts = [a for a, _, _ in base]
    ends = list(accumulate((b for _, b, _ in base), max))
    out, last = [], 0
    for a, b, kind in sorted(found, key=lambda s: (s[0], ORDER[s[2]])):
        before = bisect_left(starts, b)
        if a >= last and (not before or ends[before - 1] <= a):
            out.append((a, b, kind))
            last = b
    return out


# --- labelers: 1 yes, -1 no, 0 nothing to say ------------------------------

# Words that announce a kind, and words that announce a number
# of another sort; common top-level domains.
CONTEXT = {
    "email": ("mail", "contact", "write", "reply", "from:", "to:"),
    "ip": ("ip", "host", "address", "server", "login", "from"),
    "card": ("card", "visa", "credit", "debit", "payment", "amex", "mastercard"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "whatsapp", "dial"),
}
OTHER_NUMBER = ("version", "isbn", "issn", "section", "chapter", "order", "page", "price", "id:", "no.", "fig")
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "it", "eu", "ch", "nl", "at")
ACCEPT = 0.8     # a looser span is reported from this probability on
LABELERS = ("pattern", "validity", "gazetteer", "context", "boundary")


def _validity(kind: str, span: str, d: str) -> int:
    if kind == "card":
        return 1 if 12 <= len(d) <= 19 and luhn(d) else -1
    if kind == "phone":
        return 1 if 9 <= len(d) <= 15 and len(set(d)) > 2 else -1
    if kind == "ip":
        return 1 if ":" in span or not any(len(p) > 1 and p[0] == "0" for p in span.split(".")) else -1
    return 1 if re.search(r"[A-Za-z]{2,}\s*$", span) else -1


def _gazetteer(kind: str, span: str, d: str) -> int:
    if kind == "email":
        return 1 if re.split(r"[.\s\])]+", span.lower().rstrip())[-1] in TOP_DOMAINS else 0
    if kind == "card":   # issuer's first digit
        return 1 if d[:1] in "3456" and d[:1] else -1
    if kind == "phone":  # no area or country code starts with 0, or 1 after a three-digit group
        if span.startswith("+"):
            return 1 if d[:1] != "0" else -1
        return 1 if d.startswith("00") or len(d) == 10 and d[0] in "23456789" and d[3] in "23456789" else -1
    return -1 if span.startswith(("0.", "255.")) else 0


def _context(kind: str, text: str, a: int, b: int) -> int:
    left = text[max(0, a - 32):a].lower()
    if any(w in left for w in OTHER_NUMBER):
        return -1
    return 1 if any(w in left for w in CONTEXT[kind]) else 0


def _boundary(text: str, a: int, b: int) -> int:
    before, after = text[a - 1:a], text[b:b + 1]
    return -1 if before.isalnum() or after.isalnum() or before in "/=_" and before or after in "/=_" and after else 1


def signature(text: str, a: int, b: int, kind: str, base: bool) -> tuple:
    """Kind, votes and shape of a candidate: what the models see."""
    span = text[a:b]
    d = digits_of(span)
    votes = (1 if base else 0, _validity(kind, span, d), _gazetteer(kind, span, d), _context(kind, text, a, b),
             _boundary(text, a, b))
    return (ORDER[kind], *votes, min(3, len(d) // 5), min(3, len(span) // 10))


# --- models ----------------------------------------------------------------

def reliabilities(counts: dict[tuple, int], rounds: int = 50) -> dict[tuple, float]:
    """Posterior of each signature by expectation-maximisation (two classes,
    votes independent given the class, per kind), from the votes' majority."""
    post = {}
    for kind in range(len(KINDS)):
        sigs = [s for s in counts if s[0] == kind]
        if not sigs:
            continue
        n = np.array([counts[s] for s in sigs], float)
        votes = np.array([s[1:1 + len(LABELERS)] for s in sigs]) + 1
        p = 1 / (1 + np.exp(-1.5 * (votes - 1).sum(axis=1)))
        for _ in range(rounds):
            like = np.zeros((2, len(sigs)))
            for c, w in enumerate((n * (1 - p), n * p)):
                like[c] = math.log((w.sum() + 1) / (n.sum() + 2))
                for j in range(len(LABELERS)):
                    t = np.bincount(votes[:, j], weights=w, minlength=3) + 1
                    like[c] += np.log(t / t.sum())[votes[:, j]]
            p = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
        if np.dot(n * (p - n.dot(p) / n.sum()), (votes - 1).sum(axis=1)) < 0:
            p = 1 - p
        post.update(zip(sigs, p.tolist()))
    return post


def _features(sig: tuple) -> np.ndarray:
    x = np.zeros(1 + 4 + 15 + 4 + 4)
    x[0] = 1
    x[1 + sig[0]] = 1
    for j, v in enumerate(sig[1:6]):
        x[5 + 3 * j + v + 1] = 1
    x[20 + sig[6]] = x[24 + sig[7]] = 1
    return x


def span_classifier(counts: dict[tuple, int], post: dict[tuple, float], steps: int = 400) -> dict[tuple, float]:
    """Logistic regression on signatures, trained on their posteriors; its
    probability for each."""
    sigs = sorted(counts)
    if not sigs:
        return {}
    x = np.array([_features(s) for s in sigs])
    y = np.array([post[s] for s in sigs])
    w = np.sqrt([counts[s] for s in sigs])   # a frequent pattern counts more, not alone
    w /= w.sum()
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ b))
        b -= 2.0 * (x.T @ (w * (p - y)) + 1e-4 * b)
    return dict(zip(sigs, (1 / (1 + np.exp(-x @ b))).tolist()))


def _count_signatures(batches):
    found: Counter = Counter()
    for _, texts in text_rows(batches):
        for text in texts:
            base = base_spans(text)
            for spans, is_base in ((base, True), (loose_spans(text, base), False)):
                for a, b, kind in spans:
                    found[signature(text, a, b, kind, is_base)] += 1
    yield pa.RecordBatch.from_arrays([pa.array([",".join(map(str, s)) for s in found], pa.string()),
                                      pa.array(list(found.values()), pa.int64())], names=["sig", "n"])


def learn(docs: DataFrame) -> dict[tuple, float]:
    """Probability of each signature that occurs in ``docs(text)``."""
    rows = (docs.select("text").mapInArrow(_count_signatures, "sig string, n long")
            .groupBy("sig").agg(F.sum("n").alias("n")).collect())    # bounded: signatures
    counts = {tuple(map(int, r["sig"].split(","))): r["n"] for r in rows}
    return span_classifier(counts, reliabilities(counts))


def find_spans(text: str, model: dict[tuple, float]) -> tuple[list, list]:
    """Base spans, and the looser ones that the classifier accepts."""
    base = base_spans(text)
    return base, [s for s in loose_spans(text, base)
                  if model.get(signature(text, *s, False), 0.0) >= ACCEPT]


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], ORDER[s[2]])))


RESULT = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
          "n_added long")


def detect(docs: DataFrame, model: dict[tuple, float]) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: counts of base spans by kind, the
    digest of their list, and the list of all spans."""
    def run(batches):
        types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64()]
        for part, texts in text_rows(batches):
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), texts):
                base, more = find_spans(text, model)
                n = Counter(k for _, _, k in base)
                rows.append((doc_id, *(n[k] for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(),
                             _joined(base + more), len(more)))
            cols = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             names=[c.split()[0] for c in RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


def redact_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Every span replaced by its kind in angle brackets; of overlapping
    spans the first, with what sticks out of the others."""
    out, at = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], ORDER[s[2]])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: dict[tuple, float]) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` and ``n_chars`` set to
    match (as a stage): all rows and columns; null texts stay null."""
    def run(batches):
        for part, texts in text_rows(batches):
            was = part.column("text").to_pylist()
            new = []
            for text, old in zip(texts, was):
                base, more = find_spans(text, model)
                new.append(old if old is None or not (base or more) else redact_text(text, base + more))
            i = part.schema.get_field_index("text")
            part = part.set_column(i, part.schema.field(i), pa.array(new, part.schema.field(i).type))
            i = part.schema.get_field_index("n_chars")
            if i >= 0:
                n = [c if old is t else len(t) for c, t, old in zip(part.column(i).to_pylist(), new, was)]
                part = part.set_column(i, part.schema.field(i), pa.array(n, part.schema.field(i).type))
            yield part

    return docs.mapInArrow(run, docs.schema)
