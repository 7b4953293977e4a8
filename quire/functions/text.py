"""Column expressions over text and metadata fields.

Every function takes and returns ``pyspark.sql.Column`` objects built from
built-in functions, so they stay inside whole-stage codegen. No Python UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import fixed

# Unicode whitespace as understood by Python's ``str.strip``/``\s``: Java's
# and RE2's ``\s`` are ASCII-only, so the class is spelled out. The same text
# works in Spark (Java regex) and DuckDB (RE2).
WS = (r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
STRIP_RE = f"^[{WS}]+|[{WS}]+$"
RUN_RE = f"[{WS}]+"
NOT_WORD_RE = f"[^a-z0-9{WS}]"
# The same whitespace as a plain character list, for translate(): mapping
# every one of them to " " first lets the regexes use cheap ASCII classes.
WS_CHARS = "".join(chr(c) for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                                    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


#: the characters that H1 keeps
KEPT = "abcdefghijklmnopqrstuvwxyz0123456789 "


def _plain(c: Column) -> Column:
    """Lower case, white space as blanks, only [a-z0-9 ] left. What is to go
    is the text without the kept characters; deleting just that takes two
    cheap passes (a negated character class costs ten times as much)."""
    s = _blanks(F.lower(c))
    return F.call_function("translate", s, F.translate(s, KEPT, ""), F.lit(""))


def _blanks(c: Column) -> Column:
    """Every Unicode whitespace character becomes a plain space."""
    return F.translate(c, WS_CHARS, " " * len(WS_CHARS))


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Trim Unicode whitespace at both ends (inner characters unchanged)."""
    return F.regexp_replace(_c(c), STRIP_RE, "")


def collapse_ws(c) -> Column:
    """H3: trim, then collapse every whitespace run to one blank."""
    return F.trim(F.regexp_replace(_blanks(_c(c)), " {2,}", " "))


def normalize_title(c) -> Column:
    """H1: lower, trim, drop all but [a-z0-9 whitespace], collapse runs.

    There is no trim at the end: ``"Hello !"`` becomes ``"hello "``.
    """
    # outer blanks go before, not after, the other characters: they are
    # trimmed where they are, then everything else follows in one pass
    s = _plain(F.trim(_blanks(_c(c))))
    return F.regexp_replace(s, " {2,}", " ")


def word_set(c, normalized: bool = False) -> Column:
    """H2 part 1: distinct non-empty words of the normalised title.

    From raw text the trim and collapse steps of H1 do not change the word
    set, so this drops runs of other characters and splits on whitespace
    runs directly (one regex pass instead of three)."""
    # no higher-order functions: they are interpreted with all that is below
    # them, and the text would be normalised again for each use
    if normalized:
        return F.array_distinct(F.array_remove(F.split(_c(c), " "), ""))
    return F.array_distinct(F.array_remove(F.split(_plain(_c(c)), " "), ""))


def jaccard(a_words, b_words) -> Column:
    """H2/U4: |A n B| / |A u B| of two word arrays; 0.0 if either is empty."""
    a, b = _c(a_words), _c(b_words)
    inter = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return (F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
            .otherwise(inter.cast("double") / union.cast("double")))


def title_similarity(a, b) -> Column:
    """H2: word-set Jaccard of two raw titles."""
    return jaccard(word_set(a), word_set(b))


def truncate(c, n: int = fixed.ABSTRACT_MAX_CHARS) -> Column:
    """H4: first ``n`` code points."""
    return F.substring(_c(c), 1, n)


def strip_markup_after_truncate(c, n: int = fixed.ABSTRACT_MAX_CHARS) -> Column:
    """H5: cut to ``n`` characters first, then drop ``<...>`` tags; a tag
    cut by the truncation stays."""
    return F.regexp_replace(truncate(c, n), "<[^>]+>", "")


def arxiv_id_from_url(c) -> Column:
    """H6: text after the last ``/abs/``, trailing version removed."""
    return F.regexp_replace(F.element_at(F.split(_c(c), "/abs/"), -1), "v[0-9]+$", "")


def year_of_iso(c) -> Column:
    """H7: year of an ISO date string (null if not numeric)."""
    return F.substring(_c(c), 1, 4).try_cast("int")


def month_of_iso(c) -> Column:
    """H7: month of an ISO date string; 0 when missing or not numeric."""
    return F.coalesce(F.when(F.length(_c(c)) >= 7, F.substring(_c(c), 6, 2).try_cast("int")), F.lit(0))


def year_month_of_parts(parts) -> tuple[Column, Column]:
    """H7: year and month of a ``[[year, month, ...]]`` date; 0 when absent."""
    first = F.get(_c(parts), 0)
    return F.coalesce(F.get(first, 0), F.lit(0)), F.coalesce(F.get(first, 1), F.lit(0))


def non_empty_names(c) -> Column:
    """H8: the names of an array of strings, null and empty ones dropped."""
    return F.filter(_c(c), lambda x: x.isNotNull() & (x != ""))


def given_family_names(c) -> Column:
    """H8: ``given + " " + family`` per author struct, stripped, blanks dropped."""
    return F.filter(
        F.transform(_c(c), lambda a: strip_ws(F.concat_ws(
            " ", F.coalesce(a["given"], F.lit("")), F.coalesce(a["family"], F.lit(""))))),
        lambda x: x != "")


def first_non_empty(*cols) -> Column:
    """H9: first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in cols])


def empty_to_null(c) -> Column:
    return F.nullif(_c(c), F.lit(""))


def last_link_with_title(links, title: str = "pdf") -> Column:
    """Href of the last ``<link>`` whose title attribute equals ``title``."""
    hits = F.filter(_c(links), lambda x: x["_title"] == title)
    return F.when(F.size(hits) > 0, F.element_at(hits, -1)["_href"])


def authors_short(c, k: int = 3) -> Column:
    """First ``k`` authors joined by ", " plus `` + N more``."""
    a = _c(c)
    return F.concat(
        F.array_join(F.slice(a, 1, k), ", "),
        F.when(F.size(a) > k, F.concat(F.lit(" + "), (F.size(a) - k).cast("string"), F.lit(" more")))
        .otherwise(F.lit("")))


def category_labels(c, k: int = 4) -> Column:
    """First ``k`` category ids with dashes shown as blanks."""
    return F.transform(F.slice(_c(c), 1, k), lambda x: F.regexp_replace(x, "-", " "))


def year_month(year, month) -> Column:
    """``YYYY`` or ``YYYY-MM`` when a month is known."""
    m = _c(month)
    return F.concat(_c(year).cast("string"),
                    F.when(m.isNotNull() & (m != 0), F.concat(F.lit("-"), F.lpad(m.cast("string"), 2, "0")))
                    .otherwise(F.lit("")))


def or_manual(c) -> Column:
    """Metadata default."""
    return F.coalesce(empty_to_null(c), F.lit("manual"))


def external_id_rows(ext) -> Column:
    """Non-empty external ids as an array of (key, value) structs, in
    field order."""
    e = _c(ext)
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), e[k].alias("value"))
                      for k in fixed.EXTERNAL_ID_KEYS])
    return F.filter(pairs, lambda p: p["value"].isNotNull() & (p["value"] != ""))
