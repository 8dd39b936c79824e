"""Column helpers that keep Python string semantics on Spark columns.

Python's ``str.strip()``, ``str.split()``, ``\\w`` and ``\\b`` are Unicode-aware;
Spark's ``trim`` only removes U+0020 and Java's ``\\w`` is ASCII unless the
``(?U)`` flag is on.  Every helper here returns a Column, so the work stays in
Catalyst / whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The missing-value spellings of the pandas CSV reader (pandas 2.x),
# in the order pandas documents them.
PANDAS_NA_VALUES = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Token classes shared by several operators (Unicode letters, digits, underscore).
WORD_CLASS = r"\p{L}\p{N}_"
NON_WORD_PUNCT = r"(?U)[^\p{L}\p{N}_\s]"
# What ``str.strip()`` removes: the characters of ``(?U)[\s\x1c-\x1f]``.
PY_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace.  A trim looks
    at both ends only; a pattern would be tried at every character."""
    return F.btrim(_c(col), F.lit(PY_SPACE))


def not_blank(col) -> Column:
    """``str.strip() != ''``, known at the first character that is not white space."""
    return _c(col).rlike(r"(?U)[^\s\x1c-\x1f]")


def py_strip_chars(col, chars: str) -> Column:
    """``str.strip(chars)``: remove any of ``chars`` at both ends."""
    return F.btrim(_c(col), F.lit(chars))


def py_split(col) -> Column:
    """``str.split()``: split on runs of Unicode whitespace, no empty items."""
    return F.filter(F.split(_c(col), r"(?U)[\s\x1c-\x1f]+", -1), lambda x: x != "")


def null_if_na(col) -> Column:
    """Null for every value the pandas reader would read as missing."""
    c = _c(col)
    return F.when(c.isin(PANDAS_NA_VALUES), F.lit(None).cast("string")).otherwise(c)


def normalize_template(col) -> Column:
    """Null -> '', strip, ``ECn``/``PCn`` (any case) -> ``EC``/``PC``,
    whitespace runs -> one space."""
    t = py_strip(F.coalesce(_c(col), F.lit("")))
    t = F.regexp_replace(t, r"(?iU)\b(ec)\d+\b", "EC")
    t = F.regexp_replace(t, r"(?iU)\b(pc)\d+\b", "PC")
    return F.regexp_replace(t, r"(?U)\s+", " ")


def first_n_words(col, n: int) -> Column:
    """First ``n`` whitespace words joined by one space; n <= 0 -> ''."""
    if n <= 0:
        return F.lit("")
    return F.array_join(F.slice(py_split(col), 1, n), " ")


def last_n_words(col, n: int) -> Column:
    """Last ``n`` whitespace words joined by one space; n <= 0 -> ''."""
    if n <= 0:
        return F.lit("")
    w = py_split(col)
    return F.array_join(F.slice(w, F.greatest(F.size(w) - F.lit(n - 1), F.lit(1)), F.lit(n)), " ")


def clean_line(col, numbering: str = "strict") -> Column:
    """Remove a leading list number, then strip space, quotes and newline.

    ``strict`` needs the ``.`` or ``)`` after the number; ``loose`` makes it
    optional, so ``3D models?`` loses its ``3``."""
    if numbering not in ("strict", "loose"):
        raise ValueError("numbering must be 'strict' or 'loose'")
    punct = "[.)]" if numbering == "strict" else "[.)]?"
    c = F.regexp_replace(_c(col), r"(?U)^\s*[\"']?\d+" + punct + r"\s*", "")
    return py_strip_chars(c, " \"'\n")


def has_word(col) -> Column:
    """Is there a letter, digit or underscore, so that a pattern exists?"""
    return _c(col).rlike(f"[{WORD_CLASS}]")


def opening(col, n: int = 5) -> Column:
    """The text up to the end of its ``n``-th word (punctuation alone is none)
    and one character more, or all of it if there are fewer words: what
    ``question_pattern`` needs of a text, however long.  Openings of texts with
    different patterns have the order of the texts, and the least opening of a
    pattern is that of its least text: a text whose opening is cut has white
    space there, so that no opening begins another one of another pattern
    unless it is a whole text."""
    word = rf"[^{WORD_CLASS}]*+[{WORD_CLASS}]\S*+"
    return F.regexp_extract(_c(col), rf"(?Us)^(?:(?:{word}){{{n}}}.?|.*)", 0)


def opening_pattern(opened, n: int = 5) -> Column:
    """K1 of a text with a word, from its ``opening``."""
    words = py_split(F.regexp_replace(_c(opened), NON_WORD_PUNCT, ""))
    return F.lower(F.array_join(F.slice(words, 1, n), " "))


def question_pattern(col, n: int = 5) -> Column:
    """K1: strip, drop punctuation, first ``n`` words, lower-cased; blank -> null."""
    return F.when(has_word(col), opening_pattern(opening(col, n), n))


def blank_to_null(col) -> Column:
    c = _c(col)
    return F.when(not_blank(c), c)


def text_lines(col) -> Column:
    """``str.split('\\n')`` keeping empty strings (an array column)."""
    return F.split(_c(col), "\n", -1)
