"""Question-starter protection (Q1, Q2) as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qtemplates.functions.text import py_strip

# Single-word question starters (checked at token 0).
STARTER_WORDS = [
    "can", "do", "does", "did", "will", "would", "could", "should",
    "is", "are", "was", "were", "has", "have", "had",
    "what", "which", "when", "where", "who", "whom", "whose", "why", "how",
]

# Two-word question starters (checked at tokens 0-1).
STARTER_PAIRS = [
    ("how", "can"), ("how", "do"), ("how", "does"), ("how", "will"), ("how", "would"),
    ("how", "should"), ("how", "could"), ("how", "might"), ("how", "may"),
    ("what", "can"), ("what", "do"), ("what", "does"), ("what", "will"), ("what", "would"),
    ("when", "can"), ("when", "do"), ("when", "does"), ("when", "will"), ("when", "would"),
    ("where", "can"), ("where", "do"), ("where", "does"), ("where", "will"), ("where", "would"),
    ("why", "can"), ("why", "do"), ("why", "does"), ("why", "will"), ("why", "would"),
    ("which", "can"), ("which", "do"), ("which", "does"), ("which", "will"), ("which", "would"),
]

_META = set("\\.^$|?*+()[]{}")


def _escape(p: str) -> str:
    return "".join("\\" + ch if ch in _META else ch for ch in p)


def prefix_regex(prefixes: Sequence[str]) -> str:
    """One anchored alternation in list order; each alternative must be
    followed by a space or the end, so the first listed pattern wins."""
    alts = "|".join(f"(?:{_escape(p)})(?= |\\z)" for p in prefixes)
    return f"^({alts})"


def prefix_end(col, prefixes: Sequence[str], stripped: bool = False) -> Column:
    """Q1: length of the protected prefix of ``strip(lower(q))``, or null.

    ``stripped=True`` (the text has no surrounding whitespace) looks only at
    the first ``max pattern length + 1`` characters: a pattern cannot end at
    that cut, so the end-of-text alternative stays exact, and long texts are
    neither stripped nor lower-cased in full."""
    c = F.col(col) if isinstance(col, str) else col
    if stripped:
        width = max((len(p) for p in prefixes), default=0) + 1
        head = F.lower(F.substring(c, 1, width))
    else:
        head = F.lower(py_strip(c))
    m = F.regexp_extract(head, prefix_regex(prefixes), 1)
    return F.when(F.length(m) > 0, F.length(m)).cast("int")


def prefix_end_from(df: DataFrame, col: str, prefixes: DataFrame, out: str = "prefix_end") -> DataFrame:
    """Q1 with the protected prefixes as a table (pattern, rank) of any size:
    adds ``out``, the length of the pattern of smallest rank that the stripped,
    lower-cased text begins with (a space or the end must follow), or null.

    A text's candidates are its beginnings up to each of its first spaces, as
    many as the longest pattern has words; equal beginnings are looked up once
    by an equi-join, so neither the list nor a hot beginning is collected."""
    width = prefixes.agg(F.max(F.size(F.split("pattern", " ")))).first()[0] or 0  # one number
    head = F.lower(F.substring_index(py_strip(col), " ", width))  # the cut first: lower-casing ends at a space
    rows = df.withColumn("_head", head)
    cuts = F.transform(F.sequence(F.lit(1), F.size(F.split("_head", " "))), lambda i: F.call_function("substring_index", F.col("_head"), F.lit(" "), i))
    tried = rows.select("_head").filter(F.col("_head").isNotNull()).distinct().select("_head", F.explode(cuts).alias("pattern"))
    hits = tried.join(prefixes, "pattern").groupBy("_head").agg(F.min_by(F.length("pattern"), "rank").cast("int").alias(out))
    return rows.join(hits, "_head", "left").drop("_head")


def starter_flags(w0: Column, w1: Column, n: Column) -> tuple[Column, Column]:
    """Per-text constants of Q2: (first token is a starter word, first two
    tokens form a starter pair).  One hash-set lookup each."""
    sw0 = F.coalesce(w0.isin(STARTER_WORDS), F.lit(False))
    pair = F.coalesce((n > 1) & F.concat_ws(" ", w0, w1).isin([f"{a} {b}" for a, b in STARTER_PAIRS]), F.lit(False))
    return sw0, pair


def starter_at(i: Column, w0: Column, w1: Column, n: Column) -> Column:
    """Q2: is token ``i`` part of a question starter?  ``w0``/``w1`` are the
    lower-cased first two tokens, ``n`` the token count."""
    sw0, pair = starter_flags(w0, w1, n)
    return ((i == 0) & sw0) | ((i <= 1) & pair)
