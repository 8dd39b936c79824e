"""Quality rules: base text rules plus a hashed n-gram likelihood ratio.

The ratio compares two multinomials over hashed uni- and bigrams of word
and sign tokens: one counted over labelled good documents (the trusted
target), one over *all* documents.  A document's score is the sum of
``ln p_target - ln p_raw`` over its n-grams divided by their number, and every
document at or above the threshold is kept - no random draw.

Everything is a DataFrame expression: tokens, hashes and sums are row-local,
the counts are one aggregate over hash buckets with map-side combine.  The two
models together are ``buckets`` numbers whatever the size of the input.

Cases: a null text counts as empty; a text without tokens has no score and is
left to the base rules; rows are judged one by one, so repeated rows and ties
give equal verdicts; without any target document the ratio is not applied; an
empty table gives an empty result.  Input columns other than the id and the
text are neither read nor able to clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qtemplates.llm.common import double_array, hashed_sample, let, text_or_empty, words

#: Hash buckets of the two multinomials.
BUCKETS = 1 << 14
#: At most this many labelled documents make up the trusted target.
TARGET_DOCS = 20_000
#: Word tokens (ASCII letters and digits, everything from U+0080 on) and runs of other signs.
TOKEN = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[^0-9A-Za-z\x{80}-\x{10FFFF}\x00-\x20]+"
#: Documents whose mean log ratio is below this are rejected.
THRESHOLD = -0.25


def hashed(text: Column) -> Column:
    """64-bit hashes of the word and sign tokens of a text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda x: F.xxhash64(x))


def followed(h: Column) -> Column:
    """Hashes of neighbouring pairs (one fewer than there are hashes)."""
    rest = F.greatest(F.size(h) - 1, F.lit(0))
    return F.zip_with(F.slice(h, 1, rest), F.slice(h, 2, rest), lambda a, b: F.xxhash64(a, b))


def ngram_buckets(h: Column, buckets: int = BUCKETS) -> Column:
    """Bucket numbers (from 0) of all uni- and bigrams; ``h``: token hashes."""
    return F.transform(F.concat(h, followed(h)), lambda g: F.pmod(g, F.lit(buckets)))


def target_ids(labels: DataFrame, limit: int = TARGET_DOCS) -> DataFrame:
    """Ids of the trusted target: labelled good documents, at most ``limit``
    of them, taken in hash order."""
    ids = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return hashed_sample(ids, ["doc_id"], limit)


def fit(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[float] | None:
    """``ln p_target - ln p_raw`` per bucket, add-one smoothed; None when the
    target holds no n-gram.  ``target``: the bounded ids of ``target_ids``."""
    marked = (documents.select("doc_id", text_or_empty().alias("text"))
              .join(F.broadcast(target.withColumn("hit", F.lit(1))), "doc_id", "left"))
    grams = marked.select(F.coalesce("hit", F.lit(0)).alias("hit"), F.explode(let(hashed(F.col("text")), lambda h: ngram_buckets(h, buckets))).alias("b"))
    rows = grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("hit").alias("trusted")).collect()
    raw, trusted = [0] * buckets, [0] * buckets
    for r in rows:  # one row per bucket at most
        raw[r["b"]], trusted[r["b"]] = r["raw"], r["trusted"]
    if not sum(trusted):
        return None
    shift = math.log(sum(raw) + buckets) - math.log(sum(trusted) + buckets)
    return [math.log(t + 1) - math.log(r + 1) + shift for r, t in zip(raw, trusted, strict=True)]


def log_ratio(h: Column, model: list[float] | None) -> Column:
    """Length-normalised log likelihood ratio of a text with token hashes
    ``h``; null without n-grams or model."""
    if model is None:
        return F.lit(None).cast("double")
    table, n = double_array(model), F.size(h)
    return F.when(n > 0, F.aggregate(
        ngram_buckets(h, len(model)), F.lit(0.0), lambda s, b: s + F.get(table, b.cast("int"))) / (2 * n - 1))


def repeated_words(h: Column) -> Column:
    """Number of words inside 3-word windows that occur twice or more in the
    text, the first occurrence included.  ``h``: word hashes."""
    def marked(s):  # (window, position) sorted: repeated if a neighbour has its window
        return F.filter(F.transform(s, lambda x, i: F.when(
            (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["i"])), lambda p: p.isNotNull())

    def covered(p):
        return F.aggregate(F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3))),
                           F.lit(0), lambda s, x: s + x)

    def count(t):
        # equal neighbours among the sorted windows tell which occur again;
        # only texts that have any go on to positions
        pairs = F.transform(t, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(
            let(F.sort_array(pairs), lambda s: let(F.sort_array(marked(s)), covered)))

    rest = F.greatest(F.size(h) - 2, F.lit(0))
    return F.when(F.size(h) < 3, F.lit(0)).otherwise(let(
        F.zip_with(F.slice(followed(h), 1, rest), F.slice(h, 3, rest), lambda a, b: F.xxhash64(a, b)), count)).cast("long")


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def verdict(text: Column, model: list[float] | None, threshold: float = THRESHOLD) -> Column:
    """Struct: the base figures, ``base_failed``, ``score`` and ``kept``."""
    lines = F.filter(F.split(text, "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))

    def figures(w):
        return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"),
            repeated_words(h).alias("n_repeat_words"),
            let(hashed(text), lambda g: log_ratio(g, model)).alias("score")))

    def judged(f):
        return F.struct(*[f[c].alias(c) for c in FIGURES], f["failed"].alias("base_failed"), f["score"].alias("score"),
                        (~f["failed"] & (F.coalesce(f["score"], F.lit(0.0)) >= threshold)).alias("kept"))

    failed = lambda f: (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])
    return let(let(words(text), figures), lambda f: let(f.withField("failed", failed(f)), judged))


def judge(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base figures, base_failed, score and kept for every row."""
    model = fit(documents, target_ids(labels))
    v = documents.select("doc_id", verdict(text_or_empty(), model, threshold).alias("v"))
    return v.select("doc_id", "v.*")


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that pass, with all their columns unchanged."""
    model = fit(documents, target_ids(labels))
    return documents.filter(verdict(text_or_empty(), model, threshold)["kept"])
