"""Coverage of test templates by train templates.

A test template is *covered* at a level when its key (the full normalised
template, its first N words or its last N words) equals the key of some
train template.  All levels are computed in one pass: both sides explode one
row per (match_type, n_words, key) tagged with their side, and a single
aggregate on (match_type, n_words, key) -- partial on the map side, so a hot
key such as a common five-word opening is reduced before the shuffle --
decides every level at once; no join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qtemplates.functions.text import normalize_template, py_split
from qtemplates.sources.io import require_columns

FORWARD_LEVELS = (11, 10, 9, 8, 7, 6, 5)
BACKWARD_LEVELS = (5, 6, 7, 8, 9, 10, 11)
FULL, FORWARD, BACKWARD = "full_exact", "forward_first_n", "backward_last_n"

SUMMARY_SCHEMA = "match_type STRING, n_words INT, matched BIGINT, total BIGINT, coverage_pct DOUBLE"


def level_list(forward=FORWARD_LEVELS, backward=BACKWARD_LEVELS, full: bool = True):
    # full_exact carries n_words 0 inside the plan (a plain equi-join key);
    # it is shown as null in the summary
    out = [(FULL, 0)] if full else []
    out += [(FORWARD, int(n)) for n in forward]
    out += [(BACKWARD, int(n)) for n in backward]
    return out


def _key_of(norm: Column, words: Column, match_type: str, n: int | None) -> Column:
    if match_type == FULL:
        return norm
    if n <= 0:
        return F.lit("")
    if match_type == FORWARD:
        return F.array_join(F.slice(words, 1, n), " ")
    return F.array_join(F.slice(words, F.greatest(F.size(words) - F.lit(n - 1), F.lit(1)), F.lit(n)), " ")


def level_keys(norm: Column, levels) -> Column:
    """Array of (match_type, n_words, key) structs, one per level.  The word
    list of the normalised template is split once and shared by all levels."""
    from qtemplates.operators.annotate import let

    def build(words):
        return F.array(*[
            F.struct(F.lit(mt).alias("match_type"), F.lit(n).cast("int").alias("n_words"),
                     _key_of(norm, words, mt, n).alias("key"))
            for mt, n in levels])
    return let(py_split(norm), build)


def default_order(templ_col: str) -> Column:
    """Train file order stand-in: templates sorted by length, then text."""
    return F.struct(F.length(templ_col).alias("len"), F.col(templ_col).alias("txt"))


def train_levels(train: DataFrame, templ_col: str, levels, order_by: Column | None) -> DataFrame:
    """(match_type, n_words, key, norm, _ord) of every train template."""
    order_by = default_order(templ_col) if order_by is None else order_by
    return (train.filter(F.col(templ_col).isNotNull())
                 .select(normalize_template(templ_col).alias("norm"), order_by.alias("_ord"))
                 .select("norm", "_ord", F.explode(level_keys(F.col("norm"), levels)).alias("l"))
                 .select("l.*", "norm", "_ord")
                 .filter(F.col("key") != ""))


def build_lookup(train: DataFrame, templ_col: str = "templated_question", levels=None,
                 order_by: Column | None = None) -> DataFrame:
    """(match_type, n_words, key) -> first normalised train template with that key."""
    levels = level_list() if levels is None else levels
    return (train_levels(train, templ_col, levels, order_by)
            .groupBy("match_type", "n_words", "key")
            .agg(F.min_by("norm", "_ord").alias("matched_train_template")))


def _test_levels(test: DataFrame, templ_col: str, levels) -> DataFrame:
    return (test.filter(F.col(templ_col).isNotNull())
                .select(F.col(templ_col), normalize_template(templ_col).alias("normalized_template"))
                .select("*", F.explode(level_keys(F.col("normalized_template"), levels)).alias("l"))
                .select(F.col(templ_col), "normalized_template", "l.*"))


def _levels_frame(spark, levels) -> DataFrame:
    return spark.createDataFrame(levels, "match_type STRING, n_words INT")


def _level_code() -> Column:
    return F.xxhash64("match_type", "n_words").alias("level")


def tagged_keys(train: DataFrame, test: DataFrame, templ_col: str = "templated_question", levels=None) -> DataFrame:
    """(level, k1, k2, cnt, has_train) of both sides' keys, one row each: a
    train row counts nothing and has_train 0, a test row counts 1 and has 1.
    What is shuffled later is a level code and 128 hash bits, not the texts."""
    levels = level_list() if levels is None else levels
    keys = [_level_code(), F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2")]
    side = lambda df, k: df.select(*keys, F.lit(k).cast("long").alias("cnt"), F.lit(k).alias("has_train"))
    return side(train_levels(train, templ_col, levels, F.lit(0)), 0).unionByName(side(_test_levels(test, templ_col, levels), 1))


def covered_keys(tagged: DataFrame) -> DataFrame:
    """One row a key: test rows, and 0 if a train row has it.  Merges rows of
    any grouping, so partial results can be merged again."""
    return tagged.groupBy("level", "k1", "k2").agg(F.sum("cnt").alias("cnt"), F.min("has_train").alias("has_train"))


def summary(covered: DataFrame, levels=None) -> DataFrame:
    """K6: matched / total / percent of every level from its covered keys."""
    levels = level_list() if levels is None else levels
    per_level = (covered.groupBy("level")
                 .agg(F.sum(F.when(F.col("has_train") == 0, F.col("cnt")).otherwise(0)).alias("matched"),
                      F.sum("cnt").alias("total")))
    out = (_levels_frame(covered.sparkSession, levels).withColumn("level", _level_code())
           .join(F.broadcast(per_level), "level", "left")
           .select("match_type", "n_words",
                   F.coalesce("matched", F.lit(0)).cast("long").alias("matched"),
                   F.coalesce("total", F.lit(0)).cast("long").alias("total")))
    out = out.withColumn("coverage_pct", coverage_pct(F.col("matched"), F.col("total")))
    return out.withColumn("n_words", _shown_n(F.col("match_type"), F.col("n_words")))


def run_coverage(train: DataFrame, test: DataFrame, templ_col: str = "templated_question",
                 forward_levels=FORWARD_LEVELS, backward_levels=BACKWARD_LEVELS,
                 full: bool = True) -> DataFrame:
    """J7 + K6: matched / total / percent for every level in one aggregate.

    total = non-null test rows (duplicates counted); a blank test row counts
    in the total and never matches."""
    require_columns(train, [templ_col])
    require_columns(test, [templ_col])
    levels = level_list(forward_levels, backward_levels, full)
    # both sides in one aggregate, no join: a key is covered when its group
    # holds a train row
    return summary(covered_keys(tagged_keys(train, test, templ_col, levels)), levels)


def _shown_n(mt: Column, n: Column) -> Column:
    return F.when(mt == FULL, F.lit(None).cast("int")).otherwise(n)


def coverage_pct(matched: Column, total: Column) -> Column:
    """K6: percent with two decimals, halves to even like Python ``round``."""
    return F.when(total > 0, F.bround(F.lit(100.0) * matched / total, 2)).otherwise(F.lit(0.0))


def coverage_exact(train: DataFrame, test: DataFrame, templ_col: str = "templated_question") -> DataFrame:
    """Full normalised match."""
    return run_coverage(train, test, templ_col, (), (), True)


def coverage_first_n(train: DataFrame, test: DataFrame, n: int | Sequence[int],
                     templ_col: str = "templated_question") -> DataFrame:
    """First-N-words match for one or several N."""
    ns = (n,) if isinstance(n, int) else tuple(n)
    return run_coverage(train, test, templ_col, ns, (), False)


def coverage_last_n(train: DataFrame, test: DataFrame, n: int | Sequence[int],
                    templ_col: str = "templated_question") -> DataFrame:
    """Last-N-words match for one or several N."""
    ns = (n,) if isinstance(n, int) else tuple(n)
    return run_coverage(train, test, templ_col, (), ns, False)


def coverage(train: DataFrame, test: DataFrame, key_fn: Callable[[Column], Column],
             templ_col: str = "templated_question", name: str = "custom") -> DataFrame:
    """Coverage under any Column -> Column key function of the normalised template."""
    tr = (train.filter(F.col(templ_col).isNotNull())
               .select(key_fn(normalize_template(templ_col)).alias("key"), F.lit(0).alias("side"))
               .filter(F.col("key") != ""))
    te = (test.filter(F.col(templ_col).isNotNull())
              .select(key_fn(normalize_template(templ_col)).alias("key"), F.lit(1).alias("side")))
    per_key = tr.unionByName(te).groupBy("key").agg(F.sum("side").alias("cnt"), F.min("side").alias("has_train"))
    agg = per_key.agg(
        F.coalesce(F.sum(F.when(F.col("has_train") == 0, F.col("cnt"))), F.lit(0)).cast("long").alias("matched"),
        F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("total"))
    return agg.select(F.lit(name).alias("match_type"), F.lit(None).cast("int").alias("n_words"),
                      "matched", "total", coverage_pct(F.col("matched"), F.col("total")).alias("coverage_pct"))


def coverage_matches(train: DataFrame, test: DataFrame, templ_col: str = "templated_question",
                     levels=None, order_by: Column | None = None) -> DataFrame:
    """Matched test rows with the train representative, long form.

    Columns: <templ_col>, normalized_template, match_type, n_words, key,
    matched_train_template.  Default levels: full, first 10/11, last 10/11."""
    if levels is None:
        levels = level_list((10, 11), (10, 11), True)
    lookup = build_lookup(train, templ_col, levels, order_by)
    te = _test_levels(test, templ_col, levels).filter(F.col("key") != "")
    # one representative row per key on the build side; AQE splits a hot test key
    return te.join(lookup, ["match_type", "n_words", "key"], "inner").select(
        templ_col, "normalized_template", "match_type",
        _shown_n(F.col("match_type"), F.col("n_words")).alias("n_words"), "key",
        F.coalesce("matched_train_template", F.lit("")).alias("matched_train_template"))


def order_summary(summary: DataFrame) -> DataFrame:
    """K7: match_type, then n_words (null first)."""
    return summary.orderBy(F.col("match_type"), F.col("n_words").asc_nulls_first())
