"""Frequency tables.

Every count is a ``groupBy`` with map-side partial aggregation, so a hot
pattern is reduced inside each input partition before the shuffle.
"Ties by first seen" needs an order column; Spark tables have no row order,
so callers pass one (default: the value itself), such as the row numbers that
``read_questions(order=...)`` gives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qtemplates.functions.text import has_word, opening, opening_pattern, py_strip
from qtemplates.operators.ids import assign_ids, rank_within

DEFAULT_MARKERS = ("EC1", "EC2", "EC3", "EC4", "EC5", "PC1", "PC2")


def _order(order_by, fallback: str) -> Column:
    if order_by is None:
        return F.col(fallback)
    return F.col(order_by) if isinstance(order_by, str) else order_by


def _pattern_counts(df: DataFrame, col: str, n: int, min_count: int, order_by) -> DataFrame:
    # without an order column the least opening stands for the least text, so that no whole text is sorted or moved
    at = opening(col, n).alias("_at")
    p = df.filter(has_word(col)).select(at, _order(order_by, col).alias("_o")) if order_by is not None else df.filter(has_word(col)).select(at)
    p = p.select(opening_pattern("_at", n).alias("pattern"), F.col("_at" if order_by is None else "_o").alias("_o"))
    return (p.groupBy("pattern").agg(F.count(F.lit(1)).alias("frequency"), F.min("_o").alias("_first"))
             .filter(F.col("frequency") >= min_count))


def pattern_frequency(df: DataFrame, col: str = "research_question", n: int = 5,
                      min_count: int = 2, order_by=None) -> DataFrame:
    """K1 + K2 + F7: (pattern, frequency) with frequency >= min_count,
    most frequent first, ties by first seen."""
    return _pattern_counts(df, col, n, min_count, order_by).orderBy(F.desc("frequency"), F.col("_first"), F.col("pattern")).drop("_first")


def pattern_ranks(df: DataFrame, col: str = "research_question", n: int = 5,
                  min_count: int = 2, order_by=None) -> DataFrame:
    """``pattern_frequency`` with the place of each pattern as ``rank``."""
    counts = _pattern_counts(df, col, n, min_count, order_by)
    return assign_ids(counts, [F.desc("frequency"), F.col("_first"), F.col("pattern")], id_col="rank").drop("_first")


def _template_counts(df: DataFrame, col: str, order_by, min_count: int) -> DataFrame:
    t = df.select(py_strip(col).alias(col), _order(order_by, col).alias("_o"))
    return (t.filter(F.col(col).isNotNull() & (F.col(col) != ""))
             .groupBy(col).agg(F.count(F.lit(1)).alias("frequency"), F.min("_o").alias("_first"))
             .filter(F.col("frequency") >= min_count))


def template_frequency(df: DataFrame, col: str = "templated_question", order_by=None,
                       min_count: int = 1) -> DataFrame:
    """K3: stripped templates, blanks dropped, most common first."""
    return _template_counts(df, col, order_by, min_count).orderBy(F.desc("frequency"), F.col("_first"), F.col(col)).drop("_first")


def template_ranks(df: DataFrame, col: str = "templated_question", order_by=None, min_count: int = 1) -> DataFrame:
    """``template_frequency`` with the place of each template as ``rank``."""
    counts = _template_counts(df, col, order_by, min_count)
    return assign_ids(counts, [F.desc("frequency"), F.col("_first"), F.col(col)], id_col="rank").drop("_first")


def chunk_counts(df: DataFrame, markers: Sequence[str] = DEFAULT_MARKERS, min_count: int = 2,
                 order_by=None) -> DataFrame:
    """K4 without ranks: (marker, chunk, frequency, _first) for all markers in
    one job. A chunk is the stripped, lower-cased non-blank cell."""
    order = F.lit(0) if order_by is None else _order(order_by, markers[0])
    long = df.select(order.alias("_o"), *[F.col(m).cast("string").alias(m) for m in markers]) \
             .unpivot(["_o"], list(markers), "marker", "value")
    chunk = F.lower(py_strip("value"))
    return (long.filter(F.col("value").isNotNull())
                .select("marker", chunk.alias("chunk"), "_o")
                .filter(F.col("chunk") != "")
                .groupBy("marker", "chunk")
                .agg(F.count(F.lit(1)).alias("frequency"), F.min("_o").alias("_first"))
                .filter(F.col("frequency") >= min_count))


def chunk_frequency(df: DataFrame, markers: Sequence[str] = DEFAULT_MARKERS, min_count: int = 2,
                    order_by=None) -> DataFrame:
    """K4: (marker, rank, chunk, frequency); rank 1 = most frequent, ties by
    first seen, then by chunk text."""
    counts = chunk_counts(df, markers, min_count, order_by)
    ranked = rank_within(counts, "marker", [F.desc("frequency"), F.col("_first"), F.col("chunk")],
                         few_groups=True)  # one group per marker name
    return ranked.select("marker", "rank", "chunk", "frequency")


def chunk_table(df: DataFrame, markers: Sequence[str] = DEFAULT_MARKERS, min_count: int = 2,
                order_by=None) -> DataFrame:
    """K5: side-by-side table, one row per rank, columns ``<m> chunks`` and
    ``<m> frequency`` for each marker, padded with ''."""
    ranked = chunk_frequency(df, markers, min_count, order_by)
    wide = (ranked.groupBy("rank").pivot("marker", list(markers))
                  .agg(F.first("chunk").alias("c"), F.first("frequency").alias("f")))
    cols = [F.col("rank")]
    for m in markers:
        cols.append(F.coalesce(F.col(f"{m}_c"), F.lit("")).alias(f"{m} chunks"))
        cols.append(F.coalesce(F.col(f"{m}_f").cast("string"), F.lit("")).alias(f"{m} frequency"))
    return wide.select(*cols)


def top_k(df: DataFrame, k: int, order_by: Sequence | str = "frequency", descending: bool = True) -> DataFrame:
    """O2: the k first rows by ``order_by`` (distributed top-k)."""
    if isinstance(order_by, str):
        order_by = [order_by]
    cols = [(F.desc(c) if descending else F.asc(c)) if isinstance(c, str) else c for c in order_by]
    return df.orderBy(*cols).limit(k)


def chunk_frequency_of_maps(df: DataFrame, map_col: str = "mapping", min_count: int = 2, order_by=None) -> DataFrame:
    """K4 over whole marker maps (T3, D4): (marker, rank, chunk, frequency) of
    every marker found, also those beyond the wide columns.  Ranks go by range
    partitions, so neither a hot marker nor many markers meet in one task."""
    order = F.lit(0) if order_by is None else _order(order_by, map_col)
    entries = df.select(order.alias("_o"), F.explode(map_col).alias("marker", "value"))
    counts = (entries.select("marker", F.lower(py_strip("value")).alias("chunk"), "_o").filter(F.col("chunk") != "")
              .groupBy("marker", "chunk").agg(F.count(F.lit(1)).alias("frequency"), F.min("_o").alias("_first"))
              .filter(F.col("frequency") >= min_count))
    ranked = rank_within(counts, "marker", [F.desc("frequency"), F.col("_first"), F.col("chunk")])
    return ranked.select("marker", "rank", "chunk", "frequency")
