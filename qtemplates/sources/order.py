"""Row numbers in file order.

Tables have no row order, but files do: "first seen" and "file order" need the
place of a row in its file as a column.  Spark reads a file in splits; a row's
place is its place in the split plus the rows of all splits before it.  Rows
are written once with the file, the start of the split and their running number
in the task; splits are counted (one row for each) and numbered by a window
over those counts.  No row moves: the counts join back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qtemplates.session import cut_lineage

_OWN = ("_file", "_split", "_at")


def number_rows(read: DataFrame, col: str = "row_no", start: int = 0) -> DataFrame:
    """``read`` with consecutive numbers from ``start`` in ``col``, by file
    path and place in the file.  ``read`` must come straight from a file
    source (``spark.read``), which knows each row's file and split."""
    at = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = cut_lineage(read.select("*", *[c.alias(n) for c, n in zip(at, _OWN, strict=True)]), "rows")
    splits = rows.groupBy("_file", "_split").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_file", "_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_file", "_split", (F.coalesce(F.sum("n").over(before), F.lit(0)) + start - F.col("_first")).alias("_offset"))
    placed = rows.join(F.broadcast(offsets), ["_file", "_split"])  # one row a split
    return placed.withColumn(col, (F.col("_at") + F.col("_offset")).cast("long")).select(*read.columns, col)
