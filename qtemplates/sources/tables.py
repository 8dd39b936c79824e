"""Views of the driver's Parquet tables used as stand-ins for the reference's
inputs (document lines as questions/templates, benchmark sentences, ...).

Every view reads the whole table; Parquet column pruning keeps the scan to
the columns used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qtemplates.functions.text import not_blank


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, per_core: int = 4) -> DataFrame:
    """Round-robin repartition only when the scan gives fewer partitions than
    ``per_core`` x cores.  Text rows carry heavy row-local work (tokenising,
    chunking, n-grams); a file with one row group would otherwise run it in
    one task.  A large input already has more partitions and is left as is."""
    try:
        target = df.sparkSession.sparkContext.defaultParallelism * per_core
        parts = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001  (Spark Connect: no RDD view; leave as is)
        return df
    return df.repartition(target) if parts < target else df


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, line_no, line): the non-blank lines of every document."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return (d.select("doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
             .filter(not_blank("line"))
             .withColumn("line_no", F.col("line_no").cast("long")))


def bench_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, line_no, line): the non-blank lines of every benchmark text."""
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return (b.select("item_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
             .filter(not_blank("line"))
             .withColumn("line_no", F.col("line_no").cast("long")))
