"""The stateless stages on streaming DataFrames, aggregates via foreachBatch.

Line cleaning, normalisation, first/last-N keys, prefix protection and the
whole template extraction are Column expressions, so they run unchanged on a
``readStream`` DataFrame.  Counting patterns is kept exact across
micro-batches with ``foreachBatch``: each batch is reduced with a partial
aggregate and appended under its batch id in the shared checkpoint folder (a
replayed batch id overwrites only its own folder, so the sink stays
idempotent); the totals are the sum over the batch folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qtemplates.functions.text import py_strip, question_pattern
from qtemplates.session import checkpoint_dir


def stream_lines(stream: DataFrame, text_col: str = "text", keep=("doc_id",)) -> DataFrame:
    """Non-blank lines of a streaming text table (stateless)."""
    lines = stream.select(*keep, F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))
    return lines.filter(py_strip("line") != "")


def stream_patterns(stream: DataFrame, col: str = "line", n: int = 5) -> DataFrame:
    """K1 on a stream: the pattern column only (stateless)."""
    return stream.select(question_pattern(col, n).alias("pattern")).filter(F.col("pattern").isNotNull())


def merge_counts(out_dir: str, key: str = "pattern", done: dict | None = None):
    """foreachBatch body: the batch's partial counts, written under its own
    batch id (a replayed batch overwrites only its own folder, so the sink is
    idempotent).  Work per batch is proportional to the batch, not to the
    running total; ``read_counts`` sums the folders."""
    def run(batch: DataFrame, batch_id: int) -> None:
        if done is not None:
            done["last"] = max(done.get("last", -1), batch_id)
        part = batch.groupBy(key).agg(F.count(F.lit(1)).alias("frequency"))
        part.write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")
    return run


def read_counts(spark: SparkSession, out_dir: str, key: str = "pattern") -> DataFrame:
    """The running totals: the sum of every batch's partial counts."""
    return spark.read.parquet(out_dir).groupBy(key).agg(F.sum("frequency").alias("frequency"))


def run_pattern_stream(spark: SparkSession, source: str, schema: str, min_count: int = 2,
                       files_per_trigger: int | None = None) -> DataFrame:
    """Read a folder/glob of Parquet text files as a stream, count question
    patterns exactly over all micro-batches, return the final table.
    ``files_per_trigger`` makes smaller batches than all files that are there."""
    import uuid
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-patterns-{uuid.uuid4().hex}"
    reader = spark.readStream.schema(schema)
    s = (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(source)
    done: dict = {}
    q = (stream_patterns(stream_lines(s)).writeStream
         .foreachBatch(merge_counts(f"{base}/table", done=done))
         .option("checkpointLocation", f"{base}/chk")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if "last" not in done:
        return spark.createDataFrame([], "pattern STRING, frequency BIGINT")
    out = read_counts(spark, f"{base}/table")
    return out.filter(F.col("frequency") >= min_count).select("pattern", F.col("frequency").cast("long"))
