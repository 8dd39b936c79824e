"""Keyed state over micro-batches, exact under replays, with compaction.

Each micro-batch is reduced to one row a key and written under its batch id
(``delta``); after ``compact_every`` of them, base and deltas are merged into a
new ``base`` that names the last batch it holds, and what went into it is
deleted.  A batch that is played again overwrites its own delta, or is left
out if a base already holds it, so every batch counts once.  A base without
its ``_SUCCESS`` file is not there yet.  Work for a batch goes with the batch,
and with the state only every ``compact_every`` batches; a read merges one
base and fewer than ``compact_every`` deltas.

``merge`` makes one row a key of any rows of the state and must not depend on
how they are grouped (sums, minima, ``min_by``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qtemplates.operators import coverage as C
from qtemplates.operators import split as X
from qtemplates.session import checkpoint_dir
from qtemplates.streaming.stream import stream_lines

COMPACT_EVERY = 16


class KeyedState:
    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], compact_every: int = COMPACT_EVERY):
        self.spark, self.path, self.merge, self.compact_every = spark, path.rstrip("/"), merge, compact_every

    def _held(self, kind: str) -> list[int]:
        """Batch ids of the complete folders of a kind."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = root.getFileSystem(conf)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        whole = [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{n}/_SUCCESS"))]
        return sorted(int(n.rsplit("-", 1)[-1]) for n in whole)

    def _drop(self, kind: str, batch_id: int) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/batch-{batch_id}")
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def put(self, rows: DataFrame, batch_id: int) -> None:
        """Add a micro-batch; playing one again changes nothing."""
        if batch_id <= max(self._held("base"), default=-1):
            return
        self.merge(rows).write.mode("overwrite").parquet(f"{self.path}/delta/batch-{batch_id}")
        if len(self._held("delta")) >= self.compact_every:
            self.compact()

    def _parts(self) -> tuple[list[int], list[int]]:
        base = self._held("base")[-1:]
        return base, [d for d in self._held("delta") if d > (base[0] if base else -1)]

    def compact(self) -> None:
        """One base of all batches so far; what it holds is deleted."""
        base, deltas = self._parts()
        if not deltas:
            return
        self.read().write.mode("overwrite").parquet(f"{self.path}/base/batch-{deltas[-1]}")
        for old in [b for b in self._held("base") if b < deltas[-1]]:
            self._drop("base", old)
        for old in [d for d in self._held("delta") if d <= deltas[-1]]:
            self._drop("delta", old)

    def read(self) -> DataFrame | None:
        """The merged state; None before the first batch."""
        base, deltas = self._parts()
        paths = [f"{self.path}/base/batch-{b}" for b in base] + [f"{self.path}/delta/batch-{d}" for d in deltas]
        return self.merge(self.spark.read.parquet(*paths)) if paths else None


def run_stream(spark: SparkSession, source: str, schema: str, rows: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame],
               files_per_trigger: int | None = None, compact_every: int = COMPACT_EVERY) -> DataFrame | None:
    """Read a folder or glob of Parquet files as a stream, keep the state of
    ``rows(micro-batch)``, and return it when all files are read."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/stream-state-{uuid.uuid4().hex}"
    state = KeyedState(spark, f"{folder}/state", merge, compact_every)
    reader = spark.readStream.schema(schema)
    stream = (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(source)
    query = (stream.writeStream.foreachBatch(lambda batch, batch_id: state.put(rows(batch), batch_id))
             .option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start())
    query.awaitTermination()
    return state.read()


# ---- the operators that need state -------------------------------------------

def first_questions(rows: DataFrame) -> DataFrame:
    """of equal questions the one with the smallest ``place``."""
    return rows.groupBy("research_question").agg(F.min("place").alias("place"))


def first_templates(rows: DataFrame) -> DataFrame:
    """Of templates with one key the one with the smallest ``place``."""
    return rows.groupBy("match_type", "n_words", "key").agg(F.min(F.struct("place", "norm")).alias("x")).select("match_type", "n_words", "key", "x.place", "x.norm")


def stream_questions(batch: DataFrame, keep: tuple = ("doc_id",)) -> DataFrame:
    """Lines of a text micro-batch as questions with their place."""
    lines = stream_lines(batch, keep=keep)
    return lines.select(F.col("line").alias("research_question"), F.struct(*keep, "line_no").alias("place"))


def stream_lookup(batch: DataFrame, levels: list) -> DataFrame:
    """Keys of a micro-batch's templates with their place."""
    lines = stream_questions(batch).withColumnRenamed("research_question", "templated_question")
    return C.train_levels(lines, "templated_question", levels, F.col("place")).withColumnRenamed("_ord", "place")


def stream_coverage(batch: DataFrame, key: str = "doc_id") -> DataFrame:
    """Covered keys of a micro-batch whose rows are split by the hash of ``key``."""
    lines = stream_lines(batch, keep=(key,)).withColumnRenamed("line", "templated_question")
    is_test = X.split_hash_col(key)
    return C.covered_keys(C.tagged_keys(lines.filter(~is_test), lines.filter(is_test)))
