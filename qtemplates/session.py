"""SparkSession construction and shared-folder helpers."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every job wants; cluster submitters may override any of them.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "qtemplates", extra: dict | None = None) -> SparkSession:
    """Build (or fetch) a session. ``master`` is only set when given, so
    spark-submit on a cluster keeps its own master."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the submitter sets it to shared storage and it is used as is;
    without it a cluster session raises, as executors could not see a folder
    of the driver.  Only on a local master a fresh scratch folder is created."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on master {master!r}")
        d = tempfile.mkdtemp(prefix="qtemplates-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    try:  # classic sessions only; Spark Connect has no SparkContext
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(d)
    except Exception:  # noqa: BLE001
        pass
    return d


def cut_lineage(df, name: str = "stage"):
    """Write ``df`` once as Parquet under the shared checkpoint folder and read
    it back.  Unlike ``checkpoint()`` on an unpersisted plan, the plan runs
    only once; lost executors re-read files instead of recomputing upstream."""
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _STAGES.append(path)
    return spark.read.parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most ``rows`` rows an Arrow batch, for jobs that send whole texts to
    Python workers, unless the session already asks for another number than
    Spark's 10,000.  Batches lie in memory on both sides, twice while they grow."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))


_STAGES: list = []


def remove_stages(spark: SparkSession) -> int:
    """Delete the folders that ``cut_lineage`` has written in this process, for
    the end of a job: what still reads them fails afterwards.  Returns how many."""
    n, jvm = len(_STAGES), spark.sparkContext._jvm
    for path in _STAGES:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _STAGES.clear()
    return n


def function_key(fn) -> str:
    """Stable key of a function for a cache in Python workers: the digest of
    the pickled function (code and captured values), computed on the driver."""
    import hashlib

    from pyspark import cloudpickle
    return hashlib.sha1(cloudpickle.dumps(fn)).hexdigest()


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``qtemplates`` importable in Python workers (functions used in
    ``mapInPandas`` live in this package).  Zips the package once per
    application into the checkpoint folder and adds it with ``addPyFile``;
    on a cluster ``spark-submit --py-files`` does the same."""
    try:
        sc = spark.sparkContext
        key = sc.applicationId
    except Exception:  # noqa: BLE001  (Spark Connect)
        sc, key = None, f"connect-{id(spark)}"
    if key in _SHIPPED:
        return
    import shutil

    pkg = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="qtemplates-pkg-"), "qtemplates")
    archive = shutil.make_archive(target, "zip", root_dir=os.path.dirname(pkg), base_dir="qtemplates")
    if sc is not None:
        sc.addPyFile(archive)
    else:
        spark.addArtifacts(archive, pyfile=True)
    _SHIPPED.add(key)
