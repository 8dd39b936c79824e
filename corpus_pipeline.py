"""The document pipeline: quality rules, near-duplicates, secrets, mixture, pieces.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which
``run`` writes as Parquet into the shared folder and reads again as the next
stage's ``docs``.  All stages but the last return the columns of ``documents``.

Cases: further columns stay, whatever their names; a null text counts as empty
and, with fewer than 50 words, goes with the quality rules; repeated rows and
equal texts are one class of near-duplicates, of which the row with the
smallest id stays; rows without an id are treated like others; a null source is
a source of its own; texts of any length are read whole; empty tables give an
empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from qtemplates.llm import minhash, mixing, pieces, quality, secrets
from qtemplates.llm.common import table
from qtemplates.session import checkpoint_dir, ship_package, small_batches


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that the rules reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each class stays."""
    ship_package(spark)
    small_batches(spark)
    return minhash.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: secrets are replaced in the texts, all documents stay."""
    model = secrets.fit(secrets.training_samples(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "pages")))
    return secrets.redact(docs, model)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as often as its source's target asks for."""
    ship_package(spark)
    small_batches(spark)
    return mixing.mixed_documents(docs)


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece: the documents with their sampled ``pieces``."""
    ship_package(spark)
    small_batches(spark)
    return pieces.encode(docs)


STAGES = [
    ("quality", good_documents),
    ("near-duplicates", one_of_each),
    ("secrets", without_secrets),
    ("mixture", mixture),
    ("pieces", segmented),
]

#: Not expressible: the near-duplicate classes, the sampled mixture and the
#: piece lattice have no SQL form; tests/llm/test_pipeline.py compares each
#: stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
