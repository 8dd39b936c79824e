"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as Java and Python byte classes: U+0020, U+0009..U+000D.
WS = r"[\x20\x09-\x0D]"
#: The same characters as a plain string, for ``btrim``.
WS_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark whatever store the path is in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` evaluated once per row, however often ``v``
    is used (also inside further lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(col: str = "text") -> Column:
    """The text, a null one as the empty string."""
    return F.coalesce(F.col(col), F.lit(""))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` as an array; empty for a text without any."""
    return let(F.btrim(text, F.lit(WS_CHARS)),
               lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WS + "+", -1)))


def double_array(values) -> Column:
    """A constant array<double>; one string in the plan, folded to a literal."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def hashed_sample(df: DataFrame, keys: list[str], limit: int, ties: list[str] | None = None) -> DataFrame:
    """At most ``limit`` rows, those with the smallest hash of ``keys``.

    Rows are first cut to a hash range that holds about four times the limit,
    so that the final sort gets a bounded number of rows however many
    partitions there are (a plain ``limit`` takes that many from each).  Where
    few keys are shared by many rows (null or repeated ids) the range may miss
    them; rows are then told apart by ``ties`` as well."""
    h, n = F.xxhash64(*keys), df.count()
    if n > 4 * limit:
        most = int(-(1 << 63) + (1 << 64) * (4 * limit / n))
        some = df.filter(h <= most)
        if ties and some.limit(limit).count() < limit:
            h = F.xxhash64(*keys, *ties)
            some = df.filter(h <= most)
        df = some
    return df.orderBy(h, *keys, *(ties or [])).limit(limit)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name
