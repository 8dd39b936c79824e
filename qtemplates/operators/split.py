"""Train/test splits (X1 exact size, X2 hash)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qtemplates.operators.ids import assign_ids


def _key(key) -> Column:
    return F.col(key) if isinstance(key, str) else key


def split_hash_col(key, test: float = 0.2, seed: int = 42) -> Column:
    """X2 predicate: True for test rows. The first 32 bits of
    ``md5('<seed>:<key>')`` are below ``round(test * 2**32)``; the same rows
    come out of any SQL engine.  ``test=1.0`` takes every row."""
    cut = round(test * (1 << 32))
    if cut >= 1 << 32:
        return F.lit(True)
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(_key(key).cast("string"), F.lit(""))))
    return F.substring(h, 1, 8) < F.lit(format(max(0, cut), "08x"))


def split_hash(df: DataFrame, key, test: float = 0.2, seed: int = 42,
               split_col: str = "split") -> DataFrame:
    """Add ``split`` = 'test' / 'train' by hash; no sort, no shuffle."""
    return df.withColumn(split_col, F.when(split_hash_col(key, test, seed), "test").otherwise("train"))


def split_exact(df: DataFrame, key, test: float = 0.2, seed: int = 42,
                split_col: str = "split", bucket_rows: int = 200_000) -> DataFrame:
    """Exactly ``ceil(test * n)`` test rows: the smallest ``(md5, key)``.

    The cut point is found without a global sort: hex-prefix histograms
    (at most 65,536 small rows each) narrow the range until the bucket that
    holds the cut is small, and only that bucket is sorted.  Where the cut
    falls among rows of one key, those rows alone are numbered by their other
    columns and as many as are needed are test rows, so the size is exact
    whatever the key."""
    k = F.coalesce(_key(key).cast("string"), F.lit(""))
    h = F.md5(F.concat(F.lit(f"{seed}:"), k))
    staged = df.withColumn("_h", h).withColumn("_k", k)
    n = staged.count()
    need = math.ceil(test * n) if n else 0
    if need == 0:
        return staged.withColumn(split_col, F.lit("train")).drop("_h", "_k")
    if need >= n:
        return staged.withColumn(split_col, F.lit("test")).drop("_h", "_k")
    prefix, plen, remaining, bucket = "", 0, need, n
    while bucket > bucket_rows and plen < 32:
        step = min(4, 32 - plen)
        sub = staged.filter(F.col("_h").startswith(prefix)) if prefix else staged
        hist = (sub.groupBy(F.substring("_h", plen + 1, step).alias("p"))
                   .count().orderBy("p").collect())
        for row in hist:
            if remaining <= row["count"]:
                prefix, bucket = prefix + row["p"], row["count"]
                break
            remaining -= row["count"]
        plen += step
    cut = (staged.filter(F.col("_h").startswith(prefix))
                 .select("_h", "_k").orderBy("_h", "_k")
                 .offset(remaining - 1).limit(1).collect()[0])
    below = (F.col("_h") < F.lit(cut["_h"])) | ((F.col("_h") == F.lit(cut["_h"])) & (F.col("_k") < F.lit(cut["_k"])))
    at = (F.col("_h") == F.lit(cut["_h"])) & (F.col("_k") == F.lit(cut["_k"]))
    counts = staged.filter(F.col("_h").startswith(prefix)).agg(F.count(F.when(below, 1)).alias("below"), F.count(F.when(at, 1)).alias("at")).first()
    wanted = remaining - counts["below"]
    if wanted == counts["at"]:
        return staged.withColumn(split_col, F.when(below | at, "test").otherwise("train")).drop("_h", "_k")
    # the cut's own key is repeated: its rows in the order of their columns
    rest = staged.filter(~at).withColumn(split_col, F.when(below, "test").otherwise("train")).drop("_h", "_k")
    comparable = [c for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]
    numbered = assign_ids(staged.filter(at).drop("_h", "_k"), [F.col(f"`{c}`") for c in comparable], start=1, id_col="_place")
    own = numbered.withColumn(split_col, F.when(F.col("_place") <= wanted, "test").otherwise("train")).drop("_place")
    return rest.unionByName(own)
