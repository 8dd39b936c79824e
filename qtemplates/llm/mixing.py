"""Mixing sources to target sizes by cube-method balanced sampling.

Every document gets an expected number of copies, its source's target over its
source's size.  The whole part is taken outright; the fraction is an inclusion
probability, drawn by the cube method (Deville and Tille): the probabilities
move at random through the null space of the balancing constraints - number of
documents and number of words - until they are 0 or 1.  Blocks of at most
about ``BLOCK`` documents of one source are balanced at a time, each in a task
of its own; a block leaves at most two documents undecided, and these meet in
blocks of the next level until one block per source is left, whose last two or
fewer documents are rounded (the landing problem; the rounding's rest of words
is made up by single documents of that last block).

A hot source is thus many blocks.  Draws are seeded by source, level and
block, and documents are ordered by size and id within a block (large ones first, so
that small ones land), so reruns agree.

Cases: a null text has size 0; documents of size 0 or of a source without
target are taken 0 times; a null source is a source of its own, last in order;
repeated rows are separate documents; an empty table gives an empty result.
Only ``doc_id``, ``source`` and ``text`` are read unless all columns are asked
for, and added names avoid those that exist.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qtemplates.llm.common import WS, text_or_empty
from qtemplates.session import cut_lineage

#: Documents balanced together.
BLOCK = 4096
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
_EPS = 1e-9


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and spread of every row; ``spread`` tells
    rows of one id apart, by text, and those without an id by their place."""
    n = F.regexp_count(text_or_empty(), F.lit(r"[^\x20\x09-\x0D]+"))
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n.cast("long").alias("size"),
                            F.xxhash64("text", place).alias("spread"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, n_docs, source_size, target: one row per source.

    Sources in code point order, null last, weigh ``weights`` over and over
    and share ``share`` of all sizes; a target stops at ``most`` times its
    source's size and the excess goes to the others by weight.  The outcome is
    one level x with target = min(weight * x, cap): sources sorted by cap over
    weight are full up to the first that is not.  The window runs over one row
    per source."""
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    # code point order is the order of the UTF-8 bytes
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights))
    caps = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    upto = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(rest)
    leveled = caps.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    x = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)["level"]
    # all are full when even the caps together fall short of the share
    return leveled.select("source", "n_docs", "source_size",
                          F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * x).alias("target"))


def cube(p: np.ndarray, x: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """Flight phase for probabilities ``p`` with constraint rows 1 and ``x``
    (so that the sums of p and p * x stay put): three undecided units at a
    time, moved along their null vector.  ``land`` rounds the two or fewer that
    are left and then adds or drops single documents as long as that brings
    the words nearer to their total."""
    start, p = p, p.copy()
    u = rng.random(len(p) + 4)
    used, hand = 0, []
    for k in np.flatnonzero((p > _EPS) & (p < 1 - _EPS)).tolist():
        hand.append(k)
        if len(hand) < 3:
            continue
        a, b, c = hand
        # orthogonal to (1, 1, 1) and to x: their cross product
        v = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
        if not any(v):
            v = (1.0, -1.0, 0.0)
        q = (p[a], p[b], p[c])
        up = min((1 - s) / d if d > 0 else s / -d for s, d in zip(q, v, strict=True) if d)
        down = min(s / d if d > 0 else (1 - s) / -d for s, d in zip(q, v, strict=True) if d)
        step = up if u[used] * (up + down) < down else -down
        used += 1
        for i, d in zip(hand, v, strict=True):
            s = p[i] + step * d
            p[i] = 0.0 if s < _EPS else 1.0 if s > 1 - _EPS else s
        hand = [i for i in hand if 0 < p[i] < 1]
    p[p <= _EPS], p[p >= 1 - _EPS] = 0.0, 1.0
    if land:
        p[hand] = np.round(p[hand])
        free = np.flatnonzero((start > _EPS) & (start < 1 - _EPS))
        off = float(((p - start) * x).sum())
        while len(free):  # what one document more or less would leave
            after = np.abs(off + (1 - 2 * p[free]) * x[free])
            k = int(after.argmin())
            if not after[k] < abs(off) - 0.5:
                break
            off += (1 - 2 * p[free[k]]) * x[free[k]]
            p[free[k]] = 1 - p[free[k]]
    return p


def _decided(level: int, land: bool):
    """For one block: rows with the probability after the flight."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # large documents first: those left for the landing are small
        rows = rows.sort_values(["size", "order", "doc_id", "p"], ascending=[False, True, True, True], kind="stable", na_position="last").reset_index(drop=True)
        seed = [level, int(rows["block"].iloc[0]), int(rows["key"].iloc[0]) & 0xFFFFFFFFFFFFFFFF]
        rows["p"] = cube(rows["p"].to_numpy(), rows["size"].to_numpy(float), np.random.default_rng(seed), land)
        return rows
    return run


def take(sizes: DataFrame, aims: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every row."""
    # one row per source: small, and a broadcast only if its size allows
    aims = aims.withColumnRenamed("source", "aim")
    rows = sizes.join(aims, F.col("source").eqNullSafe(F.col("aim")), "left").drop("aim")
    want = F.when((F.col("size") > 0) & (F.col("source_size") > 0), F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    base = F.floor(want + _EPS)
    rows = (rows.withColumn("copies", base.cast("long")).withColumn("p", F.greatest(want - base, F.lit(0.0)))
            .withColumn("key", F.xxhash64(F.col("source").isNull(), "source")).withColumn("order", F.xxhash64("doc_id", "size", "spread"))
            .withColumn("blocks", F.ceil(F.col("n_docs") / F.lit(float(block))).cast("long")))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("order", F.lit(1)), F.greatest("blocks", F.lit(1))))
    names = rows.columns
    todo, done, level = rows, [], 0
    while True:
        last = todo.agg(F.max("blocks")).first()[0]
        land = last is None or last <= 1
        moved = cut_lineage(todo.groupBy("key", "block").applyInPandas(_decided(level, land), todo.schema).select(*names), "cube")
        done.append(moved.filter((F.col("p") <= 0) | (F.col("p") >= 1)))
        if land:
            break
        # two undecided documents a block at most: the next level has fewer blocks
        todo = (moved.filter((F.col("p") > 0) & (F.col("p") < 1)).withColumn("blocks", F.ceil(2 * F.col("blocks") / F.lit(float(block))).cast("long"))
                .withColumn("block", F.pmod(F.xxhash64("block", F.lit(2 + level)), F.col("blocks"))))
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") + F.round("p").cast("long")).alias("copies"))


def mix(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (words) per row."""
    sizes = cut_lineage(sized(documents), "sizes")
    rows = take(sizes, targets(sizes))
    return rows.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The mixture itself: each row as often as it is taken (0, 1 or 2 times),
    all columns.  Copies are decided per (doc_id, source, size); rows equal in
    all three share their sum out in turn."""
    sizes = cut_lineage(sized(documents), "sizes")
    key = lambda d, s, n: F.xxhash64(d, F.coalesce(s, F.lit("\0")), n)
    took = take(sizes, targets(sizes)).select(key(F.col("doc_id"), F.col("source"), F.col("size")).alias("mix_row"), "copies")
    took = took.groupBy("mix_row").agg(F.sum("copies").alias("mix_copies"), F.count(F.lit(1)).alias("mix_rows"))
    n = F.regexp_count(text_or_empty(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    cols = [F.col(f"d.`{c}`") for c in documents.columns]
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("d"), key(F.col("doc_id").cast("long"), F.col("source").cast("string"), n).alias("mix_row"))
    met = rows.join(took, "mix_row").filter("mix_copies > 0")
    # repeated rows: the first (sum mod rows) of them get one more
    turn = F.when(F.col("mix_rows") == 1, F.lit(1)).otherwise(F.row_number().over(Window.partitionBy("mix_row").orderBy(F.xxhash64("d"))))
    each = F.floor(F.col("mix_copies") / F.col("mix_rows")) + (F.col("turn") <= F.pmod(F.col("mix_copies"), F.col("mix_rows"))).cast("long")
    out = met.withColumn("turn", turn).withColumn("each", each.cast("int")).filter("each > 0")
    return out.select("d", F.explode(F.sequence(F.lit(1), F.col("each"))).alias("mix_copy")).select(*cols)
