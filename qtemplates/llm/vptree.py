"""Nearest neighbours by vantage-point trees, one per shard.

Vectors are scaled to unit length, where Euclidean distance orders neighbours
as the cosine does and obeys the triangle inequality.  A shard's tree splits
its vectors at the median distance from a vantage point and keeps, for each
side, the least and greatest distance.  A side is skipped when the inequality
says that nothing in it can beat the worst of the neighbours found so far;
``factor`` relaxes that test (a side is skipped when its lower bound exceeds
``factor`` times the worst distance).  Factor 1 restores exact search; smaller
ones skip more.

Every vector is indexed, in a shard chosen by the hash of its id and numbers
(about ``SHARD`` vectors each, so a shard fits a task; of equal rows as many as
a query can return); trees are built in their
tasks and stored as rows.  A shard's task reads its trees and then all queries,
as a stream, ``QUERIES`` at once; the shards' results merge by query, so what
moves is each tree once and each query once for every shard.  Scores are the
cosines of the original vectors in double precision.

Cases: vectors that are null, empty, zero or hold null or non-finite numbers
take no part, nor do those whose length differs from the query's; equal query
rows (id and vector) are one query, other vectors under one id are queries of
their own, ranked each; equal vectors tie and the smaller id wins; rows with a null id take no part; repeated
ids are separate candidates except for the query's own id; fewer candidates
than asked for are all returned; an empty table gives an empty result.  Only
``vec_id`` and ``embedding`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qtemplates.session import cut_lineage

NEAREST = 5
EVERY = 50
SHARD = 16_384
LEAF = 64
QUERIES = 256
#: 1.0 is exact.
FACTOR = 1.0
#: More than rounding moves a distance; bounds and ties compare up to four of them.
_SLACK = 1e-7


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(fine & F.exists("embedding", lambda x: x != 0))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors, all of ``a`` to all of ``b``; off by less
    than ``_SLACK``."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def cosines(many: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Cosines in double precision, each row summed alike wherever it stands."""
    return (many * one).sum(1) / (np.sqrt((many * many).sum(1)) * np.sqrt((one * one).sum()))


def _nth(new: np.ndarray) -> np.ndarray:
    """Place in its run; ``new`` marks where runs begin."""
    starts = np.flatnonzero(new)
    return np.arange(len(new)) - np.repeat(starts, np.diff(np.append(starts, len(new))))


class Tree:
    """A vantage-point tree over the distinct rows of ``vectors``.  Of equal
    vectors the 2 k smallest ids are kept, each at most k times: no more can be
    among the k nearest of any query, as ties go to smaller ids and at most k
    of them are the query's own."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int = NEAREST, leaf: int = LEAF):
        vectors = np.ascontiguousarray(vectors + 0.0)  # -0.0 becomes 0.0
        raw = vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
        _, first, group = np.unique(raw, return_index=True, return_inverse=True)
        by = np.lexsort((ids, group))
        again = np.diff(ids[by], prepend=0) == 0
        new = np.diff(group[by], prepend=-1) != 0
        by = by[_nth(new | ~again) < k]
        kept = by[_nth(np.diff(group[by], prepend=-1) != 0) < 2 * k]
        self.k = k
        self.ids, self.owner = ids[kept], group[kept]  # owner ascends
        self.vectors = vectors[first]
        # rows with one id only do not count for a query with that id
        at = np.arange(len(first))
        self.first_id = self.ids[np.searchsorted(self.owner, at, "left")]
        self.sole = self.first_id == self.ids[np.searchsorted(self.owner, at, "right") - 1]
        # no square of a large number: scale by the largest component first
        scaled = self.vectors / np.abs(self.vectors).max(1, keepdims=True)
        self.unit = scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))
        rng = np.random.default_rng(len(ids))
        self.order = np.arange(len(self.unit))
        # [start, end] or [start, end, vantage row, inner, outer, inner lo, hi, outer lo, hi]
        self.nodes: list[list] = []
        todo = [(0, len(self.unit), None, 0)]
        while todo:
            start, end, parent, side = todo.pop()
            here = len(self.nodes)
            if parent is not None:
                self.nodes[parent][3 + side] = here
            self.nodes.append([start, end])
            if end - start <= leaf:
                continue
            rows = self.order[start:end]
            pick = int(rows[rng.integers(end - start)])
            d = distances(self.unit[rows], self.unit[pick][None])[:, 0]
            by = np.argsort(d, kind="stable")
            self.order[start:end], d = rows[by], d[by]
            half = len(d) // 2
            self.nodes[here] += [pick, 0, 0, d[0], d[half - 1], d[half], d[-1]]
            todo += [(start, start + half, here, 0), (start + half, end, here, 1)]

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[list[list], int]:
        """For each query the (score, id) of its k nearest found, nearest
        first; and how many distances were measured for all of them."""
        scaled = queries / np.abs(queries).max(1, keepdims=True)
        one = scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))
        if k > self.k:
            raise ValueError(f"the tree was built for {self.k} neighbours, not {k}")
        # the k least distances of each query, and all rows that may tie with them
        near_d, held = np.full((len(one), k), np.inf), []
        worst, seen = np.full(len(one), np.inf), 0
        stack = [(0, np.arange(len(one)), np.zeros(len(one)))]
        while stack:
            at, live, low = stack.pop()
            open_ = low <= factor * worst[live] + 4 * _SLACK
            live, low = live[open_], low[open_]
            if not len(live):
                continue
            node = self.nodes[at]
            if len(node) == 2:
                rows = self.order[node[0]:node[1]]
                seen += len(rows) * len(live)
                d = distances(one[live], self.unit[rows])
                d[self.sole[rows] & (self.first_id[rows] == ids[live][:, None])] = np.inf
                near_d[live] = np.partition(np.concatenate([near_d[live], d], 1), k - 1, axis=1)[:, :k]
                worst[live] = near_d[live].max(1)
                q, r = np.nonzero((d <= worst[live][:, None] + 4 * _SLACK) & (d < np.inf))
                held.append((live[q], rows[r], d[q, r]))
            else:
                d = distances(one[live], self.unit[node[2]][None])[:, 0]
                seen += len(live)
                for child, lo, hi in ((node[4], node[7], node[8]), (node[3], node[5], node[6])):
                    stack.append((child, live, np.maximum(np.maximum(lo - d, d - hi), low)))
        q, rows, d = (np.concatenate(x) for x in zip(*held, strict=True))
        keep = d <= worst[q] + 4 * _SLACK
        q, rows = q[keep], rows[keep]
        by = np.argsort(q, kind="stable")
        near = np.split(rows[by], np.searchsorted(q[by], np.arange(1, len(one))))
        return [self._best(int(i), v, r, k) for i, v, r in zip(ids, queries, near, strict=True)], seen

    def _best(self, query_id: int, query: np.ndarray, rows: np.ndarray, k: int) -> list:
        score = cosines(self.vectors[rows], query)
        lo, hi = np.searchsorted(self.owner, rows, "left"), np.searchsorted(self.owner, rows, "right")
        found = [(-s, int(i)) for s, a, b in zip(score.tolist(), lo, hi, strict=True) for i in self.ids[a:b] if i != query_id]
        return [(-s, i) for s, i in sorted(found)[:k]]


def build(vectors: DataFrame, shard: int = SHARD, k: int = NEAREST) -> DataFrame:
    """shard and tree (pickled) over all usable vectors, written out, for
    searches of up to ``k`` neighbours."""
    rows = usable(vectors)
    n = max(1, -(-rows.count() // shard))

    def grow(key, table):
        from qtemplates.llm import vptree as own
        table = table.combine_chunks()
        ids, vecs = table.column("vec_id").to_numpy(), table.column("embedding").chunk(0)
        copies = table.column("copies").to_numpy()
        starts, sizes = vecs.offsets.to_numpy()[:-1] - vecs.offsets.to_numpy()[0], np.diff(vecs.offsets.to_numpy())
        data, out = vecs.flatten().to_numpy(zero_copy_only=False), []
        for size in np.unique(sizes):  # a tree per length
            rows = np.flatnonzero(sizes == size)
            rows = np.repeat(rows, copies[rows])
            out.append(pickle.dumps(own.Tree(ids[rows], data[starts[rows][:, None] + np.arange(size)], k)))
        return pa.table({"shard": pa.array([key[0].as_py()] * len(out), pa.int32()), "tree": pa.array(out, pa.binary())})

    # of equal rows no query returns more than k, and none needs more in a task
    single = rows.groupBy("vec_id", "embedding").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("copies"))
    sharded = single.withColumn("shard", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n)).cast("int"))
    return cut_lineage(sharded.groupBy("shard").applyInArrow(grow, "shard int, tree binary"), "trees")


def search(queries: DataFrame, trees: DataFrame, k: int = NEAREST, factor: float = FACTOR) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest found."""
    wanted = usable(queries).distinct().withColumn("query", F.xxhash64("vec_id", "embedding"))
    shards = [r["shard"] for r in trees.select("shard").distinct().collect()]  # numbers only
    # a shard's trees, then all queries: each tree goes to one task, each query once to each
    asked = wanted.withColumn("shard", F.explode(F.array(*[F.lit(s) for s in shards]).cast("array<int>"))).withColumn("tree", F.lit(None).cast("binary"))
    held = trees.select(F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("embedding"), F.lit(None).cast("long").alias("query"), "shard", "tree")
    dealt = asked.unionByName(held).repartition(max(1, len(shards)), "shard").sortWithinPartitions("shard", F.col("tree").isNull())

    def run(batches):
        now, own = None, []
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            starts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else []
            out = []
            for a, z in zip(starts, [*starts[1:], len(shard)], strict=True):
                if shard[a] != now:
                    now, own = shard[a], []
                part = batch.slice(a, z - a)
                own += [pickle.loads(t) for t in part.column("tree").to_pylist() if t is not None]
                rows = [q for q in zip(part.column("query").to_pylist(), part.column("vec_id").to_pylist(), part.column("embedding").to_pylist(), strict=True) if q[2] is not None]
                for tree in own:
                    fit = [q for q in rows if len(q[2]) == tree.unit.shape[1]]
                    for at in range(0, len(fit), QUERIES):
                        some = fit[at:at + QUERIES]
                        found, _ = tree.search(np.array([q[1] for q in some]), np.array([q[2] for q in some]), k, factor)
                        out += [(q, vec, i, s) for (q, vec, _), near in zip(some, found, strict=True) for s, i in near]
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)],
                                             names=["query", "query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, "query long, query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, k: int = NEAREST, every: int = EVERY, factor: float = FACTOR) -> DataFrame:
    """Search all vectors with those whose id is divisible by ``every``."""
    queries = vectors.filter(F.pmod(F.col("vec_id").cast("long"), F.lit(every)) == 0)
    return search(queries, build(vectors, k=k), k, factor)
