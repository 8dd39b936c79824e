"""Near-duplicate vectors by random-hyperplane sign hashing in several tables.

Two vectors are linked if their cosine, in double precision on the given
numbers, is at least ``THRESHOLD``.  In each table a vector's key is the sign
pattern of its projections on ``bits`` random normals; vectors that share a key
in any table are compared.  A pair at the threshold agrees in one bit with
``p = 1 - acos(THRESHOLD) / pi``, in a table with ``p ** bits``; the number of
tables makes it meet in none with a chance of ``MISS`` at most, nearer pairs
less.  ``bits`` grows with the logarithm of the table, so that vectors that are
not alike rarely share a bucket however many there are.

1. *distinct*: equal vectors are one from here on, with their count and
   smallest id.
2. *keys*: projections in Arrow batches, one matrix product each.
3. *blocks*: buckets with two or more members; those above ``BLOCK`` members
   are split into parts by a hash, and each two parts meet in a block of their
   own, so no task holds a bucket.
4. *links*: vectors of a block are compared in numpy; of the pairs only sums
   and a spanning forest leave the task.  A pair counts in the first table
   where it shares a key, so once in all.
5. *components*: of the forests' edges, as joins.

The comparisons in a group of m vectors that are all alike, and the rows of its
blocks, grow with m * m and m * m / ``BLOCK``; nothing is left out for it.

Cases: vectors that are null, empty, zero or hold null or non-finite numbers
link with nothing, nor do vectors of different length; they are their own
component and kept.  Every row counts, also repeated ones and those with a null
or repeated id; a component's id is its smallest non-null one, and a row with a
null id is kept only if it has no other id to stand for it.  An empty table
gives an empty result.  Only ``vec_id`` and ``embedding`` are read, so other
columns cannot clash.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qtemplates.llm.minhash import components
from qtemplates.llm.vptree import cosines
from qtemplates.session import cut_lineage

THRESHOLD = 0.95
MISS = 1e-4
#: Key bits beyond the logarithm of the number of vectors.
SPARE_BITS = 4
#: Members of a bucket that meet in one block; the rows of a block are twice that, about.
BLOCK = 1024
#: More than rounding moves a cosine; nearer to the threshold it is computed by itself.
_SLACK = 1e-9
#: Pairs whose keys are compared at once.
_PAIRS = 1 << 16


def plan(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Bits of a key and number of tables for ``n`` vectors."""
    bits = min(31, max(8, math.ceil(math.log2(max(n, 1)))) + SPARE_BITS)
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-meet))


@lru_cache(maxsize=2)
def _normals(size: int, count: int) -> np.ndarray:
    return np.random.default_rng([20240607, size]).standard_normal((size, count))


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) of a list column for each length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy()
    data, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(ends)
    out = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        out.append((rows, data[(ends[:-1] - ends[0])[rows][:, None] + np.arange(size)].astype(np.float64)))
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; no square of a large or small number is taken."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def sign_keys(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Keys (vectors x tables) of vectors of one length."""
    normals, place = _normals(vectors.shape[1], bits * tables), 1 << np.arange(bits, dtype=np.int64)
    whole = unit(vectors)
    return np.stack([((whole @ normals[:, t * bits:(t + 1) * bits]) >= 0) @ place for t in range(tables)], 1).astype(np.int32)


def distinct(vectors: DataFrame) -> DataFrame:
    """rid, embedding, copies and first_id of every distinct usable vector."""
    groups = vectors.groupBy("embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"))
    return cut_lineage(groups.withColumn("rid", F.monotonically_increasing_id()), "distinct")


def keyed(groups: DataFrame, bits: int, tables: int) -> DataFrame:
    """``groups`` with the array ``keys``."""
    def run(batches):
        for batch in batches:
            keys = np.zeros((batch.num_rows, tables), np.int32)
            for rows, vectors in _matrix(batch.column("embedding")):
                keys[rows] = sign_keys(vectors, bits, tables)
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, arrays], names=[*batch.schema.names, "keys"])
    kind = groups.schema["embedding"].dataType.simpleString()
    rows = groups.select("rid", "embedding", "copies")
    return cut_lineage(rows.mapInArrow(run, f"rid long, embedding {kind}, copies long, keys array<int>"), "keys")


def blocks(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """t, key, size, lo, hi, part and rid: the members of every block."""
    flat = vectors.select("rid", F.size("embedding").alias("size"), F.posexplode("keys").alias("t", "key"))
    shared = flat.groupBy("t", "key", "size").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / block)
    members = flat.join(shared, ["t", "key", "size"]).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))
    met = members.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))))
    return met.select("t", "key", "size", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "rid")


def _pairs(block: np.ndarray, cross: np.ndarray, part: np.ndarray, whole: np.ndarray, raw: np.ndarray, threshold: float):
    """Linked pairs (i, j), i < j, of rows of the same block; rows of a block
    are neighbours.  In blocks of two parts only pairs across them count."""
    starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    sizes = np.diff(np.append(starts, len(block)))
    found = []
    small = np.repeat(sizes <= 32, sizes)
    for d in range(1, 32):  # many small blocks at once
        i = np.flatnonzero(small[:-d] & (block[:-d] == block[d:])) if d < len(block) else np.empty(0, np.int64)
        if not len(i):
            break
        found.append((i, i + d, np.einsum("ij,ij->i", whole[i], whole[i + d])))
    for a, n in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist(), strict=True):
        cos = whole[a:a + n] @ whole[a:a + n].T
        i, j = np.nonzero(np.triu(cos >= threshold - _SLACK, 1))
        found.append((a + i, a + j, cos[i, j]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, j, cos = (np.concatenate(x) for x in zip(*found, strict=True))
    near = (cos >= threshold - _SLACK) & (~cross[i] | (part[i] != part[j]))
    i, j, cos = i[near], j[near], cos[near]
    doubt = np.flatnonzero(cos < threshold + _SLACK)
    cos[doubt] = [cosines(raw[x][None], raw[y])[0] for x, y in zip(i[doubt], j[doubt], strict=True)]
    return i[cos >= threshold], j[cos >= threshold]


def _forest(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``size`` rows the smallest row of its component."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(members: DataFrame, vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """rid, n (rows linked with it in a block, counted in no other) and top (a
    rid of the same component) of the vectors that have links."""
    order = ["t", "key", "size", "lo", "hi"]

    def compared(table: pa.Table):
        cols = {c: table.column(c).to_numpy() for c in (*order, "part", "rid", "copies")}
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        change = np.zeros(table.num_rows, bool)
        for c in order:
            change[1:] |= cols[c][1:] != cols[c][:-1]
        block = np.cumsum(change)
        n, top = np.zeros(table.num_rows, np.int64), np.arange(table.num_rows)
        for rows, raw in _matrix(table.column("embedding")):
            i, j = _pairs(block[rows], (cols["lo"] != cols["hi"])[rows], cols["part"][rows], unit(raw), raw, threshold)
            i, j = rows[i], rows[j]
            first = np.ones(len(i), bool)
            for at in range(0, len(i), _PAIRS):
                a, b, t = i[at:at + _PAIRS], j[at:at + _PAIRS], cols["t"][i[at:at + _PAIRS]]
                first[at:at + _PAIRS] = (keys[a] == keys[b]).argmax(1) == t
            i, j = i[first], j[first]
            np.add.at(n, i, cols["copies"][j])
            np.add.at(n, j, cols["copies"][i])
            top = np.minimum(top, _forest(table.num_rows, i, j))
        some = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(cols["rid"][some]), pa.array(n[some]), pa.array(cols["rid"][top[some]])], names=["rid", "n", "top"])

    def run(batches):
        held = None
        for batch in chain(batches, [None]):
            table = pa.Table.from_batches([batch]) if batch is not None else None
            if table is not None and not table.num_rows:
                continue
            held = table if held is None else held if table is None else pa.concat_tables([held, table])
            if held is None:
                return
            cut = held.num_rows
            if table is not None:  # the last block may go on in the next batch
                last = np.ones(cut, bool)
                for c in order:
                    v = held.column(c).to_numpy()
                    last &= v == v[-1]
                cut = int(last.argmax())
            if cut:
                yield compared(held.slice(0, cut).combine_chunks())
                held = held.slice(cut)

    near = members.join(vectors, "rid")
    dealt = near.repartition(*order).sortWithinPartitions(*order)
    return cut_lineage(dealt.mapInArrow(run, "rid long, n long, top long"), "links")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    groups = distinct(rows.filter("fine"))
    bits, tables = plan(groups.count(), threshold)
    whole = keyed(groups, bits, tables)
    found = links(blocks(whole, block), whole, threshold)
    roots = components(found.select(F.col("rid").alias("a"), F.col("top").alias("b")))
    counts = found.groupBy("rid").agg(F.sum("n").alias("n"))
    named = groups.join(counts, "rid", "left")
    if roots is None:
        named = named.withColumn("component_id", F.col("first_id"))
    else:
        rooted = named.join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
        named = rooted.join(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "root")
    named = named.select("embedding", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("fine"))
    alone = rows.filter("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.filter("fine").join(named.drop("fine"), "embedding").select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
