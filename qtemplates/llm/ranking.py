"""Ranked lexical search: range-maximum tables over posting lists.

Terms are the maximal runs of letters, digits and non-ASCII characters, only
A-Z lower-cased.  A document's score for an item (a query text) is the sum of
``w * ((1000000000 * tf) div (1000 * tf + 8 * m))`` over the item's distinct
terms, with ``w = floor(1000 * ln((2 N + 2) / (2 df + 1)))`` and
``m = 10 + (90 * n * N) div L``; N documents hold a term, L terms in all, n in
the document.  All sums are 64-bit integers.

1. *postings*: every document is cut into terms in its task; what the items
   ask for is kept as (n, term numbers, frequencies), written once.  N, L and
   the document frequencies are aggregates over these rows.
2. *index*: each task takes its rows in runs of up to ``POSTINGS`` entries.
   Documents of a run are numbered by length, so that neighbours have like
   impacts; of documents with equal terms and length the ``k`` smallest ids
   stand for all.  Posting lists lie end to end under one sparse table whose
   level j holds the place of the greatest impact among 2^j entries.
3. *search*: an item begins with the interval of all documents.  Its bound is
   the sum over terms of the greatest impact in the interval, two lookups
   each.  Best first, an interval is split at the document of its greatest
   single contribution; that document is scored and the two rests are bounded.
   Intervals below the k-th best score so far cannot hold a result and go;
   ``ROUND`` intervals are split at once.  The k-th score carries over to the
   task's next run.  The runs' results merge by item.

Items are searched in blocks of about ``PAIRS`` (item, term) pairs, each of
them over all documents, so what a task holds of them is bounded.

Cases: null and empty texts hold no term and are never found; an item without
terms, or none of whose terms occurs with a weight above 0, gets no rows;
equal scores go to the smaller doc_id, a null one last; repeated documents are
found once each; repeated items (same id and text) count once, other texts
under one id are searched each on their own; an empty table gives an empty
result.  Only ``doc_id``, ``item_id`` and ``text`` are read, so other columns
cannot clash.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qtemplates.session import cut_lineage

TOP = 10
#: Entries of the posting lists that an index holds at most (beyond the last document's).
POSTINGS = 1 << 20
#: Intervals split at once.
ROUND = 128
#: (item, term) pairs of a block of items, about.
PAIRS = 1 << 18
#: What a term is (``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+``,
#: A-Z lower-cased), as bytes of UTF-8: separators become spaces.
_BYTES = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256)).lower()


def terms_of(text: bytes | None) -> list[bytes]:
    """All terms of a text (UTF-8) in order, with repeats."""
    return text.translate(_BYTES).split() if text else []


# ---- index and search ---------------------------------------------------------

class Index:
    """Posting lists of some documents under one range-maximum table.

    ``ids``: doc_id of each document (ascending within equal documents);
    ``n``: its terms; ``starts``: where its entries begin in ``terms`` and
    ``tfs``.  ``norm`` gives a document's m from its n."""

    def __init__(self, ids, n, starts, terms, tfs, norm, k: int = TOP):
        sizes = np.diff(np.append(starts, len(terms)))
        same: dict = {}
        for row in np.argsort(n, kind="stable").tolist():
            a, z = int(starts[row]), int(starts[row] + sizes[row])
            same.setdefault((int(n[row]), terms[a:z].tobytes(), tfs[a:z].tobytes()), []).append(row)
        kept = [rows[0] for rows in same.values()]
        order = lambda x: (x is None, x)
        self.ids = [sorted((ids[r] for r in rows), key=order)[:k] for rows in same.values()]
        self.size = len(kept)
        lens = sizes[kept]
        at = np.repeat(starts[kept] - np.append(0, np.cumsum(lens)[:-1]), lens) + np.arange(lens.sum())
        doc = np.repeat(np.arange(self.size), lens)
        term, tf = terms[at].astype(np.int64), tfs[at].astype(np.int64)
        m = norm(n[kept].astype(np.int64))[doc]
        by = np.argsort(term * self.size + doc, kind="stable")
        self.key = (term * self.size + doc)[by]
        self.impact = (1_000_000_000 * tf // (1000 * tf + 8 * m))[by].astype(np.int32)
        # level j: place of the greatest impact among the 2**j entries from here on
        self.levels = [np.arange(len(by), dtype=np.int32)]
        longest = int(np.bincount(term).max()) if len(term) else 0
        while (2 << (len(self.levels) - 1)) <= longest:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            a, b = last[:-half], last[half:]
            self.levels.append(np.where(self.impact[a] >= self.impact[b], a, b))
        width = len(self.levels[0])
        self.table = np.zeros((len(self.levels), width), np.int32)
        for j, level in enumerate(self.levels):
            self.table[j, :len(level)] = level
        del self.levels

    def best(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Place of the greatest impact among the entries a..z-1, -1 if none."""
        some = z > a
        j = np.frexp(np.where(some, z - a, 1).astype(float))[1] - 1
        left = self.table[j, np.where(some, a, 0)]
        right = self.table[j, np.where(some, z - (1 << j), 0)]
        return np.where(some, np.where(self.impact[left] >= self.impact[right], left, right), -1)

    def search(self, terms: np.ndarray, weights: np.ndarray, least: int, k: int = TOP) -> tuple[list[tuple], int]:
        """The (score, doc_id) of at least ``least`` that can be among the k
        highest, and how many documents were scored."""
        base = terms * self.size
        a = np.searchsorted(self.key, base)
        z = np.searchsorted(self.key, base + self.size)
        here = z > a
        base, a, z, weights = base[here], a[here][None], z[here][None], weights[here]
        lo, hi = np.zeros(1, np.int64), np.full(1, self.size)
        found: list[tuple] = []
        if not len(base):
            return found, 0
        impact = self.impact

        def bounded(a, z):
            top = self.best(a, z)
            part = np.where(top >= 0, impact[top], 0) * weights
            which = part.argmax(1)
            return part.sum(1), top[np.arange(len(top)), which]

        bound, pivot = bounded(a, z)
        seen = 0
        while len(bound):
            take = np.argpartition(-bound, ROUND)[:ROUND] if len(bound) > ROUND else np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[take] = False
            d = self.key[pivot[take]] % self.size
            place = np.searchsorted(self.key, base[None] + d[:, None])
            hit = (place < z[take]) & (self.key[np.minimum(place, len(self.key) - 1)] == base[None] + d[:, None])
            score = (np.where(hit, impact[np.minimum(place, len(self.key) - 1)], 0) * weights).sum(1)
            seen += len(take)
            for s, doc in zip(score.tolist(), d.tolist(), strict=True):
                if s >= least:
                    found += [(s, i) for i in self.ids[doc]]
            if len(found) >= k:
                found.sort(key=_first)
                # all that tie with the k-th stay out, but for the smallest ids
                found = found[:k]
                least = max(least, found[-1][0])
            la, lz, ra, rz = a[take], place, place + hit, z[take]
            na, nz = np.concatenate([la, ra]), np.concatenate([lz, rz])
            nlo, nhi = np.concatenate([lo[take], d + 1]), np.concatenate([d, hi[take]])
            open_ = nhi > nlo
            na, nz, nlo, nhi = na[open_], nz[open_], nlo[open_], nhi[open_]
            nb, np_ = bounded(na, nz)
            keep, old = nb >= least, rest & (bound >= least)
            a, z = np.concatenate([a[old], na[keep]]), np.concatenate([z[old], nz[keep]])
            lo, hi = np.concatenate([lo[old], nlo[keep]]), np.concatenate([hi[old], nhi[keep]])
            bound, pivot = np.concatenate([bound[old], nb[keep]]), np.concatenate([pivot[old], np_[keep]])
        return found, seen


def _first(found: tuple) -> tuple:
    """Order of results: highest score, then smallest id, a null one last."""
    return -found[0], found[1] is None, found[1] or 0


# ---- jobs ---------------------------------------------------------------------

def item_terms(items: DataFrame) -> DataFrame:
    """item_id, h (a hash of id and text) and the distinct terms of every
    distinct item that has any."""
    def run(batches):
        for batch in batches:
            rows = [sorted(set(terms_of(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("h"), pa.array(rows, pa.list_(pa.binary()))], names=["item_id", "h", "terms"])
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    rows = rows.select("item_id", F.xxhash64("item_id", "text").alias("h"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "item_id long, h long, terms array<binary>").filter(F.size("terms") > 0)


def postings(documents: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """doc_id, n, and the numbers and frequencies (int32, ascending numbers) of
    the terms in ``number``, of every document that holds any term at all."""
    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = terms_of(text)
                if found:
                    counts = Counter(filter(number.__contains__, found))
                    own = sorted((number[t], c) for t, c in counts.items())
                    pairs = np.array(own, np.int32).reshape(-1, 2)
                    rows.append((doc, len(found), pairs[:, 0].tobytes(), pairs[:, 1].tobytes()))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                                             names=["doc_id", "n", "terms", "tfs"])
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms binary, tfs binary")


def statistics(held: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of each numbered term."""
    def run(batches):
        df = np.zeros(n_terms + 2, np.int64)
        for batch in batches:
            df[-2] += batch.num_rows
            df[-1] += sum(batch.column("n").to_pylist())
            df[:-2] += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int32), minlength=n_terms)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(df[used], pa.int64())], names=["term", "n"])
    # one row per term of a block of items at most comes to the driver
    got = held.select("n", "terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(n_terms + 2, np.int64)
    df[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return int(df[-2]), int(df[-1]), df[:-2]


def _runs(batches, most: int):
    """(ids, n, starts, terms, tfs) of up to about ``most`` entries each."""
    rows, held = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "terms", "tfs")), strict=True):
            if row[2]:
                rows.append(row)
                held += len(row[2]) // 4
            if held >= most:
                yield _packed(rows)
                rows, held = [], 0
    if rows:
        yield _packed(rows)


def _packed(rows: list[tuple]) -> tuple:
    ids, n, terms, tfs = zip(*rows, strict=True)
    sizes = np.array([len(t) // 4 for t in terms])
    return ids, np.array(n), np.cumsum(sizes) - sizes, np.frombuffer(b"".join(terms), np.int32), np.frombuffer(b"".join(tfs), np.int32)


def _block(documents: DataFrame, items: list, k: int, most: int) -> DataFrame | None:
    """Candidates (item, item_id, doc_id, score) of one block of items from
    all documents: the k best of each run of postings."""
    number = {t: i for i, t in enumerate(sorted({t for item in items for t in item["terms"]}))}
    held = cut_lineage(postings(documents, number), "postings")
    docs, total, df = statistics(held, len(number))
    if not total:
        return None
    weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    wanted = []
    for item in items:
        own = np.array([number[t] for t in item["terms"]], np.int64)
        own = own[(weight[own] > 0) & (df[own] > 0)]
        wanted.append((item["h"], item["item_id"], own, weight[own]))

    def norm(n):
        return 10 + (90 * n * docs) // total

    def run(batches):
        least = [1] * len(wanted)
        best: list[list] = [[] for _ in wanted]
        for ids, n, starts, terms, tfs in _runs(batches, most):
            index = Index(ids, n, starts, terms, tfs, norm, k)
            for q, (_, _, own, w) in enumerate(wanted):
                found, _ = index.search(own, w, least[q], k)
                best[q] = sorted(best[q] + found, key=_first)[:k]
                if len(best[q]) == k:
                    least[q] = best[q][-1][0]
        rows = [(h, item, doc, s) for (h, item, _, _), own in zip(wanted, best, strict=True) for s, doc in own]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item", "item_id", "doc_id", "score"])
    return held.mapInArrow(run, "item long, item_id long, doc_id long, score long")


def rank(documents: DataFrame, items: DataFrame, k: int = TOP, most: int = POSTINGS, pairs: int = PAIRS) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's ``k`` best
    documents; ``most`` entries in an index, ``pairs`` terms in a block of items."""
    spark = documents.sparkSession
    asked = cut_lineage(item_terms(items), "items")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-total // pairs)
    parts = []
    for b in range(blocks):  # each is bounded and searches all documents
        some = asked.filter(F.pmod("h", F.lit(blocks)) == b).collect()
        part = _block(documents, some, k, most) if some else None
        parts += [part] if part is not None else []
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    by = Window.partitionBy("item", "item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
