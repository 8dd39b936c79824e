"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its five-word shingles (a text of fewer words
is one shingle).  Words are runs of anything but Unicode white space,
lower-cased; a shingle's weight is its count in the text times the idf of its
hash bucket.  Two texts are linked if their weighted Jaccard similarity,
computed on the whole sets, is at least ``THRESHOLD``; classes are the
connected components of the links.

Steps, each one a Spark job over shared Parquet tables:

1. *vectors*: shingle hashes and counts of every document (Arrow batches).
2. *idf*: shingle counts by hash bucket over all documents; a fixed table of
   ``IDF_BUCKETS`` numbers whatever the corpus size.
3. *signatures*: ``BANDS * ROWS`` consistent weighted samples per document
   (Ioffe 2010), hashed to one key per band.
4. *links*: texts that share a band key are compared, but never all pairs of
   a large bucket.  First every member is compared with its bucket's leader,
   the text with the most company over all its buckets (an original among its
   copies), and in odd bands with the smallest key as well.  Then members that
   are still in another component than their leader are compared with all
   others in buckets of up to ``SMALL`` members, and with ``LEADERS`` members
   spread over larger ones; this is repeated with other leaders as long as a
   round links anything.  What large buckets then still hold in several
   components goes through an exact prefix-filter join on rare shingles, so no
   link is lost to a leader that is far from both of its texts.
5. *components*: minimum hooking with pointer jumping, as joins.

Exact copies share the key (md5 of the text) and count once from step 4 on.

Cases: a null text counts as empty; texts without words are copies only of
byte-equal ones; repeated rows fall in one class; the class id is the smallest
doc_id in the class (null ids last); ties cannot arise as keys differ; an empty
table gives an empty result.  Only ``doc_id`` and ``text`` are read, so other
columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qtemplates.llm.common import free_name, text_or_empty
from qtemplates.session import cut_lineage

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 4
#: Buckets of up to so many members are compared in full; leaders a round in others.
SMALL, LEADERS = 8, 4
#: Hash buckets of shingle counts in the exact join.
_COUNT_BITS = 20
#: Relative rounding of sums of weights.
_ROUND = 1e-9
#: Hash buckets of document frequencies.
IDF_BITS = 18
IDF_BUCKETS = 1 << IDF_BITS
#: Entries of the tables that random variates are drawn from.
_DRAWS = 1 << 16
#: Texts are hashed in runs of about this many bytes, whole words each.
_RUN = 1 << 16
#: Words longer than this are replaced by a hash.
_LONG = 256
#: Rows of a batch handled at once.
_ROWS_AT_ONCE = 512
#: Shingles handled at once.
_CHUNK = 1 << 16
_MULT = np.uint64(0x9E3779B97F4A7C15)


# ---- shingles -------------------------------------------------------------

def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, those of its inverse, byte values."""
    rng, n = np.random.default_rng(20240501), 2 * _RUN + 2
    base = 0xD6E8FEB86659FD93
    inverse = pow(base, -1, 1 << 64)
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    for out, x in ((up, base), (down, inverse)):
        out[0], filled = 1, 1
        while filled < n:  # doubling: x**(i+k) = x**i * x**k
            step = np.uint64(pow(x, filled, 1 << 64))
            m = min(filled, n - filled)
            out[filled:filled + m] = out[:m] * step
            filled += m
    return up, down, rng.integers(1, 1 << 64, 256, np.uint64)


_TABLES: dict = {}


def _tables(name, make):
    if name not in _TABLES:
        _TABLES[name] = make()
    return _TABLES[name]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _windows(data: bytes) -> np.ndarray:
    """32-bit hashes of all shingles of words joined by single spaces."""
    up, down, value = _tables("powers", _powers)
    b = np.frombuffer(data, np.uint8)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(value[b] * up[:len(b)], out=total[1:])
    gaps = np.flatnonzero(b == 32)
    first = np.concatenate(([0], gaps + 1))
    last = np.concatenate((gaps, [len(b)]))
    k = min(SHINGLE_WORDS, len(first))
    first, last = first[:len(first) - k + 1], last[k - 1:]
    return (mix((total[last] - total[first]) * down[first]) >> np.uint64(32)).astype(np.uint32)


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a text and their counts."""
    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint32), np.empty(0, np.uint32)
    if max(map(len, w)) > _LONG:  # so that five words fit a run
        w = [x if len(x) <= _LONG else str(hash_word(x)) for x in w]
    parts, i = [], 0
    while i == 0 or i + SHINGLE_WORDS <= len(w):
        size, j = 0, i
        while j < len(w) and (size < _RUN or j < i + SHINGLE_WORDS):
            size += 4 * len(w[j]) + 1
            j += 1
        parts.append(_windows(" ".join(w[i:j]).encode()))
        i = max(j - SHINGLE_WORDS + 1, i + 1)
    return np.unique(np.concatenate(parts), return_counts=True)


def hash_word(word: str) -> int:
    """A stable number that stands for a word too long to be kept."""
    import hashlib
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


def vectors(documents: DataFrame) -> DataFrame:
    """key, doc_id, h (sorted uint32 hashes), c (uint32 counts, empty if all
    are 1) of every document."""
    def run(batches):
        for batch in _parts(batches):
            hs, cs = [], []
            for text in batch.column("text").to_pylist():
                h, c = shingles(text)
                hs.append(h.astype("<u4").tobytes())
                cs.append(c.astype("<u4").tobytes() if len(c) and c.max() > 1 else b"")
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(hs, pa.binary()), pa.array(cs, pa.binary())],
                                             names=["key", "doc_id", "h", "c"])
    rows = documents.select(content_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "key binary, doc_id long, h binary, c binary")


def content_key() -> Column:
    """What byte-equal texts share."""
    return F.unhex(F.md5(text_or_empty().cast("binary")))


def _read(h: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(h, "<u4")
    return a, np.frombuffer(c, "<u4") if c else np.ones(len(a), np.uint32)


# ---- weights ----------------------------------------------------------------

def _counts(vecs: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """Shingles by the first ``bits`` of their hash, and how many rows there are."""
    def run(batches):
        total, docs = np.zeros(1 << bits, np.int64), 0
        for batch in _parts(batches):
            docs += batch.num_rows
            blob = b"".join(batch.column("h").to_pylist())
            total += np.bincount(np.frombuffer(blob, "<u4") >> (32 - bits), minlength=1 << bits)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(total[used], docs), pa.int64())], names=["b", "n"])
    # at most one row per bucket comes to the driver, and one with the number of documents
    got = vecs.select("h").mapInArrow(run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    b, n = got.column("b").to_numpy(), got.column("n").to_numpy()
    df = np.zeros(1 << bits, np.int64)
    df[b[b >= 0]] = n[b >= 0]
    return df, int(n[b < 0].sum())


def idf(vecs: DataFrame) -> np.ndarray:
    """1 + ln((1 + documents) / (1 + shingles in the bucket)) / ln(2 + documents)
    for each bucket, 1 at least: rare shingles weigh up to twice as much as
    common ones.  A steeper idf would pull large groups of near copies below
    the threshold, as what they share would count as common."""
    df, docs = _counts(vecs, IDF_BITS)
    return 1 + np.maximum(np.log((1 + float(docs)) / (1 + df)), 0) / np.log(2 + float(docs))


def _weights(h: np.ndarray, c: np.ndarray, table: np.ndarray) -> np.ndarray:
    return c * table[h >> (32 - IDF_BITS)]


def similarity(a: tuple, b: tuple, table: np.ndarray) -> float:
    """Weighted Jaccard similarity of two (hashes, counts)."""
    wa, wb = _weights(*a, table), _weights(*b, table)
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(wa[i], wb[j]).sum()
    return float(low / (wa.sum() + wb.sum() - low)) if low else 0.0


# ---- signatures -------------------------------------------------------------

def _draws():
    """Tables of r ~ Gamma(2,1), 1/r, ln c with c ~ Gamma(2,1), beta ~ U(0,1)
    and one odd multiplier per sample; a shingle's hash picks the entry."""
    rng = np.random.default_rng(20100711)
    r = rng.gamma(2.0, 1.0, _DRAWS)
    return r, 1 / r, np.log(rng.gamma(2.0, 1.0, _DRAWS)), rng.random(_DRAWS), rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(h: np.ndarray, log_w: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Band keys (sets x BANDS) of weighted sets laid end to end; ``starts``:
    where each one begins.  Sample i of a set is the shingle k with the least
    ln a = ln c - r (t - beta) - r, t = floor(ln w / r + beta), and its t."""
    r, inverse, log_c, beta, mult = _tables("draws", _draws)
    sizes = np.diff(np.append(starts, len(h)))
    base = mix(h.astype(np.uint64) + _MULT)
    out = np.zeros((len(starts), BANDS), np.uint64)
    for i in range(BANDS * ROWS):
        own = mix(base * mult[i])
        at = (own >> np.uint64(48)).astype(np.intp)
        t = np.floor(log_w * inverse[at] + beta[at])
        log_a = log_c[at] - r[at] * (t - beta[at] + 1.0)
        least = np.minimum.reduceat(log_a, starts)
        pick = own ^ (t.astype(np.int64).astype(np.uint64) * _MULT)
        pick[log_a != np.repeat(least, sizes)] = np.uint64(0xFFFFFFFFFFFFFFFF)
        out[:, i // ROWS] = mix(out[:, i // ROWS] * _MULT + np.minimum.reduceat(pick, starts) + np.uint64(i + 1))
    return out


def signatures(vecs: DataFrame, table: np.ndarray) -> DataFrame:
    """key, doc_id, w (total weight), bands (array of BANDS keys, null for a
    text without words)."""
    log_table = np.log(table)
    log_count = np.log(np.arange(1, 1025))

    def logs(h, c):
        small = log_count[np.minimum(c, 1024) - 1]
        return log_table[h >> (32 - IDF_BITS)] + (small if c.max() <= 1024 else np.where(c <= 1024, small, np.log(c)))

    def run(batches):
        for batch in _parts(batches):
            sets = [_read(h, c) for h, c in zip(batch.column("h").to_pylist(), batch.column("c").to_pylist(), strict=True)]
            bands, w = [None] * len(sets), [0.0] * len(sets)
            todo, held = [], 0
            for n, (h, c) in enumerate([*sets, (np.empty(0, np.uint32), None)]):
                if todo and (held + len(h) > _CHUNK or n == len(sets)):
                    hs = np.concatenate([sets[k][0] for k in todo])
                    cs = np.concatenate([sets[k][1] for k in todo])
                    starts = np.cumsum([0] + [len(sets[k][0]) for k in todo[:-1]])
                    for k, row in zip(todo, band_keys(hs, logs(hs, cs), starts).view(np.int64), strict=True):
                        bands[k] = row
                    todo, held = [], 0
                if len(h):
                    todo.append(n)
                    held += len(h)
                    w[n] = float(_weights(h, c, table).sum())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(w, pa.float64()), pa.array(bands, pa.list_(pa.int64()))],
                                             names=["key", "doc_id", "w", "bands"])
    return vecs.mapInArrow(run, "key binary, doc_id long, w double, bands array<long>")


# ---- links and classes --------------------------------------------------------

def _parts(batches):
    """Batches in slices of a few rows, so that little is held as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS_AT_ONCE):
            yield batch.slice(at, _ROWS_AT_ONCE)


def _verified(pairs: DataFrame, vecs: DataFrame, table: np.ndarray) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold."""
    def run(batches):
        for batch in _parts(batches):
            a, b, *blobs = (batch.column(x).to_pylist() for x in ("a", "b", "ha", "ca", "hb", "cb"))
            keep = [similarity(_read(ha, ca), _read(hb, cb), table) >= THRESHOLD for ha, ca, hb, cb in zip(*blobs, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, k in zip(v, keep, strict=True) if k], pa.binary()) for v in (a, b)], names=["a", "b"])
    one = lambda k: vecs.select(F.col("key").alias(k), F.col("h").alias("h" + k), F.col("c").alias("c" + k))
    return pairs.join(one("b"), "b").join(one("a"), "a").select("a", "b", "ha", "ca", "hb", "cb").mapInArrow(run, "a binary, b binary")


def _pairs(members: DataFrame, leaders: DataFrame) -> DataFrame:
    """Distinct pairs of a member and a leader of its bucket whose total
    weights allow the threshold; the leader's columns are ``lead_*``."""
    low, high = F.least("w", "lead_w"), F.greatest("w", "lead_w")
    met = members.join(leaders, "bucket").filter((F.col("key") != F.col("lead_key")) & (low >= THRESHOLD * high * (1 - 1e-9)))
    if "root" in members.columns:
        met = met.filter(F.col("root") != F.col("lead_root"))
    return met.select(F.least("key", "lead_key").alias("a"), F.greatest("key", "lead_key").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame | None:
    """(node, root) of every node in ``edges`` (a, b); root is the smallest
    node of the component.  None when there are no edges."""
    roots = None
    edges = cut_lineage(edges.filter("a != b").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("up")), "up")
        hop = lambda x: x.join(up.select(F.col("a").alias("up"), F.col("up").alias("top")), "up").select("a", F.col("top").alias("up"))
        step = cut_lineage(hop(hop(up)), "step")
        to = lambda c: step.select(F.col("a").alias(c), F.col("up").alias("new_" + c))
        if roots is None:
            roots = step.select(F.col("a").alias("node"), F.col("up").alias("root"))
        else:
            roots = cut_lineage(roots.join(to("root"), "root", "left").select("node", F.coalesce("new_root", "root").alias("root")), "roots")
        edges = cut_lineage(edges.join(to("a"), "a").join(to("b"), "b").select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b"))
                            .filter("a != b").distinct(), "edges")
    return roots


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Labels (node, root) after some more links between nodes."""
    if labels is None:
        return components(links)
    at = lambda c: labels.select(F.col("node").alias(c), F.col("root").alias("r" + c))
    tops = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    more = components(tops)
    if more is None:
        return labels
    up = more.select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = labels.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    new = more.join(labels.select("node"), "node", "left_anti")
    return cut_lineage(moved.unionByName(new), "labels")


def _label(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members with their root, of buckets that hold two or more roots; r0 is
    the root of the bucket's leader."""
    if labels is None:
        rooted = members.withColumn("root", F.col("key"))
    else:
        rooted = members.join(labels.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    rooted = cut_lineage(rooted, "rooted")
    mixed = (rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.struct("hub", "key", "root")).alias("top"))
             .filter("lo != hi").select("bucket", F.col("top.root").alias("r0")))
    return cut_lineage(rooted.join(mixed, "bucket"), "mixed")


def _rounds(members: DataFrame, labels: DataFrame | None, bodies: DataFrame, table: np.ndarray) -> tuple[DataFrame | None, DataFrame | None]:
    """Labels after comparing members with leaders of their buckets until a
    round links nothing; and the members of large buckets that still hold two
    or more roots, None if there are none."""
    turn = 0
    while True:
        left = _label(members, labels)
        if left.isEmpty():
            return labels, None
        part = F.when(F.col("n") <= SMALL, F.xxhash64("key")).otherwise(F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(LEADERS)))
        picked = (left.groupBy("bucket", part.alias("part")).agg(F.max(F.struct("hub", "key", "w", "root")).alias("x"))
                  .select("bucket", F.col("x.key").alias("lead_key"), F.col("x.w").alias("lead_w"), F.col("x.root").alias("lead_root")))
        pairs = cut_lineage(_pairs(left.filter("root != r0"), picked), "pairs")
        links = cut_lineage(_verified(pairs, bodies, table), "links")
        members = left.drop("root", "r0").filter(F.col("n") > SMALL)
        if links.isEmpty():
            return labels, None if members.isEmpty() else members
        labels, turn = _merged(labels, links), turn + 1


def _postings(texts: DataFrame, table: np.ndarray) -> DataFrame:
    """bucket (shingle), key, w, hub, rest and short of the prefixes of
    ``texts`` (key, w, hub, h, c).  A prefix holds the rarest shingles of a
    text, as far as ``rest``, the weight from the shingle on, is at least
    THRESHOLD * w; ``short`` marks where it is at least 2 T / (1 + T) * w.
    Two texts that reach the threshold share a shingle that is in the prefix of
    the heavier and in the short prefix of the lighter one: what they share
    weighs at least T * w of either and T / (1 + T) of both weights."""
    count, _ = _counts(texts, _COUNT_BITS)
    count = np.minimum(count, 0xFFFFFFFF).astype(np.uint32)
    brief = 2 * THRESHOLD / (1 + THRESHOLD)

    def run(batches):
        for batch in _parts(batches):
            keys, ws, hubs, hs, cs = (batch.column(x).to_pylist() for x in ("key", "w", "hub", "h", "c"))
            found, rests, sizes = [np.empty(0, np.int64)], [np.empty(0)], []
            for total, h, c in zip(ws, hs, cs, strict=True):
                h, c = _read(h, c)
                n = count[h >> (32 - _COUNT_BITS)]
                by = np.lexsort((h, n))
                rest = np.cumsum(_weights(h, c, table)[by][::-1])[::-1]
                # a shingle that no other text has cannot be shared
                use = np.flatnonzero((rest >= THRESHOLD * total * (1 - _ROUND)) & (n[by] > 1))
                found.append(h[by][use].astype(np.int64))
                rests.append(rest[use])
                sizes.append(len(use))
            rest, w = np.concatenate(rests), np.repeat(np.array(ws, float), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int64()), pa.array(np.repeat(np.array(keys, object), sizes), pa.binary()), pa.array(w),
                                              pa.array(np.repeat(np.array(hubs, np.int64), sizes)), pa.array(rest), pa.array(rest >= brief * w * (1 - _ROUND))],
                                             names=["bucket", "key", "w", "hub", "rest", "short"])
    return texts.mapInArrow(run, "bucket long, key binary, w double, hub long, rest double, short boolean")


def _exact(left: DataFrame, labels: DataFrame | None, bodies: DataFrame, table: np.ndarray) -> DataFrame | None:
    """Labels after all links between the texts of ``left``.  Leaders are tried
    once more, now among texts that share a rare shingle, so that large groups
    of near copies are one component before pairs are made; every pair of two
    components that passes the filters of prefix, weight and rest is verified."""
    texts = cut_lineage(left.groupBy("key").agg(F.max("w").alias("w"), F.max("hub").alias("hub")).join(bodies, "key"), "rest")
    held = cut_lineage(_postings(texts, table), "postings")
    shared = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    held = cut_lineage(held.join(shared, "bucket"), "postings")
    labels, _ = _rounds(held.filter(F.col("n") > SMALL), labels, bodies, table)
    mixed = _label(held, labels)
    # of two texts of a bucket with different roots, one is outside its leader's component
    heavy = mixed.select("bucket", *[F.col(x).alias("big_" + x) for x in ("key", "w", "rest", "root")], (F.col("root") != F.col("r0")).alias("big_out"))
    light = mixed.filter("short").withColumn("out", F.col("root") != F.col("r0"))
    total = F.col("w") + F.col("big_w")
    fits = ((F.col("root") != F.col("big_root")) & (F.col("w") <= F.col("big_w")) & (F.col("w") >= THRESHOLD * (1 - _ROUND) * F.col("big_w"))
            & (F.least("rest", "big_rest") >= THRESHOLD / (1 + THRESHOLD) * (1 - _ROUND) * total))
    met = light.filter("out").join(heavy, "bucket").filter(fits).unionByName(light.filter("not out").join(heavy.filter("big_out"), "bucket").filter(fits))
    pairs = cut_lineage(met.select(F.least("key", "big_key").alias("a"), F.greatest("key", "big_key").alias("b")).distinct(), "pairs")
    return _merged(labels, cut_lineage(_verified(pairs, bodies, table), "links"))


def classes(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, tops): rows has key, doc_id and class_id of every document; tops
    the key and doc_id of the one document that stands for each class."""
    vecs = cut_lineage(vectors(documents), "vectors")
    table = idf(vecs)
    signed = cut_lineage(signatures(vecs, table), "signatures")
    texts = cut_lineage(signed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("w").alias("w"), F.first("bands").alias("bands")), "texts")

    flat = texts.select("key", "w", F.posexplode("bands").alias("band", "v")).select("key", "w", F.xxhash64("band", "v").alias("bucket"), (F.col("band") % 2).alias("odd"))
    shared = flat.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = cut_lineage(flat.join(shared, "bucket"), "members")
    # texts in many and large buckets, as an original among its copies, lead
    hubs = members.groupBy("key").agg(F.sum("n").alias("hub"))
    members = cut_lineage(members.join(hubs, "key"), "members")
    ends = members.groupBy("bucket").agg(F.max(F.struct("hub", "key", "w")).alias("a"), F.when(F.max("odd") == 1, F.min(F.struct("key", "w"))).alias("b"))
    ends = ends.select("bucket", F.explode(F.array_compact(F.array(F.struct("a.key", "a.w"), F.col("b")))).alias("x"))
    ends = cut_lineage(ends.select("bucket", F.col("x.key").alias("lead_key"), F.col("x.w").alias("lead_w")), "leaders")
    # one body for a key, however many rows have the representative's id
    wanted = members.select("key").distinct().join(texts.select("key", "rep"), "key")
    bodies = cut_lineage(vecs.join(wanted, "key").filter(F.col("doc_id").eqNullSafe(F.col("rep"))).select("key", "h", "c").dropDuplicates(["key"]), "bodies")

    labels = components(_verified(_pairs(members, ends), bodies, table))
    labels, left = _rounds(members, labels, bodies, table)
    if left is not None:
        labels = _exact(left, labels, bodies, table)

    if labels is None:
        rooted = texts.select("key", "rep", F.col("key").alias("root"))
    else:
        rooted = texts.select("key", "rep").join(labels.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    rooted = cut_lineage(rooted, "rooted")
    tops = rooted.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "key")).alias("top"))
    of = rooted.join(tops, "root").select("key", F.col("top.rep").alias("class_id"))
    rows = signed.select("key", "doc_id").join(of, "key").select("key", "doc_id", "class_id")
    return rows, tops.select(F.col("top.key").alias("key"), F.col("top.rep").alias("doc_id"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id and class_id (the smallest doc_id of the class) of every row."""
    return classes(documents)[0].select("doc_id", "class_id")


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest doc_id, with all
    its columns; of repeated rows one stays."""
    row = F.concat_ws(":", F.hex("key"), F.col("doc_id").cast("string"))
    tops = classes(documents)[1].select(row.alias("row"))
    name = free_name(documents, "row_of_class")
    own = F.concat_ws(":", F.hex(content_key()), F.col("doc_id").cast("string"))
    kept = documents.withColumn(name, own).join(tops.withColumnRenamed("row", name), name, "left_semi")
    return kept.dropDuplicates([name]).select(*[F.col(f"`{c}`") for c in documents.columns])
