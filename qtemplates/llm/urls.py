"""URL filters: allow and block rules, and an exact Bloom filter cascade.

The cascade decides membership in a list of keys without a join.  Level 0 is a
Bloom filter of the listed keys, level 1 one of the keys of the universe that
level 0 lets through wrongly, level 2 one of the listed keys that level 1 lets
through wrongly, and so on until no key passes wrongly.  A key's answer is
given by the first level that rejects it, so it is exact for every key of the
universe; ``universe`` must hold all keys that will be asked for (here the
distinct hosts of the very table that is judged).

Filters are built where the keys are: each task sets bits in pages of
``PAGE_BITS`` bits and the pages are combined by OR, never the keys.  Their
total size is set by the number of listed keys and checked against
``MAX_BYTES`` before they are sent to the workers.

Cases: a null address and one without ``://`` have empty host and path; empty
hosts are a key like any other; repeated keys set the same bits; an empty list
blocks nothing; an empty table gives an empty result; only the id and the
address are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qtemplates.llm.common import let
from qtemplates.session import cut_lineage

#: Rules: verdict, host, path; the longest that fits decides.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Words that put a host on the list when one of its labels holds them.
LISTED_WORDS = ("spam", "pills", "casino", "cheap")
FALSE_RATE = 0.01
PAGE_BITS = 1 << 16
MAX_BYTES = 256 << 20


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct of ``rule`` (host and path together) and ``verdict`` of the
    longest rule that fits; null when none does."""
    fits = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
                   F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    # of equally long ones the last in order of rule text, then of verdict
    return F.array_max(F.array_compact(F.array(*fits)))


# ---- the cascade ------------------------------------------------------------

def _places(hashes: np.ndarray, bits: int, probes: int, level: int) -> np.ndarray:
    """Bit numbers (keys x probes) by double hashing of 64-bit key hashes."""
    x = hashes ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    step = (x >> np.uint64(32)) | np.uint64(1)
    return ((x[:, None] + np.arange(probes, dtype=np.uint64) * step[:, None]) % np.uint64(bits)).astype(np.int64)


def _hashes(keys) -> np.ndarray:
    import xxhash
    return np.array([xxhash.xxh3_64_intdigest((k or "").encode()) for k in keys], np.uint64)


@dataclass
class Bloom:
    bits: int
    probes: int
    level: int
    data: np.ndarray

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = _places(hashes, self.bits, self.probes, self.level)
        return ((self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def filter_bits(n: int, rate: float = FALSE_RATE) -> int:
    """Bits of a filter of ``n`` keys."""
    return -(-max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2)) // 8) * 8


def bloom(keys: DataFrame, n: int, level: int, rate: float = FALSE_RATE) -> Bloom:
    """A filter of the ``n`` keys in column ``key``."""
    bits = filter_bits(n, rate)
    probes = max(1, round(bits / max(n, 1) * math.log(2)))
    if bits // 8 > MAX_BYTES:
        raise ValueError(f"a filter of {n} keys takes {bits // 8} bytes, more than MAX_BYTES")

    def pages(batches):
        from qtemplates.llm import urls as own
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            at = own._places(own._hashes(batch.column("key").to_pylist()), bits, probes, level).ravel()
            for page in np.unique(at // PAGE_BITS):
                place = at[at // PAGE_BITS == page] % PAGE_BITS
                data = found.setdefault(int(page), np.zeros(PAGE_BITS // 8, np.uint8))
                np.bitwise_or.at(data, place >> 3, np.uint8(1) << (place & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([d.tobytes() for d in found.values()], pa.binary())], names=["page", "data"])

    def merged(key, rows):
        total = np.zeros(PAGE_BITS // 8, np.uint8)
        for d in rows.column("data"):
            total |= np.frombuffer(d.as_py(), np.uint8)
        return pa.table({"page": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    data = np.zeros(-(-bits // PAGE_BITS) * PAGE_BITS // 8, np.uint8)
    rows = keys.select("key").mapInArrow(pages, "page int, data binary").groupBy("page").applyInArrow(merged, "page int, data binary")
    for r in rows.collect():  # bounded by MAX_BYTES
        data[r["page"] * PAGE_BITS // 8:(r["page"] + 1) * PAGE_BITS // 8] = np.frombuffer(bytes(r["data"]), np.uint8)
    return Bloom(bits, probes, level, data)


def member(cascade: list[Bloom], hashes: np.ndarray) -> np.ndarray:
    """Exact membership of keys of the universe."""
    out, open_ = np.zeros(len(hashes), bool), np.arange(len(hashes))
    for k, level in enumerate(cascade):
        passed = level.holds(hashes[open_])
        out[open_[~passed]] = k % 2 == 1  # rejected by a filter of wrong keys: listed
        open_ = open_[passed]
    out[open_] = len(cascade) % 2 == 1
    return out


def build(listed: DataFrame, universe: DataFrame, rate: float = FALSE_RATE) -> list[Bloom]:
    """The cascade for the keys ``listed`` against ``universe`` (column
    ``key`` each, repeats and nulls allowed)."""
    key = F.coalesce(F.col("key"), F.lit("")).alias("key")
    inside = cut_lineage(listed.select(key).distinct(), "listed")
    others = cut_lineage(universe.select(key).distinct().join(inside, "key", "left_anti"), "others")
    cascade, own, wrong = [], inside, others
    while True:
        n = own.count()
        if not n:
            break
        if sum(len(b.data) for b in cascade) + filter_bits(n, rate) // 8 > MAX_BYTES or len(cascade) > 60:
            raise ValueError("the cascade is larger than MAX_BYTES, or does not end")
        level = bloom(own, n, len(cascade), rate)
        cascade.append(level)

        def passing(batches, level=level):
            from qtemplates.llm import urls as urls_
            for batch in batches:
                yield batch.filter(pa.array(level.holds(urls_._hashes(batch.column("key").to_pylist()))))
        own, wrong = cut_lineage(wrong.mapInArrow(passing, "key string"), "wrong"), own
    return cascade


def flagged(rows: DataFrame, key: str, cascade: list[Bloom], out: str) -> DataFrame:
    """All rows and columns plus boolean ``out``: is ``key`` listed?"""
    @F.pandas_udf("boolean")
    def listed(keys):
        import pandas as pd

        from qtemplates.llm import urls as own
        keys = ["" if k is None else k for k in keys.tolist()]
        place = {k: n for n, k in enumerate(dict.fromkeys(keys))}  # strings as they are, whatever their length
        return pd.Series(own.member(cascade, own._hashes(place))[np.fromiter(map(place.__getitem__, keys), np.int64, len(keys))])
    return rows.withColumn(out, listed(F.col(key)))


def listed_hosts(hosts: DataFrame, words=LISTED_WORDS) -> DataFrame:
    """Keys (column ``key``) of which a label holds one of the words."""
    return hosts.filter(F.col("key").rlike("|".join(words))).select("key")


def judge(pages: DataFrame, rules=RULES, listed: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, listed and verdict of every row.  ``listed``
    holds the blocked hosts (column ``key``); by default those of the pages
    that hold one of ``LISTED_WORDS``."""
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    hosts = cut_lineage(rows.select(F.col("host").alias("key")).distinct(), "hosts")
    # hosts that are listed but not asked for are no part of the universe
    own = listed_hosts(hosts) if listed is None else hosts.join(listed.select("key").distinct(), "key", "left_semi")
    cascade = build(own, hosts)
    fit = rows.withColumn("fit", let(F.struct("host", "path"), lambda x: rule(x["host"], x["path"], rules)))
    told = flagged(fit, "host", cascade, "listed")
    return told.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), "listed",
                       F.coalesce("fit.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
