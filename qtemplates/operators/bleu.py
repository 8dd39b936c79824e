"""BLEU between test and train templates as joins and aggregates.

Definition (Papineni et al. 2002; smoothing "method 1" of Chen & Cherry
2014, epsilon 0.1): whitespace tokens, n = 1..4 with weight 1/4, clipped
n-gram hits m_n, denominator d_n = max(1, L - n + 1); a zero m_n becomes
0.1 / d_n; no unigram hit -> 0; reference length = closest to L (ties to the
shorter); brevity penalty 1 if L > R else exp(1 - R / L).

* ``corpus_bleu`` (B3) needs only sums, so it is computed without pairs:
  clipped hits against the per-gram maximum over all references.
* ``max_sentence_bleu`` (B1) is an exact top-1 search.  A seed score per test
  template comes from one min-hash representative per n-gram; then prefix
  filtering over 1..4-grams (a train template that beats the seed must share
  one of the test template's rarest n-grams, for the n whose prefix has the
  fewest postings) and a length window bound the candidates that are scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qtemplates.functions.text import py_split, py_strip
from qtemplates.operators.best_bleu import EPS, MAX_N, side
from qtemplates.session import cut_lineage

# slack for float rounding when comparing an upper bound with a seed score
_SLACK = 1e-12


def template_pairs(train: DataFrame, test: DataFrame, col: str = "template") -> DataFrame:
    """The (split, template) table from two template columns."""
    return (train.select(F.lit("train").alias("split"), F.col(col).alias("template"))
                 .unionByName(test.select(F.lit("test").alias("split"), F.col(col).alias("template"))))


def _side(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-blank templates with multiplicity, id, tokens, length."""
    # distinct by a 128-bit id of the text: the side is then hash-partitioned
    # on ``id`` and the per-template gram counts below need no exchange
    d = (df.select(F.col(col).alias("t")).filter(F.col("t").isNotNull() & (py_strip("t") != ""))
           .groupBy(F.unhex(F.md5("t")).alias("id"))
           .agg(F.first("t").alias("t"), F.count(F.lit(1)).alias("mult")))
    return (d.withColumn("toks", py_split("t"))
             .withColumn("len", F.size("toks")))


def _grams(side: DataFrame) -> DataFrame:
    """(id, mult, n, g, c): every 1..4-gram of every template with its count.

    n-grams come from MLlib's ``NGram`` transformer (JVM-side, joined with one
    space); tokens hold no whitespace, so n = 1 + number of spaces."""
    from pyspark.ml.feature import NGram

    x = side
    for n in range(2, MAX_N + 1):
        x = NGram(n=n, inputCol="toks", outputCol=f"_g{n}").transform(x)
    allg = F.concat("toks", *[F.col(f"_g{n}") for n in range(2, MAX_N + 1)])
    # ``side`` is hash-partitioned on ``id`` (distinct step), so counting
    # grams per template needs no exchange
    exploded = x.select("id", "mult", F.explode(allg).alias("g"))
    counted = exploded.groupBy("id", "mult", "g").agg(F.count(F.lit(1)).alias("c"))
    n = (F.lit(1) + F.length("g") - F.length(F.replace(F.col("g"), F.lit(" "), F.lit("")))).cast("int")
    return counted.select("id", "mult", n.alias("n"), "g", "c")


def _p(m: Column, d: Column) -> Column:
    return F.when(m > 0, m / d).otherwise(F.lit(EPS) / d)


def _score(m1, m2, m3, m4, L, R) -> Column:
    """Sentence BLEU from clipped hits and lengths."""
    d = [F.greatest(F.lit(1), L - F.lit(n - 1)) for n in range(1, 5)]
    logs = sum((F.log(_p(m, dn)) for m, dn in zip((m1, m2, m3, m4), d)), F.lit(0.0))
    bp = F.when(L > R, F.lit(1.0)).otherwise(F.exp(F.lit(1.0) - R / L))
    return F.when(m1 > 0, bp * F.exp(F.lit(0.25) * logs)).otherwise(F.lit(0.0))


def _sets(side: DataFrame, grams: DataFrame) -> DataFrame:
    """(id, len, g1..g4): the n-grams of a template as sets, the k-th
    occurrence of a gram being an element of its own.  Two templates' clipped
    hits are then sizes of intersections, found inside one row."""
    each = grams.select("id", "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("c").cast("int")),
                                                         lambda k: F.concat_ws("\0", "g", k.cast("string")))).alias("x"))
    sets = each.groupBy("id").agg(*[F.collect_list(F.when(F.col("n") == n, F.col("x"))).alias(f"g{n}") for n in range(1, MAX_N + 1)])
    return side.select("id", "len").join(sets, "id")


def _score_pairs(pairs: DataFrame, te_s: DataFrame, tr_s: DataFrame) -> DataFrame:
    """Exact BLEU for candidate (te, tr) pairs from their gram sets."""
    side = lambda d, k: d.select(F.col("id").alias(k), F.col("len").alias(f"len_{k}"), *[F.col(f"g{n}").alias(f"{k}{n}") for n in range(1, MAX_N + 1)])
    both = pairs.join(side(tr_s, "tr"), "tr").join(side(te_s, "te"), "te")
    hits = [F.size(F.array_intersect(f"te{n}", f"tr{n}")) for n in range(1, MAX_N + 1)]
    return both.select("te", "tr", _score(*hits, F.col("len_te").cast("double"), F.col("len_tr").cast("double")).alias("s"))


def _log_p_bound(k: Column, L: Column) -> Column:
    """Sum over n of log(best possible p_n) when the unigram overlap is k."""
    parts = []
    for n in range(1, 5):
        dn = F.greatest(F.lit(1), L - F.lit(n - 1)).cast("double")
        cap = L - F.lit(n - 1)
        parts.append(F.when(cap >= 1, F.log(F.least(k, cap).cast("double") / dn))
                      .otherwise(F.lit(math.log(EPS))))
    return sum(parts, F.lit(0.0))


def max_sentence_bleu(train: DataFrame, test: DataFrame, train_col: str = "template",
                      test_col: str | None = None, with_candidates: bool = False, seed_reps: int = 1):
    """B1: per distinct test template, the best sentence BLEU over all train
    templates.  Columns: template, mult (rows in test), bleu."""
    test_col = test_col or train_col
    # sides, grams and gram sets are read many times below: each is made once
    te, tr = cut_lineage(_side(test, test_col), "bleu-test"), cut_lineage(_side(train, train_col), "bleu-train")
    te_g, tr_g = cut_lineage(_grams(te), "bleu-test-grams"), cut_lineage(_grams(tr), "bleu-train-grams")
    te_s, tr_s = cut_lineage(_sets(te, te_g), "bleu-test-sets"), cut_lineage(_sets(tr, tr_g), "bleu-train-sets")

    # 1) seed: one min-hash representative train template per n-gram (n >= 2)
    reps = (tr_g.filter(F.col("n") >= 2)
                .groupBy("n", "g").agg(*[F.min_by("id", F.xxhash64("id", F.lit(h))).alias(f"r{h}")
                                         for h in range(seed_reps)])
                .select("n", "g", F.explode(F.array(*[F.col(f"r{h}") for h in range(seed_reps)])).alias("tr")))
    seed_pairs = (te_g.filter(F.col("n") >= 2).select(F.col("id").alias("te"), "n", "g")
                      .join(reps, ["n", "g"]).select("te", "tr").distinct())
    seed_pairs = cut_lineage(seed_pairs, "bleu-seed")
    seed = cut_lineage(_score_pairs(seed_pairs, te_s, tr_s), "bleu-seed-scores")
    tau = seed.groupBy("te").agg(F.max("s").alias("tau"))

    # 2) prefix filter.  Every precision factor is <= 1, so a train template
    #    beating tau needs max(m_n, 0.1) / d_n > tau^4 for each n, and jointly
    #    a unigram overlap of at least k_1 (bound below).  m_n >= k_n means it
    #    shares one of the test template's d_n - k_n + 1 rarest n-gram
    #    occurrences (rarity = train document frequency).  Per test template
    #    the n whose prefix has the fewest postings is probed.
    te_info = (te.select(F.col("id").alias("te"), F.col("len").alias("L"))
                 .join(tau, "te", "left").withColumn("tau", F.coalesce("tau", F.lit(0.0))))
    L, t = F.col("L"), F.col("tau") * F.lit(1.0 - _SLACK)
    k1 = F.array_position(F.transform(F.sequence(F.lit(1), L),
                                      lambda k: F.exp(F.lit(0.25) * _log_p_bound(k, L)) > t), True)
    p_full = F.exp(F.lit(0.25) * _log_p_bound(L, L))
    # length window: R >= k_1, and exp(1 - R/L) * P(L) > tau for R >= L
    r_hi = F.when(F.col("tau") > 0, L * (F.lit(1.0) - F.log(t / p_full))).otherwise(F.lit(float("inf")))

    def prefix_n(n):
        if n == 1:
            return L - F.col("k1") + 1
        d = L - F.lit(n - 1)
        need = F.pow(t, 4) * d                        # m_n must exceed this
        return F.when((d >= 1) & (need >= F.lit(EPS)), d - (F.floor(need).cast("int") + 1) + 1)

    te_info = (te_info.withColumn("k1", k1.cast("int")).filter(F.col("k1") > 0)   # k1 = 0: nothing can beat tau
                      .withColumn("r_hi", r_hi)
                      .select("te", "k1", "r_hi", F.explode(F.array(*[
                          F.struct(F.lit(n).alias("n"), prefix_n(n).alias("prefix")) for n in range(1, MAX_N + 1)]))
                          .alias("p"))
                      .select("te", "k1", "r_hi", "p.n", "p.prefix")
                      .filter(F.col("prefix").isNotNull()))
    df_ng = tr_g.groupBy("n", "g").agg(F.count(F.lit(1)).alias("df"))
    occ = (te_g.select(F.col("id").alias("te"), "n", "g", "c")
               .join(df_ng, ["n", "g"], "left").withColumn("df", F.coalesce("df", F.lit(0))))
    w = Window.partitionBy("te", "n").orderBy("df", "g").rowsBetween(Window.unboundedPreceding, -1)
    occ = occ.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))
    in_prefix = occ.join(te_info, ["te", "n"]).filter(F.col("before") < F.col("prefix"))
    best_n = (in_prefix.groupBy("te", "n").agg(F.sum("df").alias("cost"))
                       .groupBy("te").agg(F.min_by("n", F.struct("cost", "n")).alias("n")))
    probes = (in_prefix.join(best_n, ["te", "n"]).filter(F.col("df") > 0)
                       .select("te", "n", "g", "k1", "r_hi"))
    postings = (tr_g.select(F.col("id").alias("tr"), "n", "g")
                    .join(tr.select(F.col("id").alias("tr"), F.col("len").alias("R")), "tr"))
    cand = (probes.join(postings, ["n", "g"])
                  .filter((F.col("R") >= F.col("k1")) & (F.col("R").cast("double") < F.col("r_hi")))
                  .select("te", "tr").distinct()
                  .join(seed_pairs, ["te", "tr"], "left_anti"))
    found = _score_pairs(cand, te_s, tr_s).groupBy("te").agg(F.max("s").alias("s2"))

    best = (te.select(F.col("id").alias("te"), F.col("t").alias("template"), "mult")
              .join(tau, "te", "left").join(found, "te", "left")
              .select("template", "mult",
                      F.greatest(F.coalesce("tau", F.lit(0.0)), F.coalesce("s2", F.lit(0.0))).alias("bleu")))
    if with_candidates:  # for inspection: the (te, tr) pairs scored after the seed
        return best, seed_pairs, cand
    return best


def average_bleu(best: DataFrame) -> DataFrame:
    """B2: mean of the best scores over test rows (duplicates counted); 0.0 if none."""
    return best.agg(F.coalesce(F.sum(F.col("bleu") * F.col("mult")) / F.sum("mult"), F.lit(0.0)).alias("average_bleu"))


def gram_counts(templates: DataFrame) -> DataFrame:
    """n, h (hash), c and mult of the 1..4-grams of every template of ``side``;
    a template's n-grams meet in its row, so they are counted there, a batch
    of token hashes at once, and not in a shuffle."""
    def run(batches: Iterable):
        from qtemplates.operators import bleu as mod   # the worker's module, not a pickled copy
        for batch in batches:
            yield from mod._counted(batch)
    return templates.select("mult", F.transform("toks", lambda w: F.xxhash64(w)).alias("w")).mapInArrow(run, "n int, h long, c long, mult long")


#: Tokens whose n-grams are counted at once (a longer template alone).
_TOKENS = 1 << 17


def _counted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Counted n-grams of the templates of a batch, some templates at once."""
    lists, mult = batch.column("w"), batch.column("mult").to_numpy(zero_copy_only=False)
    ends = lists.offsets.to_numpy()
    tokens, ends = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), ends.astype(np.int64)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + _TOKENS, "right")) - 1)
        w = tokens[ends[i]:ends[j]]
        row = np.repeat(np.arange(i, j), np.diff(ends[i:j + 1]))
        h = w
        for n in range(1, MAX_N + 1):
            if n > 1:
                h = _mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[n - 1:])
            if not len(h):
                break
            whole = row[:len(h)] == row[n - 1:]
            g, r = h[whole], row[:len(h)][whole]
            order = np.argsort(g, kind="stable")  # rows of one n-gram stay in order
            g, r = g[order], r[order]
            first = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (r[1:] != r[:-1]))))[:len(g)]
            yield pa.RecordBatch.from_arrays([np.full(len(first), n, np.int32), g[first].view(np.int64), np.diff(first, append=len(g)), mult[r[first]]], ["n", "h", "c", "mult"])
        i = j


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer of SplitMix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def corpus_bleu(train: DataFrame, test: DataFrame, train_col: str = "template",
                test_col: str | None = None) -> DataFrame:
    """Corpus BLEU, every train template a reference of every test
    template.  One row: corpus_bleu (0.0 when a side is empty)."""
    # each side once; n-grams (hashed) that no reference has go in the join
    te, tr = side(test, test_col or train_col, "bleu-test"), side(train, train_col, "bleu-train")
    # hits of every hypothesis, clipped to the most that one reference has
    most = gram_counts(tr).groupBy("n", "h").agg(F.max("c").alias("most"))
    num = (gram_counts(te).join(most, ["n", "h"])
           .groupBy("n").agg(F.sum(F.least("c", "most") * F.col("mult")).alias("num")))
    # lengths: hypothesis length histogram and closest reference length
    hl = te.groupBy(F.col("len").alias("L")).agg(F.sum("mult").alias("w"))
    rl = tr.select(F.col("len").alias("R")).distinct()
    closest = _closest_length(hl, rl)
    # two one-row aggregates folded into one row without a join
    tot = closest.select(
        (F.col("w") * F.col("L")).alias("hyp_len"), (F.col("w") * F.col("R")).alias("ref_len"),
        *[(F.col("w") * F.greatest(F.lit(1), F.col("L") - F.lit(n - 1))).alias(f"d{n}") for n in range(1, 5)],
        *[F.lit(None).cast("long").alias(f"m{n}") for n in range(1, 5)])
    nums = num.select(
        *[F.lit(None).cast("long").alias(c) for c in ("hyp_len", "ref_len", "d1", "d2", "d3", "d4")],
        *[F.when(F.col("n") == n, F.col("num")).cast("long").alias(f"m{n}") for n in range(1, 5)])
    j = tot.unionByName(nums).agg(*[F.sum(c).alias(c) for c in
                                    ("hyp_len", "ref_len", "d1", "d2", "d3", "d4", "m1", "m2", "m3", "m4")])
    logs = sum((F.log(F.when(F.col(f"m{n}") > 0, F.col(f"m{n}") / F.col(f"d{n}"))
                      .otherwise(F.lit(EPS) / F.col(f"d{n}"))) for n in range(1, 5)), F.lit(0.0))
    hyp_len, ref_len = F.col("hyp_len").cast("double"), F.col("ref_len").cast("double")
    bp = (F.when(hyp_len > ref_len, F.lit(1.0)).when(hyp_len == 0, F.lit(0.0))
           .otherwise(F.exp(F.lit(1.0) - ref_len / hyp_len)))
    score = F.when(F.coalesce(F.col("m1"), F.lit(0)) > 0, bp * F.exp(F.lit(0.25) * logs)).otherwise(F.lit(0.0))
    return j.select(F.coalesce(score, F.lit(0.0)).alias("corpus_bleu"))


def _closest_length(hl: DataFrame, rl: DataFrame) -> DataFrame:
    """For each hypothesis length L, the reference length R minimising
    (|R - L|, R).  Works on the distinct lengths only, whose count is bounded
    by the longest template, not by the number of templates."""
    u = (hl.select(F.col("L").alias("x"), F.lit(1).alias("is_h"), "w")
           .unionByName(rl.select(F.col("R").alias("x"), F.lit(0).alias("is_h"), F.lit(None).cast("long").alias("w"))))
    below = Window.orderBy("x", "is_h").rowsBetween(Window.unboundedPreceding, 0)
    above = Window.orderBy("x", "is_h").rowsBetween(0, Window.unboundedFollowing)
    rv = F.when(F.col("is_h") == 0, F.col("x"))
    u = u.withColumn("lo", F.max(rv).over(below)).withColumn("hi", F.min(rv).over(above))
    h = u.filter(F.col("is_h") == 1)
    dlo, dhi = F.col("x") - F.col("lo"), F.col("hi") - F.col("x")
    r = (F.when(F.col("lo").isNull(), F.col("hi")).when(F.col("hi").isNull(), F.col("lo"))
          .when(dlo <= dhi, F.col("lo")).otherwise(F.col("hi")))
    return h.select(F.col("x").alias("L"), "w", r.alias("R"))
