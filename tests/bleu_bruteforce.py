"""Plain-Python BLEU (smoothing method 1) used as a brute-force check."""

from __future__ import annotations

import math
from collections import Counter


def _ngrams(toks, n):
    return Counter(tuple(toks[i:i + n]) for i in range(len(toks) - n + 1)) if len(toks) >= n else Counter()


def _closest(ref_lens, L):
    return min(ref_lens, key=lambda r: (abs(r - L), r))


def _stats(refs, hyp):
    nums, dens = [], []
    for n in range(1, 5):
        counts = _ngrams(hyp, n)
        maxc = Counter()
        for r in refs:
            rc = _ngrams(r, n)
            for g in counts:
                maxc[g] = max(maxc[g], rc[g])
        nums.append(sum(min(c, maxc[g]) for g, c in counts.items()))
        dens.append(max(1, sum(counts.values())))
    return nums, dens


def _combine(nums, dens, hyp_len, ref_len):
    if nums[0] == 0:
        return 0.0
    ps = [(m if m > 0 else 0.1) / d for m, d in zip(nums, dens)]
    if hyp_len > ref_len:
        bp = 1.0
    elif hyp_len == 0:
        bp = 0.0
    else:
        bp = math.exp(1 - ref_len / hyp_len)
    return bp * math.exp(math.fsum(0.25 * math.log(p) for p in ps))


def sentence_bleu(ref, hyp):
    nums, dens = _stats([ref], hyp)
    return _combine(nums, dens, len(hyp), len(ref))


def corpus_bleu(refs, hyps):
    if not refs or not hyps:
        return 0.0
    N, D, hl, rl = [0] * 4, [0] * 4, 0, 0
    ref_lens = [len(r) for r in refs]
    for h in hyps:
        nums, dens = _stats(refs, h)
        N = [a + b for a, b in zip(N, nums)]
        D = [a + b for a, b in zip(D, dens)]
        hl += len(h)
        rl += _closest(ref_lens, len(h))
    return _combine(N, D, hl, rl)


def best_scores(train, test):
    return [max((sentence_bleu(tr, te) for tr in train), default=0.0) for te in test]
