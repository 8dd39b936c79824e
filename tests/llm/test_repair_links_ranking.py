"""Conversation repair, vector links and ranked search against brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from qtemplates.llm import dialogue, ranking, signs

TURNS = "conv_id long, turn long, role string, text string"


# ---- conversation repair --------------------------------------------------------

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def plain_repair(rows):
    """All figures of one conversation, by keeping every state's best audit."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, blank, dup, trunc = set(), 0, 0, 0
    states = {"": (0, "", [])}

    def better(new, state, way):
        if state not in new or way[:2] < new[state][:2]:
            new[state] = way
    for _, role, text in rows:
        forced = not text.strip(" \t\n\x0b\x0c\r")
        blank += forced
        again = not forced and (role, text) in seen
        dup += again
        seen.add((role, text))
        cut = not forced and not again and text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?"
        trunc += cut
        new = {}
        for state, (cost, audit, out) in states.items():
            better(new, state, (cost + 3, audit + "D", out))
            at, c, a, o = state, cost, audit, out
            for _ in range(3):
                if not forced and not again:
                    x = role[:1]
                    if x == NEXT[at] or (x == "s" and at == ""):
                        better(new, x, (c + cut, a + "K", [*o, f"{role}:{text}"]))
                    if x != NEXT[at]:
                        better(new, NEXT[at], (c + 2 + cut, a + "R", [*o, f"{dialogue.ROLES[NEXT[at]]}:{text}"]))
                at, c, a, o = NEXT[at], c + 2, a + "I", [*o, f"{dialogue.ROLES[NEXT[at]]}:"]
        states = new
    tails = {"": 0, "s": 2, "u": 1, "a": 0}
    ends = []
    for state, (cost, audit, out) in states.items():
        for _ in range(tails[state]):
            cost, audit, out, state = cost + 2, audit + "I", [*out, f"{dialogue.ROLES[NEXT[state]]}:"], NEXT[state]
        ends.append((cost, audit, out))
    cost, audit, out = min(ends, key=lambda e: e[:2])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    roles = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    return gaps, blank, dup, trunc, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def conversations():
    rng = np.random.default_rng(5)
    texts = ["Yes.", "No", "Why? ", "", " \t", None, "a b c!", "ok\n", "So it is."]
    roles = ["user", "assistant", "system", "tool", None, "", "User"]
    rows = []
    for conv, n in enumerate([1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 20, 400, 37, 5, 3] + [6] * 40):
        for turn in range(n):
            rows.append((conv, None if rng.random() < .05 else int(turn + (rng.random() < .2)), str(rng.choice(roles[:4], p=[.45, .4, .1, .05])) if rng.random() < .93 else roles[int(rng.integers(4, 7))],
                         texts[int(rng.integers(len(texts)))] if rng.random() < .4 else f"t{rng.integers(60)}" + "." * int(rng.integers(2))))
    rows += [(None, t, "user", f"n{t % 7}.") for t in range(30)]
    rows += [(900, 1, "assistant", "again")] * 700 + [(900, 0, "user", "x" * 2_000_000)] + [(901, None, "system", "s.")] * 2
    return rows


def expected(rows):
    by: dict = {}
    for conv, *rest in rows:
        by.setdefault(conv, []).append(tuple(rest))
    return {conv: plain_repair(own) for conv, own in by.items()}


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_repair_against_all_audits(spark):
    rows = conversations()
    table = spark.createDataFrame(rows, TURNS).withColumn("cost", F.lit(1)).withColumn("n.x", F.lit("y"))
    for size in (dialogue.LEAF, 3):  # one leaf a conversation, or many over several partitions
        got = {r["conv_id"]: tuple(r[c] for c in FIGURES) for r in dialogue.digest(table, table, size).collect()}
        assert got == expected(rows)


def test_repaired_rows_are_those_of_the_digest(spark):
    rows = conversations()
    edits = dialogue.repair(spark.createDataFrame(rows, TURNS), 5).orderBy("conv_id", "part", "seq", "pos").collect()
    by: dict = {}
    for r in edits:
        by.setdefault(r["conv_id"], []).append(r)
    want = expected(rows)
    assert set(by) == set(want)
    for conv, own in by.items():
        assert "".join(r["edit"] for r in own) == want[conv][6]
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in own if r["edit"] != "D").encode()).hexdigest() == want[conv][7]


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], TURNS)
    assert dialogue.digest(none, none).collect() == []
    got = dialogue.digest(none, spark.createDataFrame([(3,), (None,), (3,)], "conv_id long")).collect()
    assert sorted((r["conv_id"] or 0, r["audit"], r["cost"], r["gaps"]) for r in got) == [(0, "", 0, 0), (3, "", 0, 0)]
    assert {r["repaired_sha256"] for r in got} == {hashlib.sha256(b"").hexdigest()}


def test_damage(spark):
    import zlib
    rows = [(c, t, "assistant", "A. b! c?") for c in range(8) for t in range(20)] + [(None, None, None, None)]
    got = Counter(tuple(r) for r in dialogue.damaged(spark.createDataFrame(rows, TURNS)).collect())
    want: Counter = Counter()
    for c, t, role, text in rows:
        role, text = role or " ", " " if text is None else text
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fault:
            want[c, t, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text] += 1 + (fault == 3)
    assert got == want


# ---- vector links ---------------------------------------------------------------

def vectors():
    rng = np.random.default_rng(3)
    rows = [list(map(float, x)) for x in rng.standard_normal((150, 24)).astype(np.float32)]
    for centre, n, noise in ((0, 60, .1), (1, 15, .16), (2, 4, .02), (3, 30, .2)):  # some pairs on either side of the threshold
        rows += [list(map(float, x)) for x in (np.array(rows[centre]) + noise * rng.standard_normal((n, 24))).astype(np.float32)]
    rows += [rows[5]] * 25 + [[2.0 * x for x in rows[6]], [1e30 * x for x in rows[7]], [1e-30 * x for x in rows[7]]]
    rows += [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] * 24, rows[0][:12], rows[0][:12], [1.0], [2.0], [-1.0], [-0.0, 1.0], [0.0, 1.0]]
    ids: list = list(range(len(rows), 0, -1))
    ids[40] = ids[41] = None
    ids[50] = ids[51]
    return [(i, v) for i, v in zip(ids, rows, strict=True)] + [(None, rows[0]), (7, [None, 1.0])]


def test_links_and_components_against_all_pairs(spark):
    rows = vectors()
    fine = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if fine[i] and fine[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1]) / max(map(abs, rows[k][1])) for k in (i, j))
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= signs.THRESHOLD:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least: dict = {}
    for i, (vec, _) in enumerate(rows):
        if vec is not None:
            least[find(i)] = min(least.get(find(i), vec), vec)
    want = Counter((vec, links[i], least.get(find(i)), vec == least.get(find(i))) for i, (vec, _) in enumerate(rows))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rid", F.lit(1)).withColumn("copies.x", F.lit("y"))
    for block in (signs.BLOCK, 6):
        assert Counter(tuple(r) for r in signs.near_duplicates(table, block=block).collect()) == want
    assert max(links) > 30 and sum(links) > 1000


def test_links_of_nothing(spark):
    assert signs.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    got = signs.near_duplicates(spark.createDataFrame([(1, None), (None, [0.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in got) == [(0, 0, None, True), (1, 0, 1, True)]


def test_tables_meet_pairs_at_the_threshold():
    rng = np.random.default_rng(8)
    a = signs.unit(rng.standard_normal((3000, 32)))
    b = rng.standard_normal((3000, 32))
    b = signs.unit(b - (a * b).sum(1, keepdims=True) * a)
    b = signs.THRESHOLD * a + math.sqrt(1 - signs.THRESHOLD**2) * b
    for n in (10, 10_000, 10**9):
        bits, tables = signs.plan(n)
        met = (signs.sign_keys(a, bits, tables) == signs.sign_keys(b, bits, tables)).any(1)
        assert met.mean() >= 0.998 and 1 << bits >= n


# ---- ranked search ----------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_rank(docs, items, k=ranking.TOP):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    held = [(i, Counter(TERM.findall(low(t)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total, df = len(held), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    out = Counter()
    for item, text in set(items):
        terms = set(TERM.findall(low(text)))
        scores = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1):
            out[item, rank, i, -s] += 1
    return out


def corpus():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(80)] + ["É", "straße", "Über", "İx", "a\u0085b", "K"]
    odds = 1 / np.arange(1, len(words) + 1)
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 60)), p=odds / odds.sum())) for _ in range(400)]
    docs = [(int(i), t) for i, t in enumerate(rng.permutation(texts))]
    docs += [(1000 - i, texts[3]) for i in range(40)] + [(2000, texts[4].upper())] * 15 + [(None, texts[5])] * 3
    docs += [(3000, None), (3001, ""), (3002, "-- !\x00"), (3003, "W1_w2-w3," * 40_000), (3, "w70 w71")]
    items = [(i, " ".join(rng.choice(words, int(rng.integers(1, 25)), p=odds / odds.sum())) + " unseen") for i in range(30)]
    items += [(50, texts[3]), (50, texts[3]), (50, "w79"), (51, None), (52, ""), (53, "nothing here"), (None, "W1 w1 w40"), (54, " ".join(words))]
    return docs, items


def test_ranks_against_all_scores(spark):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("terms.x", F.lit("y"))
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(9))
    want = plain_rank(docs, items)
    # one index a task and one block of items; many of both
    for most, pairs in ((ranking.POSTINGS, ranking.PAIRS), (500, 40)):
        assert Counter(tuple(r) for r in ranking.rank(d, q, most=most, pairs=pairs).collect()) == want


def test_ranks_of_nothing(spark):
    docs, items = corpus()
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert ranking.rank(d.limit(0), q).collect() == [] and ranking.rank(d, q.limit(0)).collect() == []


def test_index_leaves_most_documents_out():
    rng = np.random.default_rng(4)
    size = 4000
    n = rng.integers(20, 400, size)
    terms = [np.sort(rng.choice(500, 30, replace=False)).astype(np.int32) for _ in range(size)]
    tfs = [rng.geometric(.6, 30).astype(np.int32) for _ in range(size)]
    index = ranking.Index(list(range(size)), n, np.arange(size) * 30, np.concatenate(terms), np.concatenate(tfs), lambda x: 10 + x)
    own, weights = np.array([3, 77, 140, 300]), np.array([5000, 4000, 6000, 3000])
    found, seen = index.search(own, weights, 1)
    scores = [(-sum(int(w) * (10**9 * int(f[t == x][0]) // (1000 * int(f[t == x][0]) + 8 * (10 + int(m)))) for x, w in zip(own, weights) if x in t), i) for i, (t, f, m) in enumerate(zip(terms, tfs, n))]
    assert [(-s, i) for s, i in sorted(scores)[:10]] == found and seen < size / 2
