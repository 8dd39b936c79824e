"""Near-duplicates, mixing, token ids, neighbours, chat and URLs against brute force."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from qtemplates.llm import chat, minhash, mixing, token_ids, urls, vptree

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", sources[i] if sources else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


# ---- near-duplicates ----------------------------------------------------------

def near_texts():
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [" ".join(rng.choice(vocabulary, 150)) for _ in range(30)]
    texts = list(base)
    for b in base[:12]:
        for edits in (1, 2, 4, 12, 40):
            w = b.split()
            for at in rng.choice(len(w), edits, replace=False):
                w[at] = str(rng.choice(vocabulary))
            texts.append(" ".join(w))
    hub = base[0].split()
    for i in range(120):  # a large group around one text
        w = list(hub)
        for at in rng.choice(len(w), 2, replace=False):
            w[at] = f"x{i}"
        texts.append(" ".join(w))
    return texts + [base[3]] * 40 + [base[4].upper(), "  ".join(base[5].split()), None, "", "", "a b", "a b", "a b c", " \n", "one two three four", "y" * 3_000_000]


def test_classes_against_brute_force(spark):
    texts = near_texts()
    d = docs(spark, texts).withColumn("key", F.lit(1)).withColumn("w", F.lit("x"))
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(d).collect()}
    table = minhash.idf(minhash.vectors(d))
    sets = [minhash.shingles(t or "") for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, j in itertools.combinations(range(len(texts)), 2):
        same = (texts[i] or "") == (texts[j] or "")
        if same or (len(sets[i][0]) and len(sets[j][0]) and minhash.similarity(sets[i], sets[j], table) >= minhash.THRESHOLD):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in range(len(texts))}


def test_groups_inside_a_large_bucket(spark):
    """Small groups of near copies on one template; all other pairs, which
    share band keys in hundreds, are below the threshold."""
    rng = np.random.default_rng(3)
    shared = " ".join(f"t{i}" for i in range(404))
    texts = [" ".join([shared] + [f"g{g}x{i}" for i in range(11)] + [f"u{g}y{n}z{i}" for i in range(22)]) for g in range(80) for n in range(3)]
    texts = [texts[i] for i in rng.permutation(len(texts))]
    d = docs(spark, texts)
    table = minhash.idf(minhash.vectors(d))
    sets = [minhash.shingles(t) for t in texts]
    first = {}
    for i, j in itertools.combinations(range(len(texts)), 2):
        alike = texts[i].split()[404] == texts[j].split()[404]
        assert alike == (minhash.similarity(sets[i], sets[j], table) >= minhash.THRESHOLD)
    for i, t in enumerate(texts):
        first.setdefault(t.split()[404], i)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(d).collect()}
    assert got == {i: first[t.split()[404]] for i, t in enumerate(texts)}


def test_keep_one(spark):
    texts = near_texts()
    d = docs(spark, texts)
    d = d.unionByName(d.filter("doc_id in (0, 7)")).withColumn("row_of_class", F.lit(1))  # repeated rows, a clashing name
    kept = minhash.keep_one(d)
    assert kept.columns == d.columns
    ids = [r["doc_id"] for r in kept.collect()]
    classes = {r["class_id"] for r in minhash.near_duplicates(d).collect()}
    assert sorted(ids) == sorted(classes)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (None, "g h i j k l"), (5, "a b c d e f"), (5, "m n o p q r"), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["class_id"] or -1) for r in minhash.near_duplicates(d).collect()) == [(-1, -1), (-1, -1), (-1, 5), (5, 5), (5, 5)]
    assert minhash.keep_one(d).count() == 4
    assert minhash.near_duplicates(d.limit(0)).count() == 0 and minhash.keep_one(d.limit(0)).count() == 0


def test_shingles_and_windows():
    def plain(text):
        w = text.lower().split()
        return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    rng = np.random.default_rng(2)
    for text in ["", " ", "a", "a b c d", "a b c d e", "A  b\tc\nd e f", " ".join(rng.choice(list("abc"), 500)), " ".join(f"{i}" for i in range(300_000))]:
        h, c = minhash.shingles(text)
        own = plain(text)
        assert len(h) == len(own) or len(own) > 100_000 and len(h) > 0.999 * len(own)
        assert sorted(c.tolist()) == sorted(own.values()) or len(own) > 100_000
    assert (minhash.shingles("x a b c d e")[0] != minhash.shingles("a b c d e f")[0]).any()
    assert set(minhash.shingles("a b c d e f")[0]) & set(minhash.shingles("q a b c d e")[0])


def test_samples_collide_as_similarity():
    """The chance that one sample agrees is the weighted Jaccard similarity."""
    rng = np.random.default_rng(5)
    hits = total = 0
    want = []
    for _ in range(60):
        a = np.unique(rng.integers(0, 1 << 32, 200).astype(np.uint32))
        b = np.unique(np.concatenate([a[:150], rng.integers(0, 1 << 32, 40).astype(np.uint32)]))
        wa = {x: w for x, w in zip(a, rng.uniform(1, 3, len(a)))}
        wb = {x: wa.get(x, 1.5) * (1.0 if x in wa else 1.0) for x in b}
        keys = []
        old = minhash.BANDS, minhash.ROWS
        for own in (wa, wb):
            h = np.array(sorted(own), np.uint32)
            keys.append(minhash.band_keys(h, np.log([own[x] for x in h.tolist()] if False else [own[x] for x in h]), np.array([0]))[0])
        assert old == (minhash.BANDS, minhash.ROWS)
        low = sum(min(wa[x], wb[x]) for x in wa if x in wb)
        want.append((low / (sum(wa.values()) + sum(wb.values()) - low)) ** minhash.ROWS)
        hits += int((keys[0] == keys[1]).sum())
        total += minhash.BANDS
    p = float(np.mean(want))
    assert abs(hits / total - p) < 4 * np.sqrt(p * (1 - p) / total)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (200, 200), (101, 100), (7, 3)]
    e = spark.createDataFrame([(a.to_bytes(2, "big"), b.to_bytes(2, "big")) for a, b in chain], "a binary, b binary")
    got = {int.from_bytes(r["node"], "big"): int.from_bytes(r["root"], "big") for r in minhash.components(e).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# ---- mixing -------------------------------------------------------------------

def mix_docs(spark):
    rng = np.random.default_rng(4)
    names = ["a", "B", "é", None, "z", "\U0001F600", "hot"]
    sources = [names[int(i)] for i in rng.choice(7, 1500, p=[.1, .1, .1, .1, .1, .1, .4])] + ["empty", "a"]
    texts = ["w " * int(n) for n in rng.integers(0, 400, 1500)] + [None, " \t\n"]
    return docs(spark, texts, sources), texts, sources


def test_mix(spark):
    d, texts, sources = mix_docs(spark)
    rows = mixing.mix(d).collect()
    size = Counter()
    for t, s in zip(texts, sources):
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    full, want = set(), {}
    while True:  # stop at the caps, share the rest again
        rest = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        w = sum(weight[s] for s in order if s not in full)
        want = {s: 2.0 * size[s] if s in full else rest * weight[s] / w for s in order}
        over = {s for s in order if s not in full and want[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    taken = Counter()
    for r in rows:
        s = sources[r["doc_id"]]
        assert r["target"] == pytest.approx(want[s]) and r["source_size"] == size[s]
        assert r["size"] == len((texts[r["doc_id"]] or "").split()) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 20 for s in order)
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(d.repartition(9)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}


def test_mix_in_levels(spark):
    """Many small blocks: later levels still bring the totals home."""
    d, _, _ = mix_docs(spark)
    sizes = mixing.sized(d)
    rows = mixing.take(sizes, mixing.targets(sizes), block=16).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.max("target").alias("g"), F.max("source_size").alias("n")).collect()
    assert all(abs(r["t"] - r["g"]) <= max(400, 0.02 * r["g"]) for r in rows)


def test_cube_keeps_totals_and_expectations():
    rng = np.random.default_rng(0)
    x, p = rng.integers(1, 50, 60).astype(float), rng.uniform(0, 1, 60)
    mean = np.zeros(60)
    for seed in range(600):
        out = mixing.cube(p, x, np.random.default_rng(seed), False)
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert out.sum() == pytest.approx(p.sum(), abs=1e-6) and (out * x).sum() == pytest.approx((p * x).sum(), abs=1e-4)
        mean += out / 600
    assert np.abs(mean - p).max() < 0.1


def test_mixed_documents(spark):
    d, _, _ = mix_docs(spark)
    d = d.unionByName(d.filter("doc_id < 40"))  # repeated rows
    out = mixing.mixed_documents(d)
    assert out.columns == d.columns
    got = Counter(r["doc_id"] for r in out.collect())
    want = Counter()
    for r in mixing.mix(d).collect():
        want[r["doc_id"]] += r["copies"]
    assert +got == +want
    assert mixing.mix(d.limit(0)).count() == 0 and mixing.mixed_documents(d.limit(0)).count() == 0


# ---- token ids ----------------------------------------------------------------

def test_token_ids(spark, tmp_path):
    odd = ["a  b ", " a\n b", "\t x  \n", "  ", "don't  stop<|endoftext|> x", "é 　 z\x1c q \x85w", "x\0 y z", None, "", "word " * 30_000, " " * 50 + "x"]
    texts = odd + [f"some short text number {i} about nothing much" for i in range(300)]
    d = docs(spark, texts).unionByName(docs(spark, ["null id", "twice"]).withColumn("doc_id", F.when(F.col("doc_id") == 1, F.lit(3)))).withColumn("part", F.lit("x"))
    path = str(tmp_path / "ids")
    token_ids.write(d, path)
    rows = sorted(token_ids.read(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
    encoder = token_ids.Encoder(token_ids.default_tokenizer())
    have = defaultdict(list)
    for i, t in [*enumerate(texts), (None, "null id"), (3, "twice")]:
        have[i].append(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [2])
    start = 0
    for r in rows:
        assert r["ids"] in have[r["doc_id"]] and r["start"] == start and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        have[r["doc_id"]].remove(r["ids"])
        start += len(r["ids"])
    assert not any(have.values())
    assert [r["doc_id"] for r in rows][0] is None and [r["doc_id"] for r in rows][1:] == sorted(r["doc_id"] for r in rows[1:])
    found = {r["doc_id"]: r["ids"] for r in token_ids.lookup(spark, path, [5, 100, 10**6]).collect()}
    assert found == {r["doc_id"]: r["ids"] for r in rows if r["doc_id"] in (5, 100)}


def test_token_ids_word_by_word():
    encoder = token_ids.Encoder(token_ids.default_tokenizer())
    texts = ["One two, three.\nFour five's $$$ six$$$ \u0117t\u00e9, na\u00efve\u00d7 stra\u00dfe?!\nX\n\nY", "x" * 300 + " " + "\u00e9" * 90 + ".\nx", "e\u0301 12a a12 a_b (c) d\u00aa \u0436\u0436, don't\nwe're",
             "", " ", "  two  spaces", "ends ", "\n", "<|endoftext|> a <|endoftext|>,"]
    rng = np.random.default_rng(3)
    odd = np.array([*"abcXY ,.'!$\n\t0\u00e9\u00f7\u0117\u0250\u3000\u0085\x1c\x00-_", "  ", " the", "n't", "'s", ".\nIt", "<|endoftext|>"])
    texts += ["".join(rng.choice(odd, 30)) for _ in range(2000)]
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, encoder.dtype).tobytes() for t in texts]
    asked, plain = [], encoder.tokenizer

    class Counting:
        def encode_batch_fast(self, some, **more):
            asked.extend(some)
            return plain.encode_batch_fast(some, **more)
    encoder.tokenizer = Counting()
    assert encoder.serialize(texts) == want and len(asked) > 100
    asked.clear()
    words = [f"{a}{b}{c}" for a in ("Qw", "zx", "\u00e9\u00df") for b in "abcdefg" for c in ("", ",", ".\nThe", "$$$")]
    text = " ".join(words)
    assert encoder.serialize([text])[0] == np.array(plain.encode(text, add_special_tokens=False).ids, encoder.dtype).tobytes()
    assert not [p for p in asked if any(c.isalpha() for c in p)]  # words go to the model itself


def test_token_ids_forgetting(monkeypatch):
    monkeypatch.setattr(token_ids, "_PIECES", 5)
    encoder = token_ids.Encoder(token_ids.default_tokenizer())
    for i in range(20):
        text = f"word again{'b' * i} {'c' * (i % 3)}d, and\nmore"
        assert encoder.serialize([text])[0] == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, encoder.dtype).tobytes()
        assert len(encoder.known) + len(encoder.known.before) <= 40 and not getattr(encoder.known.before, "before", None)


def test_token_ids_dictionary_and_empty(spark, tmp_path):
    path = str(tmp_path / "none")
    token_ids.write(docs(spark, []), path)
    assert token_ids.read(spark, path).count() == 0
    frame = __import__("zstandard").ZstdCompressor().compress(b"\x01\x00\x02\x00")
    data = token_ids.pack([(7, 2, frame)], np.dtype("<u2"), hashlib.sha256(b"").digest())
    assert token_ids.Payload(data, b"").ids(0).tolist() == [1, 2]
    with pytest.raises(ValueError):
        token_ids.Payload(data, b"another")


# ---- neighbours ---------------------------------------------------------------

def test_nearest(spark):
    rng = np.random.default_rng(8)
    vecs = rng.normal(size=(1200, 8)).astype(np.float32)
    vecs[100:400] = vecs[50]  # a large tie
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)]
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [None] * 8), (2004, [float("inf")] + [1.0] * 7), (2050, []), (2100, [1.0] * 3), (2101, [2.0, 1.0, 0.0]), (None, [1.0] * 8)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit("x"))
    got = defaultdict(list)
    for r in vptree.search(d.filter("vec_id % 50 = 0"), vptree.build(d, shard=300)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    data = vecs.astype(float)
    for q in range(0, 1200, 50):
        score = vptree.cosines(data, data[q])
        score[q] = -2
        best = np.lexsort((np.arange(1200), -score))[:5]
        assert [(k + 1, int(b), float(score[b])) for k, b in enumerate(best)] == got.pop(q)
    assert [x[:2] for x in got.pop(2100)] == [(1, 2101)] and not got
    assert vptree.nearest(d.limit(0)).count() == 0


def test_nearest_with_many_ties(spark):
    rng = np.random.default_rng(9)
    sign = np.unique(rng.choice([-1.0, 1.0], (4000, 10)), axis=0)
    sign = sign[rng.permutation(len(sign))]
    scaled = np.outer(rng.uniform(1, 2, 100), rng.normal(size=10))  # at cosine 1 to rounding
    data = np.concatenate([sign, scaled, np.repeat(rng.normal(size=(1, 10)), 20, 0), rng.normal(size=(40, 10))])
    ids = np.arange(len(data))
    ids[-40:] = 0  # a hot id
    ids = np.concatenate([ids, [ids[len(sign) + 100]] * 15])  # and repeated equal rows
    data = np.concatenate([data, np.repeat(data[len(sign) + 100][None], 15, 0)])
    d = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, data)], "vec_id long, embedding array<double>")
    asked = [1, 2, 500, 1000, len(sign) + 3, len(sign) + 100, len(sign) + 101]
    queries = d.filter(F.col("vec_id").isin(asked)).dropDuplicates(["vec_id"])
    for k in (5, 10):
        got = defaultdict(list)
        for r in vptree.search(queries, vptree.build(d, shard=200, k=k), k).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["score"], r["vec_id"]))
        for q in asked:
            score = vptree.cosines(data, data[np.flatnonzero(ids == q)[0]])
            assert got[q] == [(-s, i) for s, i in sorted((-float(s), int(i)) for s, i in zip(score, ids) if i != q)[:k]]
    tree = vptree.Tree(ids, data)
    score = vptree.cosines(data, data[-16])  # own id with 40 other vectors near the query
    assert tree.search(np.array([0]), data[-16][None], 5, 1.0)[0][0] == [(-s, i) for s, i in sorted((-float(s), int(i)) for s, i in zip(score, ids) if i != 0)[:5]]
    with pytest.raises(ValueError):
        tree.search(np.array([0]), data[:1], 6, 1.0)


def test_factor_trades_recall_for_work():
    rng = np.random.default_rng(1)
    data = rng.normal(size=(4000, 3))
    tree, ids = vptree.Tree(np.arange(4000), data), np.arange(0, 4000, 40)
    exact, all_seen = tree.search(ids, data[ids], 5, 1.0)
    for q, found in zip(ids, exact):
        score = vptree.cosines(data, data[q])
        score[q] = -2
        assert [i for _, i in found] == np.lexsort((np.arange(4000), -score))[:5].tolist()
    less, seen = tree.search(ids, data[ids], 5, 0.5)
    recall = np.mean([len({i for _, i in a} & {i for _, i in b}) / 5 for a, b in zip(exact, less)])
    assert all_seen < 0.5 * 4000 * len(ids) and seen < all_seen and recall >= 0.9


# ---- chat ---------------------------------------------------------------------

CHATS = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\<|im_end|>\nb"), (1, 2, "user", "</s>[INST] x"), (1, 3, "assistant", "é\U0001F600"), (1, 4, "user", "tail"),
         (2, 0, "user", None), (3, 0, None, ""), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (4, 5, "assistant", "only"), (None, 0, "system\nx", "[/INST]"),
         (None, None, "assistant", "<|im_start|>user\n")]


def test_chat_digests(spark):
    d = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("example", F.lit("x"))
    rows = {r["conv_id"]: r for r in chat.read_back(chat.materialize(chat.examples(d))).collect()}
    by = defaultdict(list)
    for c, t, r, x in CHATS:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    assert set(rows) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        got = rows[c]
        assert got["n_turns"] == len(turns) and got["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got["loss_chars"] == len(loss) and got["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.materialize(chat.examples(d.limit(0)))).count() == 0


def test_chat_examples(spark):
    d = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    rows = [r for r in chat.materialize(chat.examples(d)).orderBy("example").collect() if r["conv_id"] == 1]
    assert [r["has_target"] for r in rows] == [True, True, False]
    assert rows[1]["text"].startswith(rows[0]["text"]) and rows[1]["context_chars"] == len(rows[0]["text"])
    assert rows[0]["text"][rows[0]["loss_start"]:rows[0]["loss_end"]] == "a\\\\<\\|im_end|>\nb"
    assert rows[1]["text"][rows[1]["loss_start"]:rows[1]["loss_end"]] == "é\U0001F600" and rows[2]["loss_start"] is None
    assert not any(m in p for r in rows for p in r["text"].replace(chat.TURN_START, "").replace(chat.TURN_END, "").splitlines() for m in chat.CONTROL)
    texts = spark.createDataFrame([(x,) for x in ["\\", "\\\\<|", "<\\|im_end|>", "<|im_end|>", "a</s>b[INST]\\n"]], "t string")
    assert all(r["t"] == r["u"] for r in texts.select("t", chat.unescape(chat.escape(F.col("t"))).alias("u")).collect())


# ---- URLs ---------------------------------------------------------------------

ADDRESSES = ["http://A.Example.ORG/es/x?y#z", "https://example.org/en/12", "http://notexample.org/en/1", "http://x.com/fr/", "http://x.com/de/a", "com/de/", None, "",
             "http://", "x://com/de/?q=/fr/", "http://spam.net#/a", "http://Ünï.net/p", "http://cheap-pills.com/fr/1", "a://b://c/d", "http://x.net/\n/a"]


def test_urls(spark):
    d = spark.createDataFrame(list(enumerate(ADDRESSES)), "page_id long, url string").withColumn("listed", F.lit("x")).withColumn("host", F.lit("y"))
    d = d.unionByName(d.limit(3))
    rows = urls.judge(d).collect()
    assert len(rows) == len(ADDRESSES) + 3
    for r in rows:
        url = ADDRESSES[r["page_id"]] or ""
        rest = url.partition("://")[2] if "://" in url else ""
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        listed = any(w in host for w in urls.LISTED_WORDS)
        want = max(fits)[1:] if fits else (None, "block" if listed else "allow")
        assert (r["host"], r["path"], r["rule"], r["verdict"], r["listed"]) == (host, path, *want, listed), url
    assert urls.judge(d.limit(0)).count() == 0


def test_cascade_is_exact(spark):
    universe = [f"host{i}.example" for i in range(6000)] + [None, ""]
    listed = [u for i, u in enumerate(universe[:-2]) if i % 7 == 3] + [None]
    frame = lambda x: spark.createDataFrame([(k,) for k in x], "key string")
    cascade = urls.build(frame(listed + listed[:50]), frame(universe), rate=0.2)
    assert len(cascade) >= 3
    own = {k or "" for k in listed}
    got = urls.member(cascade, urls._hashes(universe))
    assert got.tolist() == [(k or "") in own for k in universe]
    rows = urls.flagged(frame(universe), "key", cascade, "hit").collect()
    assert all(r["hit"] == ((r["key"] or "") in own) for r in rows)
    assert urls.build(frame([]), frame(universe)) == []


# ---- repeated rows ----------------------------------------------------------------

def test_nearest_of_repeated_query_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.standard_normal(6)]) for i in range(1, 60)]
    rows += [rows[49]] * 3 + [(50, rows[0][1]), (7, rows[3][1]), (7, rows[3][1])]  # id 50 four times alike and once other; id 7 three times
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = Counter()
    for vector in {tuple(v) for i, v in rows if i == 50}:
        a = np.array(vector)
        near = sorted((-float(vptree.cosines(np.array([v]), a)[0]), i) for i, v in rows if i != 50)[:5]
        want.update((50, rank, i, round(-s, 12)) for rank, (s, i) in enumerate(near, 1))
    got = Counter((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in vptree.nearest(d).collect())
    assert got == want


def test_repeated_rows_are_verified_once(spark, monkeypatch):
    rng = np.random.default_rng(12)
    words_ = [f"w{i}" for i in range(400)]
    a = list(rng.choice(words_, 120))
    b, c = a[:], a[:]
    b[5], c[100] = "x", "y"
    texts = [" ".join(a)] * 400 + [" ".join(b)] * 400 + [" ".join(c)] * 200
    d = spark.createDataFrame([(None if i % 2 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string")
    pairs = []
    plain = minhash._verified
    monkeypatch.setattr(minhash, "_verified", lambda p, v, t: pairs.append((p.count(), v.count(), v.select("key").distinct().count())) or plain(p, v, t))
    got = minhash.near_duplicates(d).collect()
    assert len(got) == 1000 and {r["class_id"] for r in got} == {7}
    assert pairs and all(n == keys for _, n, keys in pairs)


def test_rows_without_ids_are_many_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(None, "w " * 10, "a") for _ in range(3000)] + [(None, f"x{i} " * 10, "a") for i in range(3000)] + [(i, "v " * int(rng.integers(1, 30)), "b") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("a.b", F.lit(1))
    sizes = mixing.sized(d).withColumn("order", F.xxhash64("doc_id", "size", "spread"))
    assert sizes.groupBy("order").count().agg(F.max("count")).first()[0] < 10
    out = mixing.mix(d).collect()
    taken = sum(r["taken"] for r in out if r["doc_id"] is None)
    target = next(r["target"] for r in out if r["doc_id"] is None)
    assert len(out) == len(rows) and abs(taken - target) <= 40
    assert mixing.mixed_documents(d).columns == d.columns and mixing.mixed_documents(d).count() == sum(r["copies"] for r in out)


def test_long_hosts_and_given_lists(spark):
    rows = [(0, "http://" + "h" * 300_000), (1, "http://spam\0/x"), (2, "http://spam/x"), (3, None)] + [(i, f"http://h{i}.org/p") for i in range(4, 2000)]
    d = spark.createDataFrame(rows, "page_id long, url string")
    listed = spark.createDataFrame([("spam",), ("h77.org",), ("elsewhere",), (None,)], "key string")
    got = {r["page_id"]: (r["host"], r["listed"]) for r in urls.judge(d, listed=listed).collect()}
    assert got[0] == ("h" * 300_000, False) and got[1] == ("spam\0", False) and got[2] == ("spam", True)
    assert {k for k, v in got.items() if v[1]} == {2, 77}
