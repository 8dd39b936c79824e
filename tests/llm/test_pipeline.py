"""The pipeline's stages, one after the other, against brute force."""

import itertools
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from qtemplates.llm import minhash, mixing, pieces, quality, secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Test documents with nulls, empty and repeated rows, near copies, secrets
    and an extra column with a dot."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rng = np.random.default_rng(3)
    own = [(None, None, None, None, None), (900_001, "", "en", "s0", 0), (900_002, None, "en", None, 0), (None, "short text", "en", "s0", 10)]
    words = [f"w{i}" for i in range(500)]
    for i in range(12):
        base = list(rng.choice(words, 120))
        near = base[:]
        near[60] = "other"
        key = "".join(rng.choice(list("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789"), 40))
        own += [(910_000 + 3 * i, " ".join(base), "en", "s0", 1), (910_001 + 3 * i, " ".join(near), "en", None, 1), (910_002 + 3 * i, " ".join(base[::-1]) + f" password = {key}.", "en", "s1", 1)]
    own += [own[-1]] * 3
    rows = d.unionByName(spark.createDataFrame(own, d.schema)).withColumn("a.b", F.concat(F.lit("x"), F.col("doc_id").cast("string")))
    rows.write.parquet(f"{folder}/documents.parquet")
    for t in ("labels", "pages"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    return folder


def test_stages_against_brute_force(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, held = docs.columns, {"documents": docs}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, corpus).write.parquet(str(tmp_path / name))
        docs = held[name] = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns if n < len(corpus_pipeline.STAGES) - 1 else docs.columns == [*columns, "pieces"]
    rows = {name: [tuple(r) for r in df.collect()] for name, df in held.items()}
    text, source, size = (columns.index(c) for c in ("text", "source", "n_chars"))

    # quality: exactly the rows that the rules keep
    kept = {r["doc_id"] for r in quality.judge(held["documents"], spark.read.parquet(f"{corpus}/labels.parquet")).filter("kept").collect()}
    ids = Counter(r["doc_id"] for r in quality.judge(held["documents"], spark.read.parquet(f"{corpus}/labels.parquet")).filter("kept").collect())
    assert Counter(r[0] for r in rows["quality"]) == ids and None not in kept
    assert set(rows["quality"]) <= set(rows["documents"])

    # near-duplicates: one row of each class found by comparing all pairs
    before = rows["quality"]
    table = minhash.idf(minhash.vectors(held["quality"]))
    sets = [minhash.shingles(r[text] or "") for r in before]
    root = list(range(len(before)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, j in itertools.combinations(range(len(before)), 2):
        if before[i][text] == before[j][text] or minhash.similarity(sets[i], sets[j], table) >= minhash.THRESHOLD:
            root[max(find(i), find(j))] = min(find(i), find(j))
    least: dict = {}
    for i, r in enumerate(before):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    assert sorted(r[0] for r in rows["near-duplicates"]) == sorted(least.values())

    # secrets: what the scan reports is replaced, all rows stay
    labels, pages = (spark.read.parquet(f"{corpus}/{t}.parquet") for t in ("labels", "pages"))
    model = secrets.fit(secrets.training_samples(held["near-duplicates"], labels, pages))
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan(held["near-duplicates"], model).collect()}
    want = Counter()
    for r in rows["near-duplicates"]:
        out, pos = "", 0
        for _, a, z in (s.split(":") for s in spans[r[0]].split(",") if s):
            if int(a) >= pos:
                out += r[text][pos:int(a)] + secrets.MARK
            pos = max(pos, int(z))
        new = list(r)
        new[text] = out + r[text][pos:]
        new[size] = len(new[text])
        want[tuple(new)] += 1
    assert Counter(rows["secrets"]) == want and any(secrets.MARK in r[text] for r in rows["secrets"])

    # mixture: whole rows, each at most twice, sources near their targets
    n_words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    taken = Counter(rows["mixture"])
    assert set(taken) <= set(rows["secrets"]) and max(taken.values()) <= 2
    targets = {r["source"]: r["target"] for r in mixing.targets(mixing.sized(held["secrets"])).collect()}
    for name, target in targets.items():
        sizes = [n_words(r[text]) for r in rows["secrets"] if r[source] == name]
        got = sum(n_words(r[text]) for r in rows["mixture"] if r[source] == name)
        assert abs(got - target) <= max(sizes)

    # pieces: every row once, decoding to its text
    assert Counter(r[:-1] for r in rows["pieces"]) == Counter(rows["mixture"])
    vocabulary = pieces.Vocabulary(pieces.default_model(), pieces.SHARPNESS)
    assert all(vocabulary.decode(r[-1]) == r[text] for r in rows["pieces"] if r[text])


def test_run_on_empty_tables(spark, corpus, tmp_path):
    for t in ("documents", "labels", "pages"):
        spark.read.parquet(f"{corpus}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[-1] == "pieces"


def test_pieces_sends_each_text_once(spark):
    """A kept text goes to the workers inside its row only; names in other case and nulls as before."""
    rows = [(i, t) for i, t in enumerate(["one two", None, "", "caf\u00e9 \u2581 x", "word " * 300])] + [(None, "one two")]
    want = {(r["doc_id"], tuple(r["pieces"])) for r in pieces.encode_checked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for names in ("doc_id long, text string", "doc_id long, Text string"):
        d = spark.createDataFrame(rows, names)
        out = pieces.encode(d)
        assert out.columns == [*d.columns, "pieces"]
        assert {(r[0], tuple(r["pieces"])) for r in out.collect()} == want
        assert sorted(out.select(*d.columns).collect(), key=str) == sorted(d.collect(), key=str)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("coalesce(") == 0  # no second copy beside the row


def test_lattices_keep_their_room(monkeypatch):
    lattices = pieces.Lattices(pieces.Vocabulary(pieces.default_model(), 1.0))
    monkeypatch.setattr(pieces, "_UNITS", 3)
    seeds, texts = np.array([1], np.uint64), [["some words here"], ["others come later, more"], ["some words here"]]
    high, drawn = lattices.high, [lattices.sample(seeds, t)[0].tolist() for t in texts]
    assert lattices.high is high and drawn[0] == drawn[2]  # forgotten units are written over, not copied
    monkeypatch.setattr(pieces, "_ROOM", 4)
    few = pieces.Lattices(lattices.v)
    assert [few.sample(seeds, t)[0].tolist() for t in texts] == drawn


def test_small_batches(spark):
    from qtemplates.session import small_batches
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    try:
        for asked, then in (("10000", "1000"), ("77", "77")):
            spark.conf.set(key, asked)
            small_batches(spark)
            assert spark.conf.get(key) == then
    finally:
        spark.conf.set(key, before)
