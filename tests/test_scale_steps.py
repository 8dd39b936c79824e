"""Steps that must not repeat work or carry texts where numbers do."""

import re

from pyspark.sql import functions as F

from qtemplates.functions import text as T
from qtemplates.operators import annotate as A
from qtemplates.operators import best_bleu as BB
from qtemplates.operators import frequency as K
from qtemplates.operators import generate as G
from qtemplates.operators import lexicon as LX
from qtemplates.plans.catalog import QUERIES

TEXTS = ["How does the model improve, quickly?", "", "?? __ EC1 is ec1", "the use of 12 models", "the use of 12 models", None, "a b c d e f g h " * 40]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_running_sums_of_any_size(spark):
    sizes = [0, 1, 2, 63, 64, 65, 128, 129, 5000]
    rows = spark.createDataFrame([(n, [i % 7 for i in range(n)]) for n in sizes], "n int, x array<int>")
    for r in rows.select("n", "x", A.prefix_sums(F.col("x")).alias("s")).collect():
        assert r["s"] == [sum(r["x"][:i + 1]) for i in range(r["n"])]


def test_starters_annotate_once(spark, tmp_path):
    spark.createDataFrame([(1, "en", "What is new\nWe go")], "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert _plan(QUERIES["starter_tokens"](spark, str(tmp_path))).count("regexp_extract_all") == 1


def test_small_lexicon_needs_no_shuffle(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "k int, q string")
    out = LX.annotate_with_lexicon(df, "q", LX.default_lexicon(spark))
    assert not re.search("Join|Aggregate", _plan(out))


def test_joined_lexicon_is_the_inlined_one(spark, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "k int, q string")
    words = LX.extend_lexicon(LX.default_lexicon(spark), spark.createDataFrame([("model", "VERB", True), ("12", "VERB", False), ("ec1", "ADJ", False)], LX.SCHEMA))
    inlined = LX.annotate_with_lexicon(df, "q", words).orderBy("k").collect()
    monkeypatch.setattr(LX, "INLINED", 3)
    assert LX.annotate_with_lexicon(df, "q", words).orderBy("k").collect() == inlined
    assert [t["pos"] for t in inlined[2]["tokens"]][-3:] == ["PROPN", "AUX", "ADJ"]


def test_pairs_meet_sets_behind_the_grouping(spark):
    sets = spark.createDataFrame([(1, 2, [1, 2], [3], [], []), (2, 2, [1, 2], [4], [], [])], "id long, len int, g1 array<long>, g2 array<long>, g3 array<long>, g4 array<long>")
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "te long, tr long")
    scored = BB._scored(pairs, sets, sets)
    assert "collect_list(tr" in _plan(scored)
    assert {(r["te"], r["tr"]): round(r["s"], 6) for r in scored.collect()}[(1, 1)] > 0 and scored.count() == 3


def test_generator_gets_slices_of_a_batch(spark):
    prompt = "x" * 100_000
    df = spark.range(40).coalesce(1).select("id", F.when(F.col("id") != 7, F.lit(prompt)).alias("prompt"), F.array(F.col("id")).alias("more"))
    made = G.generate_text(df, lambda: lambda ps: [f"{len(ps)} {sum(len(p or '') for p in ps)}" for _ in ps]).orderBy("id").collect()
    assert [(r["id"], r["more"]) for r in made] == [(i, [i]) for i in range(40)]
    assert max(int(r["generated_text"].split()[1]) for r in made) <= 1 << 20  # all 40 in one call before


def test_longer_prompts_go_alone(spark):
    df = spark.createDataFrame([(0, "ab"), (1, "y" * (3 << 20)), (2, "c"), (3, None)], "id int, prompt string").coalesce(1)
    made = G.generate_text(df, lambda: lambda ps: [None if p is None else str(len(p)) for p in ps]).orderBy("id").collect()
    assert [r["generated_text"] for r in made] == ["2", str(3 << 20), "1", None]


def test_patterns_need_the_beginning_only(spark):
    tail = " and more of the same" * 50
    texts = ["Is it a new model" + tail, "is it, a new model!", "is it a new modelling" + tail, "?!\x1c ", "a - b", " 　Is it a new model\n" + tail, "", None, "\x1f"]
    df = spark.createDataFrame([(t,) for t in texts], "q string")
    assert max(len(r[0]) for r in df.select(T.opening("q", 5)).collect() if r[0]) < 30
    got = [tuple(r) for r in K.pattern_frequency(df, "q", 5, 1).collect()]
    assert got == [("is it a new model", 3), ("a b", 1), ("is it a new modelling", 1)]
    from qtemplates.functions.text import py_split, py_strip
    whole = F.regexp_replace(py_strip("q"), T.NON_WORD_PUNCT, "")
    rows = df.select(T.question_pattern("q").alias("a"), F.lower(F.array_join(F.slice(py_split(whole), 1, 5), " ")).alias("b")).collect()
    assert [r["a"] or "" for r in rows] == [r["b"] or "" for r in rows]
    # no whole text is sorted, moved or stripped for it
    assert "min(q" not in _plan(K.pattern_frequency(df, "q", 5, 1))


def test_strip_trims_every_white_space(spark):
    chars = [chr(c) for c in range(1, 0x3100)]
    rows = spark.createDataFrame([(c + "a" + c + "b" + c,) for c in chars] + [(c,) for c in chars], "s string")
    got = rows.select("s", T.py_strip("s").alias("t"), T.not_blank("s").alias("full")).collect()
    assert all(r["t"] == r["s"].strip() and r["full"] == (r["s"].strip() != "") for r in got)
    assert "regexp" not in _plan(rows.select(T.py_strip("s")))


def test_row_numbers_move_no_rows(spark, tmp_path, monkeypatch):
    from qtemplates.sources.order import number_rows
    spark.range(1000).repartitionByRange(5, "id").write.csv(str(tmp_path / "x"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        numbered = number_rows(spark.read.schema("id long").csv(str(tmp_path / "x")))
        assert "BroadcastHashJoin" in numbered._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in numbered.select("id", "row_no").collect()) == [(i, i) for i in range(1000)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_shingles_of_a_few_rows_at_once(spark, monkeypatch):
    import pyarrow as pa

    from qtemplates.llm import minhash
    batch = pa.RecordBatch.from_pydict({"key": [b"k"] * 2000, "doc_id": list(range(2000)), "text": ["a b c d e f"] * 2000})
    held = {}

    class Rows:  # stands for the DataFrame: takes the function
        def select(self, *_):
            return self

        def mapInArrow(self, run, _schema):
            held["out"] = list(run([batch]))
    monkeypatch.setattr(minhash, "content_key", lambda: F.lit(1))
    minhash.vectors(Rows())
    assert max(b.num_rows for b in held["out"]) <= minhash._ROWS_AT_ONCE and sum(b.num_rows for b in held["out"]) == 2000


def test_grams_are_counted_in_their_row(spark):
    from collections import Counter

    import pyarrow as pa

    from qtemplates.operators import bleu as B
    texts = ["a b a b a", "a", "b a b a", " ".join("abcde"[i * i % 5] for i in range(70_000)), "c", " ".join(f"w{i}" for i in range(70_000))]
    hashes = {w: hash(w) % (1 << 62) for t in texts for w in t.split()}
    batch = pa.RecordBatch.from_pydict({"mult": pa.array(range(1, 8), pa.int64()), "w": pa.array([[]] + [[hashes[w] for w in t.split()] for t in texts], pa.list_(pa.int64()))})
    parts = list(B._counted(batch))
    got = Counter((r["mult"], r["n"], r["c"]) for p in parts for r in p.to_pylist())
    want = Counter()
    for i, t in enumerate(texts):
        w = t.split()
        for n in range(1, 5):
            for c in Counter(tuple(w[k:k + n]) for k in range(len(w) - n + 1)).values():
                want[i + 2, n, c] += 1
    assert got == want and len(parts) >= 8  # in slices
    # equal n-grams of different templates have one hash
    two = [{r["h"] for r in p.to_pylist() if r["mult"] in (2, 4) and r["n"] == 2} for p in B._counted(batch)]
    assert max(map(len, two)) == 2
    df = B.gram_counts(spark.createDataFrame([(1, ["a", "b", "a"])], "mult long, toks array<string>"))
    assert "Aggregate" not in _plan(df) and sorted((r["n"], r["c"]) for r in df.collect()) == [(1, 1), (1, 2), (2, 1), (2, 1), (3, 1)]
