import os

from qtemplates.operators import frequency as K
from qtemplates.plans import workflows as W
from qtemplates.sources.tables import doc_lines
from qtemplates.streaming import stream as ST

SF = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark):
    s = ST.run_pattern_stream(spark, f"{SF}/documents*.parquet",
                              "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT", files_per_trigger=1)
    b = K.pattern_frequency(doc_lines(spark, SF), "line", 5, 2)
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, b.collect()))


def _gen():
    def g(prompts):
        return [p + "\n1. What is the effect of EC on speed?\n2. How does the method compare?" for p in prompts]
    return g


def test_workflows(spark, tmp_path):
    abstracts = spark.createDataFrame([(i, "t", f"Abstract {i}.", f"u{i}") for i in range(1, 6)],
                                      "id long, title string, abstract string, url string")
    n = W.abstracts_to_questions(abstracts, "A: {abstract}", _gen, str(tmp_path / "q"))
    assert n == 10
    from qtemplates.sources import io as IO
    q = IO.read_questions(spark, str(tmp_path / "q"))
    assert W.questions_to_templates(q, str(tmp_path / "t")) == 2
    t = IO.read_templates(spark, str(tmp_path / "t"))
    summary = W.coverage_report(t, t, str(tmp_path / "cov")).collect()
    assert summary[0].match_type == "backward_last_n" and len(summary) == 15
    assert os.path.isdir(str(tmp_path / "cov" / "matches"))
    r = W.bleu_report(t, t)
    assert abs(r["sentence_bleu"] - 1.0) < 1e-9
    pre = [r.pattern for r in W.learned_prefixes(q, min_count=2).orderBy("rank").collect()]
    assert pre[0] in ("how does the method compare", "what is the effect of")


def test_stream_several_batches(spark, tmp_path):
    """Two input files, one file per trigger: totals equal the batch result."""
    src = tmp_path / "docs"
    d = spark.read.parquet(f"{SF}/documents.parquet")
    d.filter("lang = 'en'").coalesce(1).write.parquet(str(src / "a"))
    d.filter("lang <> 'en'").coalesce(1).write.parquet(str(src / "b"))
    s = ST.run_pattern_stream(spark, f"{src}/*/*.parquet",
                              "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT", files_per_trigger=1)
    b = K.pattern_frequency(doc_lines(spark, SF), "line", 5, 2)
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, b.collect()))


def _files(spark, tmp_path, n=7):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    d.repartition(n, "doc_id").write.parquet(str(tmp_path / "docs"))
    return str(tmp_path / "docs")


SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def test_stateful_streams_equal_batch(spark, tmp_path):
    from qtemplates.operators import coverage as C
    from qtemplates.operators import split as X
    from qtemplates.streaming import state as SS
    src = _files(spark, tmp_path)
    run = lambda rows, merge: SS.run_stream(spark, src, SCHEMA, rows, merge, files_per_trigger=2, compact_every=2)
    lines = doc_lines(spark, SF).select("line", "doc_id", "line_no").collect()
    first = {}
    for r in lines:
        first[r.line] = min(first.get(r.line, (1 << 60, 0)), (r.doc_id, r.line_no))
    got = {r.research_question: tuple(r.place) for r in run(SS.stream_questions, SS.first_questions).collect()}
    assert got == first
    d = doc_lines(spark, SF).withColumnRenamed("line", "templated_question")
    is_test = X.split_hash_col("doc_id")
    want = C.run_coverage(d.filter(~is_test), d.filter(is_test)).collect()
    assert sorted(map(str, C.summary(run(SS.stream_coverage, C.covered_keys)).collect())) == sorted(map(str, want))
    levels = C.level_list((5,), (3,), True)
    from pyspark.sql import functions as F
    plain = C.build_lookup(d, levels=levels, order_by=F.struct("doc_id", "line_no"))
    kept = run(lambda b: SS.stream_lookup(b, levels), SS.first_templates)
    assert {(r.match_type, r.n_words, r.key, r.norm) for r in kept.collect()} == {(r.match_type, r.n_words, r.key, r.matched_train_template) for r in plain.collect()}


def test_state_with_replays_and_compaction(spark, tmp_path):
    """Batches played again, before and after a compaction, and one that was
    cut off while the base was written."""
    from pyspark.sql import functions as F

    from qtemplates.streaming.state import KeyedState
    merge = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    batches = [[("a", 1), ("b", 2), ("a", 3)], [("b", 1)], [], [("c", 5)], [("a", 1), ("c", 1)], [("d", 9)], [("a", 2)]]
    df = lambda b: spark.createDataFrame(b, "k string, n long")
    state = KeyedState(spark, str(tmp_path / "s"), merge, compact_every=3)
    assert state.read() is None
    want: dict = {}
    for i, b in enumerate(batches):
        for k, n in b:
            want[k] = want.get(k, 0) + n
        state.put(df(b), i)
        state.put(df(b), i)
        if i:
            state.put(df(batches[i - 1]), i - 1)
        state = KeyedState(spark, str(tmp_path / "s"), merge, compact_every=3)  # a new driver
        (tmp_path / "s" / "base" / "batch-99").mkdir(parents=True, exist_ok=True)  # no _SUCCESS
        assert {r.k: r.n for r in state.read().collect()} == want
        assert len(state._held("delta")) < 3 and len(state._held("base")) <= 1
    assert state._held("base") == [5]
