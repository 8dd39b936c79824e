import os

import pytest
from pyspark.sql import functions as F

from qtemplates.functions import prefix as PF
from qtemplates.operators import generate as G
from qtemplates.sources import io as IO
from qtemplates.sources import pages as H

PAGE = ('<html><body>'
        '<div class="card-body p-3 small">First <i>abstract</i> &amp; more</div>'
        '<p class="d-sm-flex align-items-stretch"><span>x</span><strong><a href="/p/1">Title 1</a></strong></p>'
        '<div class="card-body p-3 small">Second abstract</div>'
        '<p class="d-sm-flex align-items-stretch"><strong>Title without link</strong></p>'
        '<p class="d-sm-flex align-items-stretch">no strong here</p>'
        '<a class="x" href="/volumes/a/">v</a><a href="/volumes/b/">w</a><a href="/other">o</a>'
        '</body></html>')


def test_abstracts_from_pages(spark):
    pages = spark.createDataFrame([("http://site/v1", PAGE)], "url string, html string")
    rows = H.abstracts_from_pages(pages, "div", "card-body p-3 small", "p", "d-sm-flex align-items-stretch",
                                  "https://base").orderBy("id").collect()
    assert [(r.id, r.title, r.abstract, r.url) for r in rows] == [
        (1, "Title 1", "First abstract & more", "https://base/p/1"),
        (2, "Title without link", "Second abstract", "No URL")]


def test_links(spark):
    pages = spark.createDataFrame([("http://site/v1", PAGE), ("http://site/v2", PAGE)], "url string, html string")
    lk = H.filter_links(H.extract_links(pages), "/volumes/", "/")
    got = [r.link for r in H.distinct_links(H.absolutize(lk, "https://base")).collect()]
    assert got == ["https://base/volumes/a/", "https://base/volumes/b/"]


def test_links_as_written(spark):
    html = ("<A HREF=/up>x</A><a title='x href=/no' href='/single'>y</a><a class=c href=/bare/>z</a><article href=/no></article>"
            "<!-- <a href='/no'> --><script>'<a href=/no>'</script><a data-href='/no'>n</a><a href='/q?a=1&amp;b=&eacute;'>e</a><a\nhref = \"/nl\">l</a>")
    pages = spark.createDataFrame([("u", html), ("u", '<a href="/2">'), ("v", None)], "url string, html string")
    got = sorted((r.url, r.pos, r.href) for r in H.extract_links(pages).collect())
    assert got == [("u", 0, "/2"), ("u", 0, "/up"), ("u", 1, "/single"), ("u", 2, "/bare/"), ("u", 3, "/q?a=1&b=\u00e9"), ("u", 4, "/nl")]


def test_zip_in_the_row(spark):
    page = "<h1> a0&eacute;&nbsp;</h1><h2>b0</h2><h1>a<b>1</b></h1><h2>b1</h2><h1>a2</h1>"
    pages = spark.createDataFrame([("u", page), ("u", page), ("v", "<h1>only</h1>"), ("w", None)], "url string, html string")
    rows = sorted((r.url, r.pos, r.text_a, r.text_b) for r in H.zip_elements(pages, "h1", "h2").collect())
    assert rows == [("u", 0, "a0\u00e9", "b0")] * 2 + [("u", 1, "a1", "b1")] * 2


def test_text_without_scripts(spark):
    pages = spark.createDataFrame([("u", "<div>a<script>var q=1;</script><style>p{}</style> b&middot;</div>")], "url string, html string")
    assert [r.text for r in H.extract_elements(pages, "div").collect()] == ["a b\u00b7"]


def _echo():
    def gen(prompts):
        return [p + "\n1. What is X?\n2) \"How does Y work?\"\n\n3D models?" for p in prompts]
    return gen


def _flaky():
    def gen(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("model failed")
        return [p + "\nQ?" for p in prompts]
    return gen


def test_generation_pipeline(spark):
    abstracts = spark.createDataFrame([(1, "t", " Text one. ", "u1"), (2, "t", "  ", "u2"), (3000, "t", "x", "u3")],
                                      "id long, title string, abstract string, url string")
    q = G.questions_from_abstracts(abstracts, "Abstract: {abstract} {{x}}", _echo, lo=1, hi=2500)
    assert [tuple(r) for r in q.collect()] == [("u1", "What is X?"), ("u1", "How does Y work?"), ("u1", "3D models?")]
    loose = G.questions_from_abstracts(abstracts, "A: {abstract}", _echo, lo=1, hi=2500, numbering="loose")
    assert [r.research_question for r in loose.collect()][-1] == "D models?"
    p = G.render_prompt(abstracts, "A: {abstract} {{x}}").filter("id = 1").first().prompt
    assert p == "A: Text one. {x}"


def test_generation_skip_and_fail(spark):
    df = spark.createDataFrame([("ok",), ("bad",)], "prompt string").coalesce(1)
    kept = G.generate_text(df, _flaky, on_error="skip").collect()
    assert [r.prompt for r in kept] == ["ok"]
    try:
        G.generate_text(df, _flaky, on_error="fail").collect()
        raise AssertionError("expected failure")
    except Exception as e:  # noqa: BLE001
        assert "model failed" in str(e)


def _short(prompts=None):
    def gen(prompts):
        if len(prompts) > 1:
            return ["only one"]  # too few for the batch
        return ["text"] if prompts[0] != "none" else []
    return gen


def test_generation_with_too_few_texts(spark):
    df = spark.createDataFrame([("a",), ("none",), ("b",)], "prompt string").coalesce(1)
    kept = G.generate_text(df, _short, on_error="skip").collect()
    assert [r.prompt for r in kept] == ["a", "b"]
    with pytest.raises(Exception, match="gave 1 texts for 3 prompts"):
        G.generate_text(df, _short, on_error="fail").collect()


def test_csv_keeps_edges(spark, tmp_path):
    texts = ["  lead and trail  ", "tab\t", "\ta", " ", 'q " q', " ,", "x\r"]
    path = str(tmp_path / "edges")
    IO.write_csv(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "url string, research_question string"), path)
    got = {int(r.url): r.research_question for r in IO.read_questions(spark, path, na="none").collect()}
    assert got == dict(enumerate(texts))


def test_write_matches_keeps_other_levels(spark, tmp_path):
    df = spark.createDataFrame([("t", "full_exact", None), ("u", "forward_first_n", 3), ("v", "backward_last_n", 10)], "templated_question string, match_type string, n_words int")
    IO.write_matches(df, str(tmp_path / "m"))
    assert IO._csv(spark).csv(str(tmp_path / "m")).count() == 3
    IO.write_matches(df, str(tmp_path / "n"), levels=[("full_exact", None), ("forward_first_n", 3)])
    assert IO._csv(spark).csv(str(tmp_path / "n")).count() == 2


def test_prefix_tables(spark, tmp_path):
    pat = str(tmp_path / "p.csv")
    with open(pat, "w") as f:
        f.write("pattern\n What is the impact of\nwhat is\n\nhow\n")
    pre = IO.load_prefix_table(spark, pat)
    qs = ["What is the impact of x", "what is the impact", "What isx", "how", "  Which do y", "zzz", "", None, "What is  the impact of"]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(qs)], "i int, q string")
    listed = [r.pattern for r in pre.orderBy("rank").collect()]
    assert listed[:3] == ["what is the impact of", "what is", "how"] and len(listed) == len(set(listed))
    want = {r.i: r.e for r in df.select("i", PF.prefix_end(F.col("q"), listed).alias("e")).collect()}
    got = {r.i: r.prefix_end for r in PF.prefix_end_from(df, "q", pre).collect()}
    assert got == want
    bad = str(tmp_path / "bad.csv")
    with open(bad, "w") as f:
        f.write("other\nx\n")
    with pytest.raises(ValueError):
        IO.load_prefix_table(spark, bad)


def test_checkpoint_folder_needs_a_setting_on_clusters():
    from qtemplates.session import checkpoint_dir

    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Fake:
        def __init__(self, master):
            self.conf = Conf({"spark.master": master})

        @property
        def sparkContext(self):  # noqa: N802
            raise RuntimeError
    for master in ("yarn", "spark://x:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            checkpoint_dir(Fake(master))
    for master in ("local", "local[4]"):
        assert checkpoint_dir(Fake(master))


def test_remove_stages(spark):
    import os

    from qtemplates import session
    df = session.cut_lineage(spark.range(3), "gone")
    folder = session._STAGES[-1].removeprefix("file://")
    assert df.count() == 3 and os.path.isdir(folder)
    keep = session._STAGES[:-1]
    session._STAGES[:] = session._STAGES[-1:]
    assert session.remove_stages(spark) == 1 and not os.path.isdir(folder)
    session._STAGES[:] = keep


def test_csv_roundtrip_and_prefixes(spark, tmp_path):
    df = spark.createDataFrame([("u", 'He said "hi", then, left\nnew line'), ("v", "NA")], "url string, research_question string")
    path = str(tmp_path / "q")
    IO.write_csv(df, path)
    back = {r.url: r.research_question for r in IO.read_questions(spark, path).collect()}
    assert back == {"u": 'He said "hi", then, left\nnew line', "v": None}
    back2 = {r.url: r.research_question for r in IO.read_questions(spark, path, na="none").collect()}
    assert back2["v"] == "NA"
    pat = str(tmp_path / "p.csv")
    with open(pat, "w") as f:
        f.write("pattern,frequency\nWhat is the impact of ,9\n,3\nhow,2\n")
    pre = IO.load_prefixes(spark, pat)
    assert pre[:2] == ["what is the impact of", "how"] and pre.count("how") == 1
    assert IO.load_prefixes(spark, str(tmp_path / "missing.csv")) == IO.DEFAULT_PREFIXES


def test_pairs_and_guards(spark, tmp_path):
    pat = str(tmp_path / "pairs.csv")
    with open(pat, "w") as f:
        f.write("train_templates,test_templates\na b,c\n, d\ne,\n")
    got = sorted((r.split, r.template) for r in IO.read_template_pairs(spark, pat).collect())
    assert got == [("test", " d"), ("test", "c"), ("train", "a b"), ("train", "e")]
    df = spark.createDataFrame([("x",)], "a string")
    try:
        IO.require_columns(df, ["a", "templated_question"])
        raise AssertionError
    except ValueError as e:
        assert "templated_question" in str(e)
    assert IO.select_existing(df, ["zz", "a"]).columns == ["a"]


def test_abstract_json(spark, tmp_path):
    df = spark.createDataFrame([(1, "Tïtle", "Abstrâct", "u")], "id long, title string, abstract string, url string")
    path = str(tmp_path / "a")
    IO.write_abstracts(df, path)
    assert IO.read_abstracts(spark, path, json_array=False).first().title == "Tïtle"
    arr = str(tmp_path / "arr.json")
    with open(arr, "w", encoding="utf-8") as f:
        f.write('[{"id": 1, "title": "T", "abstract": "A", "url": "U"},\n {"id": 2, "title": "T2", "abstract": "B", "url": "V"}]')
    assert IO.read_abstracts(spark, arr).count() == 2
    assert os.path.exists(path)


def test_generator_built_once_per_worker(spark):
    """The factory runs once per Python worker, not once per task."""
    def make():
        import os
        n = int(os.environ.get("QT_FACTORY_CALLS", "0")) + 1
        os.environ["QT_FACTORY_CALLS"] = str(n)
        return lambda prompts: [str(n) for _ in prompts]
    df = spark.range(64).selectExpr("cast(id as string) as prompt").repartition(16)
    calls = {int(r.generated_text) for r in G.generate_text(df, make).collect()}
    assert calls == {1}


def test_read_prompt_and_write_splits(spark, tmp_path):
    p = tmp_path / "prompt.txt"
    p.write_text("  Write questions.\n\nAbstract:\n{abstract}\n\n", encoding="utf-8")
    assert IO.read_prompt(spark, str(p)) == "Write questions.\n\nAbstract:\n{abstract}"
    from qtemplates.operators import split as X
    df = spark.range(20).withColumnRenamed("id", "k")
    out = str(tmp_path / "splits")
    IO.write_splits(X.split_exact(df, "k"), out)
    back = IO._csv(spark).csv(out)
    assert sorted(r.split for r in back.select("split").distinct().collect()) == ["test", "train"]
    assert back.filter("split = 'test'").count() == 4


def test_row_numbers_follow_files_and_splits(spark, tmp_path):
    """Many splits of several files, packed into few partitions."""
    import csv
    rng = __import__("random").Random(3)
    rows = []
    for name, n in (("b.csv", 700), ("a.csv", 41), ("c.csv", 1), ("d.csv", 0), ("e.csv", 900)):
        own = [f"{name} {i} " + "x" * rng.randint(0, 60) for i in range(n)]
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f)
            w.writerow(["research_question", "pattern"])
            w.writerows([q, f" P{q[:8]} "] for q in own)
        rows += [(name, q) for q in own]
    want = [q for _, q in sorted(rows, key=lambda r: r[0])]
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for multi_line in (False, True):
            got = IO.read_questions(spark, str(tmp_path), multi_line=multi_line, order="n").collect()
            assert [r.research_question for r in sorted(got, key=lambda r: r.n)] == want
            assert sorted(r.n for r in got) == list(range(len(want)))
        ranks = {r.pattern: r["rank"] for r in IO.load_prefix_table(spark, str(tmp_path)).collect()}
        firsts = list(dict.fromkeys(f"p{q[:8]}".strip().lower() for q in want))
        assert [p for p in sorted(ranks, key=ranks.get) if p in set(firsts)] == firsts
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_first_seen_ties(spark):
    from qtemplates.operators import coverage as C
    from qtemplates.operators import frequency as K
    rows = [(5, "b x"), (1, "z y"), (9, "b x"), (7, "z y"), (3, "c"), (2, None), (0, "c ")]
    df = spark.createDataFrame(rows, "n long, research_question string").withColumnRenamed("research_question", "templated_question")
    assert [tuple(r) for r in K.template_ranks(df, order_by="n").orderBy("rank").select("templated_question", "frequency", "rank").collect()] == [("c", 2, 1), ("z y", 2, 2), ("b x", 2, 3)]
    assert [r.pattern for r in K.pattern_ranks(df, "templated_question", order_by="n").orderBy("rank").collect()] == ["c", "z y", "b x"]
    assert {(r.templated_question, r.n) for r in G.dedup_questions(df, "templated_question", "n").collect()} == {("b x", 5), ("z y", 1), ("c", 3), ("c ", 0)}
    first = C.build_lookup(df, levels=C.level_list((1,), (), False), order_by=F.col("n")).collect()
    assert {(r.key, r.matched_train_template) for r in first} == {("b", "b x"), ("z", "z y"), ("c", "c")}
