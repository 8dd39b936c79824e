from qtemplates.operators import frequency as K


def test_chunk_table_fixture(spark):
    df = spark.createDataFrame([("a", "p"), ("a", ""), ("b", "p"), ("B ", "q")], "EC1 string, PC1 string")
    ranked = {(r.marker, r.rank): (r.chunk, r.frequency) for r in K.chunk_frequency(df, ["EC1", "PC1"]).collect()}
    assert ranked == {("EC1", 1): ("a", 2), ("EC1", 2): ("b", 2), ("PC1", 1): ("p", 2)}
    t = sorted(K.chunk_table(df, ["EC1", "PC1"]).collect())
    assert [tuple(r) for r in t] == [(1, "a", "2", "p", "2"), (2, "b", "2", "", "")]


def test_pattern_frequency(spark):
    qs = ["What is the effect of x?", "what is the effect of y", "How?", "How", "", "?!"]
    df = spark.createDataFrame([(q,) for q in qs], "research_question string")
    got = [tuple(r) for r in K.pattern_frequency(df).collect()]
    assert got == [("how", 2), ("what is the effect of", 2)]


def test_template_frequency_and_top_k(spark):
    df = spark.createDataFrame([(t,) for t in ["a ", "a", "b", " ", None, "c", "c", "c"]], "templated_question string")
    got = [tuple(r) for r in K.template_frequency(df).collect()]
    assert got == [("c", 3), ("a", 2), ("b", 1)]
    assert [tuple(r) for r in K.top_k(K.template_frequency(df), 1).collect()] == [("c", 3)]
