from pyspark.sql import functions as F

from qtemplates.functions import text as T


def _one(spark, col_fn, values, schema="x string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(col_fn(F.col("x"))).collect()]


def test_normalize(spark):
    got = _one(spark, T.normalize_template, ["How doesPC2e to ec12 that  do PC1 EC2?", None, "  a  b "])
    assert got == ["How doesPC2e to EC that do PC EC?", "", "a b"]


def test_first_last_words(spark):
    vals = ["a b  c d", "", "x"]
    assert _one(spark, lambda c: T.first_n_words(c, 2), vals) == ["a b", "", "x"]
    assert _one(spark, lambda c: T.last_n_words(c, 2), vals) == ["c d", "", "x"]
    assert _one(spark, lambda c: T.first_n_words(c, 0), vals) == ["", "", ""]
    assert _one(spark, lambda c: T.last_n_words(c, 9), vals) == ["a b c d", "", "x"]


def test_clean_line(spark):
    lines = ["1. What is it?", '2) "How?"', "", "3D models?"]
    assert _one(spark, lambda c: T.clean_line(c, "strict"), lines) == ["What is it?", "How?", "", "3D models?"]
    assert _one(spark, lambda c: T.clean_line(c, "loose"), lines) == ["What is it?", "How?", "", "D models?"]


def test_question_pattern(spark):
    got = _one(spark, T.question_pattern, ['What is, the "effect" of é-mail?', "Él no-va", "?!", "a b c d e f g"])
    assert got == ["what is the effect of", "él nova", None, "a b c d e"]


def test_strip_and_split_unicode(spark):
    assert _one(spark, T.py_strip, ["  x y \n"]) == ["x y"]
    df = spark.createDataFrame([("a b  c",)], "x string")
    assert df.select(T.py_split("x")).first()[0] == ["a", "b", "c"]


def test_null_if_na(spark):
    got = _one(spark, T.null_if_na, ["NA", "n/a", "ok", "", "None"])
    assert got == [None, None, "ok", None, None]
