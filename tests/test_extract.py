"""Extraction by word lists against the same rules as Columns."""

import random

import pytest
from pyspark.sql import functions as F

from qtemplates.operators import annotate as A
from qtemplates.operators import chunk as CH
from qtemplates.operators import lexicon as LX
from qtemplates.plans.catalog import QUERIES

WORDS = ["How", "how", "the", "thing", "a", "this", "any", "many", "its", "what", "Which", "whose", "can", "do", "is", "are", "to", "not", "use", "used", "improve", "predict",
         "quickly", "final", "models", "EC1", "PC3", "ec1", "Pc2", "EC12a", "12", "1a", "²", "_", "__", "?", "!", ",", "\x1c", "\x1f", "́", "İstanbul", "ΣΣ", "\U0001d400",
         "\U0001f600", "of", "in", "based", "on", "impact", "types", "performance", "given", "might", "there", "useful", "ing", "ly", "漢字", " ", "\x85"]


def _texts(n=1500):
    rng = random.Random(3)
    made = ["".join(rng.choice(WORDS) + rng.choice(["", " ", " ", " ", "  ", "\t"]) for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 20]))) + rng.choice(["", "", "?"]) for _ in range(n)]
    return [None, "", " ", "?", "\x1c", "　x　", "Is the thing model good for speed?", "How deep go neural networks?", *made]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("again", [True, False])
@pytest.mark.parametrize("own", [False, True])
def test_same_rows_as_the_columns(spark, again, own):
    df = spark.createDataFrame(list(enumerate(_texts())), "n int, research_question string").repartition(4)
    words, prefixes = None, None
    if own:
        words = LX.extend_lexicon(LX.default_lexicon(spark), spark.createDataFrame([("thing", "NOUN", False), ("speed", "VERB", True), ("漢字", "VERB", False), ("how", "NOUN", False),
                                                                                    ("any", "NOUN", False)], LX.SCHEMA))
        prefixes = ["the thing", "how", "a.b"]
    listed = LX.lexicon_annotator(words) if own else None
    as_columns = (lambda d, q, t, c: LX.annotate_with_lexicon(d, q, words, t, c)) if own else (lambda d, q, t, c: A.annotate(d, q, t, c))
    for profile in ("mapping", "fast"):
        got, want = ({r.n: r for r in CH.extract_template_with_mapping(df, profile=profile, prefixes=prefixes, annotator=a, reannotate=again).collect()} for a in (listed, as_columns))
        assert got == want


def test_bytes_that_are_no_text(spark):
    df = spark.range(1).select(F.unhex(F.lit("74686520FF6D6F64656C20C3")).cast("string").alias("research_question"))
    assert CH.extract_template(df).first().templated_question == "the \ufffdEC1 \ufffd"


@pytest.mark.parametrize("name", ["extract_template_collapsed", "extract_template_with_mapping", "extract_template"])
def test_extraction_without_lambdas(spark, tmp_path, name):
    """A text goes to one worker, once; no lambda is interpreted for its tokens."""
    spark.createDataFrame([(1, "en", "Is the thing new?\nWe go")], "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES[name](spark, str(tmp_path))
    plan = _plan(df)
    assert plan.count("ArrowEvalPython") == 1 and "regexp_extract_all" not in plan and df.count() == 2


def test_large_lexicon_keeps_the_columns(spark, monkeypatch):
    df = spark.createDataFrame([("Is the thing model good for speed?",)], "research_question string")
    words = LX.default_lexicon(spark)
    small = CH.extract_template_with_mapping(df, annotator=LX.lexicon_annotator(words)).collect()
    monkeypatch.setattr(LX, "INLINED", 3)
    assert CH.extract_template_with_mapping(df, annotator=LX.lexicon_annotator(words)).collect() == small


def test_remembered_words_are_bounded(monkeypatch):
    from qtemplates.operators import extract as X
    monkeypatch.setattr(X, "_REMEMBERED", 5)
    letters = X._Letters(A.default_letters())
    assert "".join(letters[f"w{i}"] for i in range(40)) == "N" * 40 and len(letters) <= 5 and letters["the"] == "D"


def test_lines_meet_the_templates_of_their_questions(spark, tmp_path):
    """Four questions a line are made of distinct lines; only lines are joined."""
    rows = [(1, "en", "Speed is new\nSpeed is new\n12\n"), (1, "en", "Speed is new"), (None, "en", "we go"), (2, "en", None)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES["question_rules"](spark, str(tmp_path))
    assert _plan(df).count("Generate ") == 1  # that of the lines
    got = sorted((r.doc_id or 0, r.line_no, r.form) for r in df.collect())
    lines = [(1, 0), (1, 0), (1, 1), (0, 0)]
    assert got == sorted((d, n, f) for d, n in lines for f in ("C7", "C8", "C9a", "C9v"))


@pytest.mark.parametrize("name", ["question_rules", "chain_chunks", "chain_corpus_bleu", "chain_coverage", "templates_in_order", "write_templates_roundtrip", "templates_from_questions"])
def test_chains_extract_by_word_lists(spark, tmp_path, monkeypatch, name):
    def columns(*_):
        raise AssertionError("extraction as Columns")
    monkeypatch.setattr(CH, "ec_spans", columns)
    spark.createDataFrame([(i, "en", f"How does the parser improve speed {i}?\nWe go") for i in range(4)], "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).count() >= 1
