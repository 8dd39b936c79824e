"""Lexicon tables, the rules that need them, whole marker maps, repeated split keys."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from qtemplates.operators import annotate as A
from qtemplates.operators import chunk as CH
from qtemplates.operators import frequency as K
from qtemplates.operators import lexicon as LX
from qtemplates.operators import split as X

QS = ["How does the use of EC1 improve 12 parsers?", "The use used, not  to compare", "", "  ", None, "?!", "Was the thing model used?", "Was the thing model used?",
      "éclair-type İstanbul based Pc1 PC2", "x " * 3000]


def test_default_lexicon_is_the_default_tagger(spark):
    df = spark.createDataFrame([(i, q) for i, q in enumerate(QS)], "n int, q string")
    plain = {r.n: r for r in A.annotate(df, "q").collect()}
    got = {r.n: r for r in LX.annotate_with_lexicon(df, "q", LX.default_lexicon(spark)).collect()}
    assert len(got) == len(QS)
    for n, q in enumerate(QS):
        assert (got[n].tokens, got[n].noun_chunks) == ((plain[n].tokens, plain[n].noun_chunks) if q is not None else (None, None))


def test_own_words(spark):
    own = spark.createDataFrame([("thing", "NOUN", False), ("model", "ADV", None), ("the", "PRON", False), ("12", "VERB", False), ("speedy", "VERB", True)], LX.SCHEMA)
    words = LX.extend_lexicon(LX.default_lexicon(spark), own)
    r = LX.annotate_with_lexicon(spark.createDataFrame([("the thing Model 12 a speedy speedy",)], "q string"), "q", words).first()
    assert [t.pos for t in r.tokens] == ["PRON", "NOUN", "ADV", "NUM", "DET", "NOUN", "VERB"]
    with pytest.raises(Exception, match="unknown tag"):
        LX.annotate_with_lexicon(spark.createDataFrame([("the",)], "q string"), "q", spark.createDataFrame([("the", "ARTICLE", False)], LX.SCHEMA)).collect()


def test_the_thing_is_two_entities(spark):
    words = LX.extend_lexicon(LX.default_lexicon(spark), spark.createDataFrame([("thing", "NOUN", False)], LX.SCHEMA))
    df = spark.createDataFrame([("Is the thing model good for speed?",), (None,), ("",)], "research_question string")
    rows = {r.research_question: r for r in CH.extract_template_with_mapping(df, annotator=LX.lexicon_annotator(words)).collect()}
    r = rows["Is the thing model good for speed?"]
    assert r.mapping["EC1"] == "the" and r.mapping["EC2"] == "thing" and r.templated_question.startswith("Is EC1 EC2 ")
    assert rows[""].templated_question == ""


def test_rules_fire(spark):
    from qtemplates.plans.catalog import QUERIES
    rows = QUERIES["question_rules"](spark, "/root/testdata/sf0.001").collect()
    fired = Counter()
    for r in rows:
        m = dict(x.split("=", 1) for x in r.mapping.split("; ") if "=" in x)
        fired["C7"] += r.form == "C7" and r.templated_question.startswith("How EC1 ") and m.get("EC1", "").endswith("al")
        fired["C8"] += r.form == "C8" and m.get("EC1") == "the" and m.get("EC2") == "thing"
        fired["C9a"] += r.form == "C9a" and any(v.endswith("ly") for k, v in m.items() if k.startswith("EC"))
        fired["C9v"] += r.form == "C9v" and any(v.endswith("ed") for k, v in m.items() if k.startswith("EC"))
    assert all(fired[k] >= 50 for k in ("C7", "C8", "C9a", "C9v")), fired


def test_chunks_of_all_markers(spark):
    rows = [({f"EC{i}": f" Chunk{i % 3} " for i in range(1, 40)} | {"PC1": "go"},)] * 2 + [({"EC1": "other", "EC39": "  "},), ({},), (None,)]
    df = spark.createDataFrame(rows, "mapping map<string,string>")
    got = {(r.marker, r["rank"]): (r.chunk, r.frequency) for r in K.chunk_frequency_of_maps(df, min_count=1).collect()}
    assert got[("EC39", 1)] == ("chunk0", 2) and got[("PC1", 1)] == ("go", 2) and got[("EC1", 1)] == ("chunk1", 2) and got[("EC1", 2)] == ("other", 1)
    assert len(got) == 41


@pytest.mark.parametrize("bucket", [4, 200_000])
def test_exact_size_whatever_the_key(spark, bucket):
    rows = [("hot", i, [i]) for i in range(60)] + [(None, i, None) for i in range(15)] + [(f"k{i % 9}", i, [i, 1]) for i in range(30)] + [("same", 1, [1])] * 20
    df = spark.createDataFrame(rows, "key string, n int, a array<int>")
    for test in (0.0, 0.03, 0.2, 0.5, 0.77, 1.0):
        got = X.split_exact(df, "key", test, bucket_rows=bucket)
        assert got.columns == ["key", "n", "a", "split"]
        out = got.collect()
        assert sum(r.split == "test" for r in out) == math.ceil(test * len(rows))
        assert Counter((r.key, r.n) for r in out) == Counter((k, n) for k, n, _ in rows)
        # only one key can have rows on both sides
        sides: dict = {}
        for r in out:
            sides.setdefault(r.key or "", set()).add(r.split)
        assert sum(len(s) == 2 for s in sides.values()) <= 1
