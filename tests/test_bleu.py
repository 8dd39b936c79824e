import random

import pytest

import bleu_bruteforce as BB
from conftest import golden
from qtemplates.operators import bleu as B


def _df(spark, vals):
    return spark.createDataFrame([(v,) for v in vals], "template string")


def test_simple_values(spark):
    tr = _df(spark, ["a b c d", "What is"])
    te = _df(spark, ["a b c d", "What is EC", "zz"])
    got = {r.template: r.bleu for r in B.max_sentence_bleu(tr, te).collect()}
    assert got["a b c d"] == pytest.approx(1.0)
    assert got["zz"] == 0.0
    assert got["What is EC"] == pytest.approx((2 / 3 * 1 / 2 * 0.1 * 0.1) ** 0.25, abs=1e-6)


def test_random_against_bruteforce(spark):
    rng = random.Random(7)
    vocab = ["EC1", "EC2", "PC1", "what", "is", "the", "of", "how", "does", "in", "x", "y", "z"]
    def sent():
        return " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 9)))
    train = [sent() for _ in range(40)]
    test = [sent() for _ in range(60)]
    want = BB.best_scores([t.split() for t in train], [t.split() for t in test])
    got = {r.template: r.bleu for r in B.max_sentence_bleu(_df(spark, train), _df(spark, test)).collect()}
    for t, w in zip(test, want):
        assert got[t] == pytest.approx(w, abs=1e-12)
    avg = B.average_bleu(B.max_sentence_bleu(_df(spark, train), _df(spark, test))).first()[0]
    assert avg == pytest.approx(sum(want) / len(want), abs=1e-12)
    cb = B.corpus_bleu(_df(spark, train), _df(spark, test)).first()[0]
    assert cb == pytest.approx(BB.corpus_bleu([t.split() for t in train], [t.split() for t in test]), abs=1e-12)


def test_regression_values(spark):
    test = [r["templated_question"] for r in golden("m_backward_last_10_matches.csv")] + ["qqq www", "What is EC"]
    train = [r["matched_train_template"] for r in golden("m_forward_first_10_matches.csv")] + ["zzz", "What is"]
    avg = B.average_bleu(B.max_sentence_bleu(_df(spark, train), _df(spark, test))).first()[0]
    cb = B.corpus_bleu(_df(spark, train), _df(spark, test)).first()[0]
    assert avg == pytest.approx(0.1724620938, abs=1e-9)
    assert cb == pytest.approx(0.2251404059, abs=1e-9)


def test_empty_sides(spark):
    empty = spark.createDataFrame([], "template string")
    assert B.corpus_bleu(empty, _df(spark, ["a"])).first()[0] == 0.0
    assert B.average_bleu(B.max_sentence_bleu(_df(spark, ["a"]), empty)).first()[0] == 0.0


def test_no_pair_enumeration_plan(spark):
    tr = _df(spark, ["a b c", "a b d"])
    te = _df(spark, ["a b c"])
    plan = B.max_sentence_bleu(tr, te)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("block, first", [(256, 32), (3, 1)])
def test_threshold_search_against_bruteforce(spark, monkeypatch, block, first):
    from qtemplates.operators import best_bleu
    monkeypatch.setattr(best_bleu, "BLOCK", block)
    monkeypatch.setattr(best_bleu, "FIRST", first)
    rng = random.Random(11)
    rare = [f"r{i}" for i in range(300)]
    vocab = ["EC1", "EC2", "PC1", "what", "is", "the", "of", "how"] * 6 + rare

    def sent(most=12):
        return " ".join(rng.choice(vocab) for _ in range(rng.randint(1, most)))
    train = [sent() for _ in range(150)] + ["the of the of the of", "is"] * 3
    test = [sent() for _ in range(150)] + [" ".join(t.split()[1:] + ["new"]) for t in train[:30]] + train[:5] + [sent(400), "none at all"]
    want = BB.best_scores([t.split() for t in train], [t.split() for t in test])
    best, rounds = best_bleu.best_sentence_bleu(_df(spark, [*train, None, "  "]), _df(spark, [*test, None, " "]))
    got = {r.template: (r.mult, r.bleu) for r in best.collect()}
    assert len(got) == len(set(test))
    for t, w in zip(test, want):
        assert got[t] == (test.count(t), pytest.approx(w, abs=1e-12))
    pairs = [(r.te, r.tr) for x in rounds for r in x.collect()]
    assert len(pairs) == len(set(pairs))  # no pair is scored twice


def test_threshold_search_of_nothing(spark):
    from qtemplates.operators import best_bleu
    empty = spark.createDataFrame([], "template string")
    assert best_bleu.best_sentence_bleu(_df(spark, ["a"]), empty)[0].collect() == []
    assert [r.bleu for r in best_bleu.best_sentence_bleu(empty, _df(spark, ["a"]))[0].collect()] == [0.0]
