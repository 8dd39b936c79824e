import pytest
from pyspark.sql import functions as F

from conftest import golden
from qtemplates.functions import text as T
from qtemplates.operators import coverage as C


def _frame(spark, vals):
    return spark.createDataFrame([(v,) for v in vals], "templated_question string")


def test_fixture_levels(spark):
    train = _frame(spark, ["What EC1 improves EC2 on EC3?", "What EC1  improves EC2 in EC3?", None, "  "])
    test = _frame(spark, ["What EC4 improves EC1 for EC2?", "What EC1 improves EC2 on EC9?", None, "   ", "Can EC1?"])
    s = {(r.match_type, r.n_words): r for r in C.run_coverage(train, test, forward_levels=(3,), backward_levels=(2,)).collect()}
    assert s[("full_exact", None)].total == 4 and s[("full_exact", None)].matched == 1
    assert s[("full_exact", None)].coverage_pct == 25.0
    assert (s[("forward_first_n", 3)].matched, s[("forward_first_n", 3)].coverage_pct) == (2, 50.0)
    assert (s[("backward_last_n", 2)].matched, s[("backward_last_n", 2)].coverage_pct) == (1, 25.0)
    m = C.coverage_matches(train, test, levels=C.level_list((3,), (), False)).collect()
    assert {r.matched_train_template for r in m} == {"What EC improves EC on EC?"}


def test_empty_test_side(spark):
    train = _frame(spark, ["a b"])
    test = _frame(spark, [None])
    rows = C.run_coverage(train, test).collect()
    assert len(rows) == 15 and all(r.total == 0 and r.coverage_pct == 0.0 for r in rows)


def test_custom_key(spark):
    train = _frame(spark, ["What EC1 is", "Why not"])
    test = _frame(spark, ["what ec3 x", "How"])
    r = C.coverage(train, test, lambda c: F.lower(T.first_n_words(c, 2))).first()
    assert (r.matched, r.total) == (1, 2)


GOLD = [("l_full_exact_matches.csv", "full_normalized", None),
        ("l_forward_first_10_matches.csv", "first_10_words", ("first", 10)),
        ("l_forward_first_11_matches.csv", "first_11_words", ("first", 11)),
        ("l_backward_last_10_matches.csv", "last_10_words", ("last", 10)),
        ("l_backward_last_11_matches.csv", "last_11_words", ("last", 11)),
        ("m_full_exact_matches.csv", "full_normalized", None),
        ("m_forward_first_10_matches.csv", "first_10_words", ("first", 10)),
        ("m_forward_first_11_matches.csv", "first_11_words", ("first", 11)),
        ("m_backward_last_10_matches.csv", "last_10_words", ("last", 10)),
        ("m_backward_last_11_matches.csv", "last_11_words", ("last", 11))]


@pytest.mark.parametrize("name,keycol,level", GOLD)
def test_golden_keys(spark, name, keycol, level):
    rows = golden(name)
    df = spark.createDataFrame([(r["templated_question"], r["normalized_template"], r[keycol],
                                 r["matched_train_template"]) for r in rows],
                               "tq string, nt string, k string, rep string")
    norm = T.normalize_template("tq")
    if level is None:
        key, rep_key = norm, T.normalize_template("rep")
    elif level[0] == "first":
        key, rep_key = T.first_n_words(norm, level[1]), T.first_n_words("rep", level[1])
    else:
        key, rep_key = T.last_n_words(norm, level[1]), T.last_n_words("rep", level[1])
    bad = df.filter((norm != F.col("nt")) | (key != F.col("k")) | (rep_key != F.col("k"))).count()
    assert bad == 0


def test_golden_replay(spark):
    """Matched test rows of a level are found again when the shipped
    representatives are the train side."""
    rows = golden("m_forward_first_10_matches.csv")
    train = _frame(spark, sorted({r["matched_train_template"] for r in rows}))
    test = _frame(spark, [r["templated_question"] for r in rows])
    s = C.coverage_first_n(train, test, 10).first()
    assert s.matched == s.total == len(rows)


def test_percent_rounding(spark):
    # figures of a shipped summary: matched / total -> percent, halves to even
    cases = [(1, 854, 0.12), (606, 854, 70.96), (2, 803, 0.25), (603, 803, 75.09), (10, 803, 1.25), (1, 8, 12.5), (1, 800, 0.12)]
    df = spark.createDataFrame(cases, "m long, t long, want double")
    got = df.select(C.coverage_pct(F.col("m"), F.col("t")).alias("p"), "want").collect()
    assert all(abs(r.p - r.want) < 1e-9 for r in got)


def test_monotone_levels(spark):
    from qtemplates.plans.catalog import _doc_split
    tr, te = _doc_split(spark, "/root/testdata/sf0.001")
    s = {(r.match_type, r.n_words): r.matched for r in C.run_coverage(tr, te).collect()}
    for mt in ("forward_first_n", "backward_last_n"):
        vals = [s[(mt, n)] for n in range(5, 12)]
        assert vals == sorted(vals, reverse=True)


def test_order_independence(spark):
    from qtemplates.plans.catalog import _doc_split
    tr, te = _doc_split(spark, "/root/testdata/sf0.001")
    a = sorted(C.run_coverage(tr, te).collect())
    b = sorted(C.run_coverage(tr.repartition(7), te.repartition(3)).collect())
    assert a == b


def test_coverage_plan_has_no_join(spark):
    from qtemplates.plans.catalog import _doc_split
    tr, te = _doc_split(spark, "/root/testdata/sf0.001")
    plan = C.run_coverage(tr, te)._jdf.queryExecution().executedPlan().toString()
    # the only join is the 15-row level table attached to the per-level counts
    assert plan.count("Join") <= 1
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
