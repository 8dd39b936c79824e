from pyspark.sql import functions as F

from qtemplates.operators import split as X
from qtemplates.operators.ids import assign_ids, rank_within


def test_exact_sizes(spark):
    for n, k in ((10, 2), (11, 3), (1, 1), (0, 0)):
        df = spark.range(n).withColumnRenamed("id", "k")
        s = X.split_exact(df, "k", bucket_rows=3)
        assert s.filter(F.col("split") == "test").count() == k
        assert s.count() == n


def test_hash_split_matches_md5_rule(spark):
    df = spark.range(200).withColumnRenamed("id", "k")
    a = {r.k for r in X.split_hash(df, "k").filter("split = 'test'").collect()}
    import hashlib
    b = {i for i in range(200) if hashlib.md5(f"42:{i}".encode()).hexdigest()[:8] < "33333333"}
    assert a == b


def test_hash_split_of_all_and_of_few(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    size = lambda t: X.split_hash(df, "k", test=t).filter("split = 'test'").count()
    assert size(1.0) == 20_000 and size(0.0) == 0 and 5 <= size(0.001) <= 45


def test_exact_split_with_repeated_keys(spark):
    df = spark.createDataFrame([(1, i) for i in range(10)], "k int, i int")
    assert X.split_exact(df, "k").filter("split = 'test'").count() == 2
    both = X.split_exact(df, F.concat_ws(":", "k", "i"))
    assert both.filter("split = 'test'").count() == 2
    # repeats away from the cut do no harm
    some = spark.createDataFrame([(i // 2,) for i in range(40)], "k int")
    assert X.split_exact(some, "k", test=0.2).filter("split = 'test'").count() == 8


def test_assign_ids_and_rank(spark):
    df = spark.createDataFrame([(g, v) for g in "abc" for v in range(5)], "g string, v int").repartition(4)
    ids = sorted((r.id, r.g, r.v) for r in assign_ids(df, ["g", "v"]).collect())
    assert [i for i, _, _ in ids] == list(range(1, 16))
    assert [(g, v) for _, g, v in ids] == [(g, v) for g in "abc" for v in range(5)]
    rk = {(r.g, r.v): r.rank for r in rank_within(df, "g", [F.desc("v")]).collect()}
    assert rk[("b", 4)] == 1 and rk[("b", 0)] == 5
