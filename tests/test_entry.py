import importlib


def test_entry_and_registry(spark):
    m = importlib.import_module("__spark_entry__")
    df = m.entry(spark)
    rows = df.collect()
    assert len(rows) == 15
    assert set(df.columns) == {"match_type", "n_words", "matched", "total", "coverage_pct"}
    qs, sql = m.queries(), m.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 40


def test_oracle_sql_plans_in_duckdb():
    import os

    import duckdb
    m = importlib.import_module("__spark_entry__")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split():
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name, sql in m.oracle_sql().items():
        con.execute("EXPLAIN " + sql)   # raises on a broken oracle
