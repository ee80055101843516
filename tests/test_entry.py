import duckdb

from tests.conftest import SF001


def test_entry_runs(spark):
    import __spark_entry__ as entry
    rows = entry.entry(spark).collect()
    assert rows and {r["scope"] for r in rows} >= {"oof", "fold_0"}
    assert all(0.0 <= r["auc"] <= 1.0 for r in rows)


def test_registry_consistent():
    import __spark_entry__ as entry
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(s) >= 50


def test_sample_oracles_match(spark):
    import __spark_entry__ as entry
    con = duckdb.connect()
    for t in ("nation", "customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    for name in ("d7_te_fold_map", "w3_stratified_folds", "r1_r3_auc_per_model", "d6_quantile_bins"):
        got = entry.queries()[name](spark, SF001).toPandas()
        exp = con.execute(entry.oracle_sql()[name]).df()
        cols = sorted(got.columns)
        assert cols == sorted(exp.columns)
        g = sorted(map(tuple, got[cols].astype(str).values.tolist()))
        e = sorted(map(tuple, exp[cols].astype(str).values.tolist()))
        assert g == e, name
