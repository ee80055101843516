"""Rules that must hold at any size: no overflow, no lost rows, nothing left cached, shared folders."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from churnforge import session
from churnforge.operators import cluster, encode, ensemble, folds, metrics, models, quantiles


def test_auc_of_billions_of_rows(spark):
    n = 4_000_000_000
    cells = spark.createDataFrame([(0.1, 0, n), (0.9, n, 0)], "s double, p long, n long")
    row = metrics.auc(cells, "p", "s", counts=("p", "n")).first()
    assert row["auc"] == 1.0 and row["n_pos"] == row["n_neg"] == n


def test_binned_auc_is_close_to_exact(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 5_000)
    pdf = pd.DataFrame({"y": y, "s": np.clip(0.3 * y + rng.random(5_000) * 0.7, 0, 0.999)})
    df = spark.createDataFrame(pdf)
    exact, binned = (metrics.auc(df, "y", "s", num_bins=b).first()["auc"] for b in (None, 200))
    assert abs(exact - binned) < 0.005


def test_nothing_stays_cached(spark):
    df = spark.range(500).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") * 7 % 31 / 31).alias("s"),
                                 (F.col("id") % 70).cast("string").alias("c"))
    f = folds.stratified_folds(df, "id", "y", k=3)
    metrics.average_rank(df, "s").count()
    metrics.auc(df, "y", "s").collect()
    quantiles.exact_quantiles(df, "s", [0.5]).collect()
    m = encode.fit_fold_target_encoder(f, ["c"], "y", "fold", 3)
    encode.apply_target_encoding(f, m, ["c"], fold=0).count()
    encode.ordered_target_encoding(df, ["c"], "y", "id").count()
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_checkpoint_folder_is_required_off_local_mode():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(Conf)

    class Session:
        sparkContext, conf = Context, Conf()

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session)


def test_combiners_refuse_or_report_uneven_ids(spark):
    long = spark.createDataFrame([("a", 1, 0.8), ("b", 1, 0.4), ("a", 2, 0.8)], "model string, id long, score double")
    with pytest.raises(ValueError):
        ensemble.weighted_blend(long, {"a": 0.5, "b": 0.5})
    got = {r["id"]: (r["score"], r["n_models"]) for r in ensemble.weighted_blend(long, {"a": 0.5, "b": 0.5}, uneven="report").collect()}
    assert got[1] == (pytest.approx(0.6), 2) and got[2] == (None, 1)
    a, b = (long.filter(F.col("model") == m) for m in "ab")
    with pytest.raises(ValueError):
        ensemble.fixed_blends(a, b, [(0.5, 0.5)])
    assert ensemble.fixed_blends(a, b, [(0.5, 0.5)], uneven="report").filter("score IS NULL").count() == 1
    with pytest.raises(ValueError):
        ensemble.blend_grid_auc(long.withColumn("label", F.lit(1)), ["a", "b"], [(1.0, 0.0)])


def test_simplex_grid_lists_only_the_simplex():
    assert ensemble.simplex_grid(2, 0.5) == [(0.0, 1.0), (0.5, 0.5), (1.0, 0.0)]
    assert len(ensemble.simplex_grid(5, 0.05)) == 10_626


def test_samples_of_any_size_and_repeated_ids(spark):
    df = spark.range(50).select((F.col("id") % 40).alias("id"))
    for n in (0, 1, 13, 100):
        ids = [r["id"] for r in folds.sample_rows(df, "id", n).collect()]
        assert len(set(ids)) == min(n, 40)
    f = folds.stratified_folds(df.withColumn("y", F.col("id") % 2), "id", "y", k=5)
    assert f.count() == 50 and f.groupBy("id").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0


def _labelled(spark, n=400):
    rng = np.random.default_rng(3)
    c = rng.integers(0, 90, n)
    pdf = pd.DataFrame({"id": np.arange(n), "x": rng.normal(size=n), "c": [f"k{v}" for v in c],
                        "label": ((c % 3 == 0) | (rng.random(n) < 0.1)).astype(int)})
    return folds.stratified_folds(spark.createDataFrame(pdf), "id", "label", k=3)


def test_native_categories_beyond_64_levels_and_ordered_encodings(spark):
    df = _labelled(spark)
    unseen = df.limit(5).withColumn("c", F.lit("never seen"))
    native, test = models.crossfit(df, ["x"], "label", "id", "fold", 3, "gbt", score_rows=unseen, categorical=["c"], maxIter=5)
    ordered, _ = models.crossfit(df, ["x"], "label", "id", "fold", 3, "gbt", ordered_cols=["c"], maxIter=5)
    for oof in (native, ordered):
        assert oof.count() == oof.select("id").distinct().count() == 400
        assert metrics.auc_value(oof, "label", "score") > 0.7
    assert test.count() == 5


def test_one_hot_scaled_network_and_linear_model(spark):
    df = _labelled(spark).withColumn("x", F.col("x") * 1000)
    for family, options in (("mlp", {"maxIter": 20, "onehot": ["c"]}), ("logreg", {"C": 1.0, "onehot": ["c"]})):
        oof, _ = models.crossfit(df, ["x"], "label", "id", "fold", 3, family, scale=True, **options)
        checks = models.oof_checks(oof).collect()
        assert sum(r["n_in_range"] for r in checks) == 400 and metrics.auc_value(oof, "label", "score") > 0.6


def test_best_model_and_drift_summary(spark):
    board = spark.createDataFrame([("stack", 0.9), ("gbt", 0.8), ("rf", 0.8)], "model string, auc double")
    assert models.best_model(board) == "stack" and models.best_model(board, among=["rf", "gbt"]) == "gbt"
    df = spark.range(300).select("id", F.when(F.col("id") % 2 == 0, "train").otherwise("score").alias("split"),
                                 ((F.col("id") % 2) * 3 + F.col("id") % 7 / 7).alias("moved"), (F.col("id") % 5).cast("double").alias("still"))
    row = models.drift_summary(df, ["moved", "still"], k=3, maxIter=3).collect()
    assert len(row) == 1 and row[0]["drifted"] and row[0]["top_features"][0] == "moved" and row[0]["flagged"] == ["moved"]


def test_clusters_with_nulls_and_the_whole_chain(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": range(240), "a": np.r_[rng.normal(0, .2, 120), rng.normal(9, .2, 120)], "b": rng.normal(0, .2, 240),
                        "s": ["u"] * 120 + ["v"] * 120, "label": [0] * 100 + [1] * 140, "split": ["train", "score"] * 120})
    pdf.loc[5, "b"] = None
    df = spark.createDataFrame(pdf)
    out = cluster.kmeans_features(df, df, k=2, cols=["a", "b"], n_init=2)
    assert out.count() == 240 and out.filter("kmeans_cluster_id IS NULL").count() == 0
    tr, sc = df.filter("split = 'train'"), df.filter("split = 'score'")
    k, profile, assigned, scored = cluster.cluster_then_rate(tr, sc, ["a", "b"], ["s"], "label", k_max=4, n_init=2)
    rows = {r["cluster"]: r for r in profile.collect()}
    assert k == len(rows) == 2
    plain = assigned.toPandas().groupby("cluster")
    for c, g in plain:
        assert rows[c]["size"] == len(g) and rows[c]["label_rate"] == pytest.approx(g["label"].mean())
        assert rows[c]["s_mode"] == g["s"].mode()[0] and rows[c]["a_mean"] == pytest.approx(g["a"].mean())
    assert scored.count() == 120
    for r in scored.collect():
        assert r["score"] == pytest.approx(plain.get_group(r["cluster"])["label"].mean())
