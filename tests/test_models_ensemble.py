import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from churnforge.operators import cluster, ensemble, folds, metrics, models


def _planted(spark, n=1500, seed=0):
    rng = np.random.default_rng(seed)
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    p = 1 / (1 + np.exp(-(2.5 * x1 - 2.0 * x2)))
    pdf = pd.DataFrame({"id": np.arange(n), "x1": x1, "x2": x2, "noise": rng.normal(size=n),
                        "label": (rng.random(n) < p).astype(int)})
    return spark.createDataFrame(pdf)


def test_crossfit_recovers_planted_signal(spark):
    df = folds.stratified_folds(_planted(spark), "id", "label", k=3)
    oof, test = models.crossfit(df, ["x1", "x2", "noise"], "label", "id", "fold", 3, "logreg",
                                score_rows=df.limit(50), C=1.0)
    assert oof.count() == 1500
    assert metrics.auc_value(oof, "label", "score") > 0.8
    assert test.count() == 50 and test.filter((F.col("score") < 0) | (F.col("score") > 1)).count() == 0


def test_gbt_and_stack(spark):
    df = folds.stratified_folds(_planted(spark, 900, 1), "id", "label", k=3)
    oof, _ = models.multi_crossfit(df, ["x1", "x2"], "label", "id", "fold", 3, ["gbt", "logreg"],
                                   params={"gbt": {"maxIter": 5}})
    board = models.leaderboard(oof).collect()
    assert len(board) == 2 and all(r["auc"] > 0.75 for r in board)
    st, _ = models.stack(oof, None, ["gbt", "logreg"], "label", k=3)
    assert metrics.auc_value(st, "label", "score") > 0.75


def test_adversarial_flags_shift(spark):
    rng = np.random.default_rng(2)
    n = 800
    pdf = pd.DataFrame({"id": np.arange(n), "split": np.where(np.arange(n) % 2 == 0, "train", "score"),
                        "noise": rng.normal(size=n)})
    pdf["shifted"] = rng.normal(size=n) + (pdf["split"] == "score") * 2.0
    a, drift, imps, flagged = models.adversarial_validation(spark.createDataFrame(pdf), ["shifted", "noise"],
                                                            k=3, maxIter=5)
    assert drift and a > 0.8 and flagged[0] == "shifted"


def test_calibrate_and_grid(spark):
    preds = spark.createDataFrame([(i, s) for i, s in enumerate([0.1, 0.2, 0.3, 0.4, 0.5])], "id long, score double")
    out = ensemble.calibrate(preds, 0.25).agg(F.avg("score")).first()[0]
    assert abs(out - 0.25) < 1e-12
    assert len(ensemble.simplex_grid(3, 0.1)) == 66


def test_rank_power_average(spark):
    long = spark.createDataFrame([("a", 1, 0.1), ("a", 2, 0.9), ("b", 1, 0.8), ("b", 2, 0.2)],
                                 "model string, id long, score double")
    got = {r["id"]: r["score"] for r in ensemble.rank_power_average(long, power=1.0).collect()}
    assert got == {1: 0.75, 2: 0.75}


def test_kmeans_distances_argmin(spark):
    rng = np.random.default_rng(3)
    pts = np.vstack([rng.normal(c, 0.1, size=(60, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    df = spark.createDataFrame(pd.DataFrame({"id": range(180), "a": pts[:, 0], "b": pts[:, 1]}))
    out = cluster.kmeans_features(df, df, k=3, cols=["a", "b"], n_init=2).toPandas()
    d = out[[f"kmeans_dist_{j}" for j in range(3)]].to_numpy()
    assert (d.argmin(axis=1).astype(str) == out["kmeans_cluster_id"].to_numpy()).all()
    assert out.groupby("kmeans_cluster_id").size().sort_values().tolist() == [60, 60, 60]


def test_fold_importances_mean_and_sum(spark):
    df = folds.stratified_folds(_planted(spark, 600, 4), "id", "label", k=3)
    _oof, _t, fm = models.crossfit(df, ["x1", "x2", "noise"], "label", "id", "fold", 3, "gbt",
                                   keep_models=True, maxIter=5)
    mean = {r["feature"]: r["importance_pct"] for r in models.fold_importances(spark, fm, ["x1", "x2", "noise"]).collect()}
    tot = {r["feature"]: r["importance_pct"] for r in models.fold_importances(spark, fm, ["x1", "x2", "noise"], "sum").collect()}
    assert abs(sum(mean.values()) - 100.0) < 1e-6 and abs(sum(tot.values()) - 300.0) < 1e-6
    top = models.top_features(models.fold_importances(spark, fm, ["x1", "x2", "noise"]), 1).first()["feature"]
    assert top in ("x1", "x2")


def test_random_search_trials_independent_of_parallelism(spark):
    df = _planted(spark, 400, 5)
    t1, b1 = models.random_search(df, ["x1", "x2"], "label", "id", n_trials=2, max_iter=3, parallelism=1)
    t2, b2 = models.random_search(df, ["x1", "x2"], "label", "id", n_trials=2, max_iter=3, parallelism=2)
    p1 = [r["params"] for r in t1.orderBy("trial").collect()]
    p2 = [r["params"] for r in t2.orderBy("trial").collect()]
    assert p1 == p2 and b1 == b2


def test_fm_and_nb_families(spark):
    df = folds.stratified_folds(_planted(spark, 600, 6), "id", "label", k=3)
    oof, _ = models.multi_crossfit(df, ["x1", "x2"], "label", "id", "fold", 3, ["fm", "nb"],
                                   params={"fm": {"maxIter": 20}})
    board = {r["model"]: r["auc"] for r in models.leaderboard(oof).collect()}
    assert board["fm"] > 0.75 and board["nb"] > 0.6


def test_reference_distribution_features(spark):
    from churnforge.plans.presets import reference_distribution_features
    rng = np.random.default_rng(8)
    n = 300
    pdf = pd.DataFrame({"id": np.arange(n), "tenure": rng.integers(1, 8, n).astype(float),
                        "monthly": rng.normal(100, 10, n), "total": rng.normal(500, 50, n),
                        "priority": rng.choice(["1-URGENT", "2-HIGH"], n), "segment": rng.choice(["A", "B"], n),
                        "flag": rng.choice(["A", "N", "R"], n), "label": rng.integers(0, 2, n)})
    ref = spark.createDataFrame(pdf)
    new = spark.createDataFrame(pdf.head(3).assign(id=[1000, 1001, 1002], segment="UNSEEN"))
    out = reference_distribution_features(new, ref, k=3, n_init=1).toPandas()
    assert (out["ngram_rate"] == 0.0).all()  # n-gram absent from the reference -> 0
    pos = pdf[pdf.label == 1]["total"]
    exp = (pdf.head(3)["total"].to_numpy() - pos.mean()) / (pos.std() + 1e-6)  # pandas std = sample std
    assert np.allclose(out.sort_values("id")["zscore_pos_total"].to_numpy(), exp, atol=1e-9)
    d = out[[f"kmeans_dist_{j}" for j in range(3)]].to_numpy()
    assert (d.argmin(axis=1).astype(str) == out["kmeans_cluster_id"].to_numpy()).all()
