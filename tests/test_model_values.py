"""Patience, row weights, silhouettes, soft memberships, greedy selection and shared statistics."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnforge.operators import boosting, cluster, encode, ensemble, folds, metrics, models
from churnforge.session import scratch_path
from churnforge.sources import tables


def test_patience_rule():
    assert boosting.patience_stop([3.0, 2.0, 2.5, 2.4, 1.0], 2) == (2, 4, True)
    assert boosting.patience_stop([3.0, 2.0, 1.0], 2) == (3, 3, False)
    assert boosting.patience_stop([1.0, 1.0, 1.0, 1.0], 3) == (1, 4, True)           # equal is no gain
    assert boosting.patience_stop([float("nan"), float("nan")], 2) == (1, 2, True)
    assert boosting.patience_stop([], 2) == (1, 0, False)


def test_stored_curves_end_where_the_rule_says(spark):
    rng = random.Random(1)
    curves = {g: [round(rng.random() + 1 / (r + 1), 2) if rng.random() > 0.05 else float("nan") for r in range(rng.randint(1, 40))] for g in range(25)}
    rows = [(g, r, x) for g, c in curves.items() for r, x in enumerate(c, 1)]
    df = spark.createDataFrame(rows, "fold int, round int, loss double")
    for patience in (1, 4):
        got = {r["fold"]: (r["best_round"], r["rounds_run"]) for r in boosting.stop_rounds(df, patience).collect()}
        for g, c in curves.items():
            best, run, _ = boosting.patience_stop(c, patience)
            if any(not math.isnan(x) for x in c[:run]):
                assert got[g] == (best, run)


def noisy(n, seed, flip=0.25):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        x = [rng.gauss(0, 1) for _ in range(4)]
        y = int(x[0] + 0.5 * x[1] > 0)
        rows.append((k, y if rng.random() > flip else 1 - y, *x))
    return rows


NOISY = "id long, label int, a double, b double, c double, d double"


def test_patience_stops_a_planted_overfit(spark):
    train, valid = (spark.createDataFrame(noisy(300, s), NOISY) for s in (1, 2))
    got = boosting.fit_boosted(train, valid, "gbt", "label", ["a", "b", "c", "d"], patience=4, max_rounds=64, stepSize=0.5, maxDepth=5)
    assert got.stopped and got.rounds_run < 64 and got.best_round < got.rounds_run
    assert got.best_round == 1 + int(np.argmin(got.losses)) and got.rounds_run == got.best_round + 4
    assert len(got.model.stages[-1].trees) == got.best_round
    # the model cut back is the model of a fit with so many rounds
    again = models.fit_family(train, "gbt", "label", ["a", "b", "c", "d"], maxIter=got.best_round, stepSize=0.5, maxDepth=5)
    one, two = ({r["id"]: r["score"] for r in tables.positive_probability(m.transform(valid)).collect()} for m in (got.model, again))
    assert all(abs(one[k] - two[k]) < 1e-9 for k in one)
    path = scratch_path(spark, "cut-back")
    tables.save_model(got.model, path)
    back = {r["id"]: r["score"] for r in tables.positive_probability(tables.load_model(path).transform(valid)).collect()}
    assert back == one


def test_crossfit_with_patience_scores_every_row_once(spark):
    tr = folds.stratified_folds(spark.createDataFrame(noisy(400, 3, 0.1), NOISY), "id", "label", k=3)
    oof, _, rounds = models.crossfit(tr, ["a", "b", "c", "d"], "label", "id", "fold", 3, "gbt", patience=2, max_rounds=20, keep_rounds=True, stepSize=0.3)
    assert oof.select("id").distinct().count() == oof.count() == 400
    assert {r["fold"] for r in boosting.stop_rounds(rounds, 2).collect()} == {0, 1, 2}
    assert metrics.auc_value(oof, "label", "score") > 0.8
    with pytest.raises(ValueError, match="boosted"):
        boosting.fit_boosted(tr, tr, "logreg", "label", ["a"])


def weighted(spark, rows, weights):
    df = spark.createDataFrame([(*r, float(w)) for r, w in zip(rows, weights, strict=True)], NOISY + ", w double")
    copies = spark.createDataFrame([r for r, w in zip(rows, weights, strict=True) for _ in range(w)], NOISY)
    return df, copies


def test_a_weight_of_two_is_a_row_twice(spark):
    rows = noisy(300, 4)
    weights = [1 + k % 3 for k in range(300)]
    df, copies = weighted(spark, rows, weights)
    one = models.fit_family(df, "logreg", "label", ["a", "b"], n_rows=sum(weights), weight_col="w", C=1.0, tol=1e-12, maxIter=500)
    two = models.fit_family(copies, "logreg", "label", ["a", "b"], n_rows=sum(weights), C=1.0, tol=1e-12, maxIter=500)
    assert np.allclose(one.stages[-1].coefficients.toArray(), two.stages[-1].coefficients.toArray(), atol=1e-6)
    x, y = (metrics.auc(d, "label", "a", weight=w).first() for d, w in ((df, "w"), (copies, None)))
    assert abs(x["auc"] - y["auc"]) < 1e-12 and (x["n_pos"], x["n_neg"]) == (y["n_pos"], y["n_neg"])
    lr = one.stages[-1]
    for d, w in ((df, "w"), (copies, None)):
        g = models.logreg_gradient(d, ["a", "b"], "label", list(lr.coefficients), lr.intercept, 1.0 / sum(weights), w).collect()
        assert len(g) == 3 and all(abs(r["gradient"]) < 1e-5 for r in g)
    with pytest.raises(ValueError, match="weights"):
        models.fit_family(df, "fm", "label", ["a"], weight_col="w")


def test_balanced_crossfit_moves_the_scores_up(spark):
    rows = [(k, int(k % 10 == 0), *r[2:]) for k, r in enumerate(noisy(600, 5))]
    tr = folds.stratified_folds(spark.createDataFrame(rows, NOISY), "id", "label", k=3)
    mean = lambda **kw: models.crossfit(tr, ["a", "b"], "label", "id", "fold", 3, "logreg", C=1.0, **kw)[0].agg(F.avg("score")).first()[0]
    assert abs(mean() - 0.1) < 0.02 and abs(mean(balanced=True) - 0.5) < 0.05
    one_class = spark.createDataFrame([(1, 1), (2, 1)], "id long, label int")
    assert [r["weight"] for r in encode.class_weight(one_class, "label").collect()] == [1.0, 1.0]


def test_gradient_against_differences(spark):
    rows = noisy(200, 6)
    df = spark.createDataFrame(rows, NOISY)
    x = np.array([r[2:4] for r in rows])
    y = np.array([r[1] for r in rows])
    reg, beta, b0 = 0.3, np.array([0.4, -0.7]), 0.2
    loss = lambda b, c: np.mean(np.log1p(np.exp(-(2 * y - 1) * (c + x @ b)))) + reg / 2 * b @ b
    h = 1e-6
    want = {"intercept": (loss(beta, b0 + h) - loss(beta, b0 - h)) / (2 * h)}
    for i, c in enumerate("ab"):
        step = np.eye(2)[i] * h
        want[c] = (loss(beta + step, b0) - loss(beta - step, b0)) / (2 * h)
    got = {r["term"]: r["gradient"] for r in models.logreg_gradient(df, ["a", "b"], "label", beta, b0, reg).collect()}
    assert all(abs(got[k] - want[k]) < 1e-7 for k in want)


def plain_silhouettes(rows):
    """(cluster, vector) -> silhouettes by all pairs."""
    def dist(a, b):
        na, nb = np.linalg.norm(a), np.linalg.norm(b)
        return 1 - (float(np.dot(a, b) / na / nb) if na and nb else 0.0)
    out = []
    for i, (c, v) in enumerate(rows):
        if c is None or any(x is None or math.isnan(x) for x in v):
            out.append(None)
            continue
        by = {}
        for j, (d, w) in enumerate(rows):
            if j != i and d is not None and all(x is not None and not math.isnan(x) for x in w):
                by.setdefault(d, []).append(dist(v, w))
        b = min((np.mean(x) for d, x in by.items() if d != c), default=None)
        if c not in by or b is None:
            out.append(0.0)
            continue
        a = np.mean(by[c])
        out.append(0.0 if max(a, b) == 0 else (b - a) / max(a, b))
    return out


def test_silhouettes_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    rows = [(int(c), [float(x) for x in rng.normal(size=3) + 3 * np.eye(3)[c]]) for c in rng.integers(0, 3, 60)]
    rows += [(9, [1.0, 1.0, 1.0]), (None, [1.0, 0.0, 0.0]), (1, [0.0, 0.0, 0.0]), (2, [float("nan"), 1.0, 1.0]), (0, [1.0, None, 2.0])]
    df = spark.createDataFrame([(k, c, v) for k, (c, v) in enumerate(rows)], "id long, c int, v array<double>")
    got = {r["id"]: r["silhouette"] for r in cluster.silhouettes(df, "v", "c").collect()}
    for k, want in enumerate(plain_silhouettes(rows)):
        assert (got[k] is None) == (want is None) and (want is None or abs(got[k] - want) < 1e-9)
    one = df.filter("c = 1 and id < 60")
    assert cluster.silhouette(one, "v", "c") == 0.0 and math.isnan(cluster.silhouette(df.limit(0), "v", "c"))


def test_silhouette_equals_the_evaluator(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(int(k % 4), [float(x) for x in rng.normal(size=5) + k % 4]) for k in range(200)], "prediction int, v array<double>")
    vec = cluster.array_to_features(df, "v")
    want = ClusteringEvaluator(featuresCol="features", distanceMeasure="cosine").evaluate(vec)
    assert abs(cluster.silhouette(df, "v", "prediction") - want) < 1e-9


def test_k_is_found(spark):
    rng = np.random.default_rng(9)
    rows = [([float(x) for x in 10 * np.eye(4)[k % 3] + rng.normal(size=4) * 0.3],) for k in range(150)]
    vec = cluster.array_to_features(spark.createDataFrame(rows, "v array<double>"), "v")
    k, scores = cluster.choose_k_by_silhouette(vec, k_max=6, n_init=3)
    assert k == 3 and [s[0] for s in scores] == [2, 3] and scores[-1][1] > 0.9


def test_soft_memberships_add_up(spark):
    df = spark.createDataFrame([(0.0, 0.0), (10.0, 0.0), (1e9, -1e9), (5.0, None)], "x double, y double")
    out = cluster.soft_membership(df, [[0, 0], [10, 0], [5, 0]], cols=["x", "y"], scale=2.0).collect()
    assert all(abs(sum(r[f"soft_{j}"] for j in range(3)) - 1) < 1e-12 for r in out)
    assert out[0]["soft_0"] > 0.9 and out[1]["soft_1"] > 0.9 and out[2]["soft_1"] > 0.999 and out[3]["soft_2"] > 0.9
    w = [math.exp(-d * d / 8) for d in (0, 10, 5)]
    assert abs(out[0]["soft_0"] - w[0] / sum(w)) < 1e-12
    rng = np.random.default_rng(10)
    vec = cluster.array_to_features(spark.createDataFrame([([float(k % 2) * 8 + float(rng.normal())],) for k in range(80)], "v array<double>"), "v")
    probs = cluster.fit_mixture(vec, 2).transform(vec).select("probability").collect()
    assert all(abs(sum(r[0]) - 1) < 1e-9 for r in probs)


def score_rows(spark, n_models, n=400, seed=11):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    rows, table = [], {}
    for m in range(n_models):
        s = 1 / (1 + np.exp(-(rng.normal(size=n) * (1 + m % 4) + y * 1.5)))
        table[f"m{m}"] = s
        rows += [(f"m{m}", k, int(y[k]), float(s[k])) for k in range(n)]
    return spark.createDataFrame(rows, "model string, id long, label int, score double"), table, y


def plain_auc(y, s):
    order = np.argsort(s, kind="stable")
    values, first, counts = np.unique(s[order], return_index=True, return_counts=True)
    rank = np.repeat(first + (counts + 1) / 2, counts)
    r = np.empty(len(s))
    r[order] = rank
    pos = y == 1
    return (r[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_greedy_selection_of_ten_models(spark):
    df, table, y = score_rows(spark, 10)
    names = list(table)
    picks, weights = ensemble.select_models(df, names, rounds=6, num_bins=200)
    got = [(r["model"], r["auc"]) for r in picks.orderBy("round").collect()]
    held = np.zeros(len(y))
    for r, (model, auc) in enumerate(got, 1):
        tries = {m: plain_auc(y, np.floor((held + table[m]) / r * 200)) for m in names}
        best = max(tries.values())
        assert abs(auc - best) < 1e-9 and abs(tries[model] - best) < 1e-9
        held = held + table[model]
    assert abs(sum(weights.values()) - 1) < 1e-12 and set(weights) <= set(names)
    with pytest.raises(ValueError, match="different ids"):
        ensemble.select_models(df.filter("not (model = 'm3' and id = 5)"), names, rounds=1)


def test_one_statistics_table_for_all_smoothings(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(k, int(rng.random() < 0.3), rng.choice("abcdefgh") if rng.random() > 0.1 else None, str(rng.randint(0, 150)), rng.random()) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, label int, c string, d string, x double")
    fit, other = df.filter("id < 400"), df.filter("id >= 400")
    stats, prior = encode.fit_target_stats(fit, ["c", "d"], "label")
    held = encode.apply_target_stats(other, stats, ["c", "d"])
    for smoothing in (1.0, 17.5, 50.0):
        want = encode.apply_target_encoding(other, encode.fit_target_encoder(fit, ["c", "d"], "label", smoothing=smoothing), ["c", "d"])
        want = {r["id"]: (r["c_te"], r["d_te"]) for r in want.collect()}
        got = held.select("id", *[encode.smoothed_stats(c, prior, smoothing).alias(c) for c in ("c", "d")]).collect()
        assert len(got) == 100 and all(abs(a - b) < 1e-12 for r in got for a, b in zip((r["c"], r["d"]), want[r["id"]], strict=True))
    calls = []
    real = encode.fit_target_stats
    monkeypatch.setattr(encode, "fit_target_stats", lambda *a: calls.append(1) or real(*a))
    monkeypatch.setattr(encode, "fit_target_encoder", None)                 # no trial fits an encoder of its own
    trials, best = models.random_search(df, ["x"], "label", "id", n_trials=5, te_cols=["c", "d"], max_iter=2)
    assert trials.count() == 5 and calls == [1] and 1 <= best["te_smoothing"] <= 50


def test_automl_and_the_saved_best_model(spark):
    tr = folds.stratified_folds(spark.createDataFrame(noisy(240, 13, 0.1), NOISY), "id", "label", k=2)
    board, oof, _ = models.automl(tr, ["a", "b"], "label", "id", "fold", 2, families=("logreg", "nb"), params={})
    aucs = {r["model"]: r["auc"] for r in board.collect()}
    assert set(aucs) == {"logreg", "nb", "stack"} and min(aucs.values()) > 0.8
    blended, oof, _ = models.automl(tr, ["a", "b"], "label", "id", "fold", 2, families=("logreg", "nb"), weighted=True)
    scores = {r["model"]: r["auc"] for r in blended.collect()}
    assert set(scores) == {"logreg", "nb", "stack", "weighted"} and scores["weighted"] > max(scores["logreg"], scores["nb"]) - 0.01
    assert oof.groupBy("model").count().select("count").distinct().collect()[0][0] == 240
    best = models.best_model(board, among=["logreg", "nb"])
    assert aucs[best] == max(aucs["logreg"], aucs["nb"])
    model = models.fit_final(tr, ["a", "b"], "label", best)
    path = scratch_path(spark, "best-model")
    tables.save_model(model, path)
    one, two = (sorted(map(tuple, models.score_with(m, tr).collect())) for m in (model, tables.load_model(path)))
    assert one == two and len(one) == 240


def test_positive_class_by_name(spark):
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame([(Vectors.dense([0.2, 0.8]),)], ["probability"])
    pick = lambda labels: tables.positive_probability(df, labels=labels).first()["score"]
    assert pick(None) == pick(["0", "1"]) == pick(["No", "Yes"]) == pick(["x", "y"]) == 0.8
    assert pick(["1", "0"]) == pick(["Yes", "No"]) == pick([1, 0]) == 0.2


@pytest.mark.parametrize("n_cols", [3, 12])
def test_encodings_of_all_folds_by_one_lookup(spark, n_cols, monkeypatch):
    """Both ways give every row what each fold's own lookup gives it; repeated ids and null keys included."""
    from churnforge.session import cut_lineage
    rng = random.Random(14)
    names = [f"c{i}" for i in range(n_cols)]
    rows = [(k // 2, int(rng.random() < 0.4), k % 3, *(rng.choice([None, *map(str, range(3 + 9 * i))]) for i in range(n_cols))) for k in range(240)]
    df = cut_lineage(spark.createDataFrame(rows, "id long, label int, fold int, " + ", ".join(f"{c} string" for c in names)))
    fitted = encode.fit_fold_target_encoder(df.filter("id < 90"), names, "label", "fold", 3, smoothing=5.0, min_samples_leaf=2.0)
    for bound in (encode.MAX_BROADCAST_ROWS, 0):
        monkeypatch.setattr(encode.resolve_lookup, "__defaults__", (None, encode.MAX_LITERAL_ENTRIES, bound))
        out, priors = encode.apply_fold_encodings(df, fitted, names, 3, keep=["id", "label", "fold"])
        out = cut_lineage(out)
        assert out.count() == 240
        for f in range(3):
            want = encode.apply_target_encoding(df, fitted, names, fold=f).select("id", "label", *[f"{c}_te" for c in names]).collect()
            got = encode.fold_encodings(out, names, f, priors).select("id", "label", *[f"{c}_te" for c in names]).collect()
            assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_fold_encodings_shuffle_the_rows_once(spark):
    from churnforge.session import cut_lineage
    names = [f"c{i}" for i in range(12)]
    df = cut_lineage(spark.createDataFrame([(k, k % 2, k % 3, *[str(k % (5 + i)) for i in range(12)]) for k in range(120)],
                                           "id long, label int, fold int, " + ", ".join(f"{c} string" for c in names)))
    fitted = encode.fit_fold_target_encoder(df, names, "label", "fold", 3)
    out, _ = encode.apply_fold_encodings(df, fitted, names, 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
