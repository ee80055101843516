"""Scorers in a folder, imputers, sketches, partitioned tables, null scores and ids."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnforge.functions import clean
from churnforge.operators import encode, ensemble, folds, models, scorer, sketches
from churnforge.session import scratch_path
from churnforge.sources import tables


def raw_rows(n=400, seed=1):
    """(id, label, tenure text, fee text, plan, city): dirty numbers, null and rare categories."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        tenure, fee = rng.randint(0, 70), round(rng.uniform(10, 110), 2)
        label = int(rng.random() < 1 / (1 + math.exp(0.06 * tenure - 0.03 * fee)))
        text = {3: " ", 5: "abc", 7: "nan", 11: None}.get(k % 13, str(tenure))
        out.append((k, label, text, f" {fee} " if k % 9 else "12.5d", rng.choice(["a", "b", "c", None]), rng.choice("klmnopq") if k % 50 else f"rare{k}"))
    return out


SCHEMA = "id long, label int, tenure_txt string, fee_txt string, plan string, city string"
STEPS = [{"op": "numbers", "columns": {"tenure": "tenure_txt", "fee": "fee_txt"}, "fill": None},
         {"op": "categories", "columns": ["plan", "city"]}, {"op": "medians", "columns": ["tenure", "fee"]},
         {"op": "bins", "columns": {"tenure": 4}}, {"op": "crosses", "pairs": [["plan", "tenure_bin"]]},
         {"op": "scale", "columns": ["tenure", "fee"]}, {"op": "ordinal", "columns": ["plan"]}, {"op": "counts", "columns": ["city"]},
         {"op": "target", "columns": ["plan", "city"], "smoothing": 10.0}, {"op": "ordered", "columns": ["plan_X_tenure_bin"]}]
FEATURES = ["tenure", "fee", "tenure_is_null", "fee_is_null", "plan_ord", "city_freq", "plan_te", "city_te", "plan_X_tenure_bin_cbe"]


@pytest.mark.parametrize("family", ["gbt", "logreg"])
def test_scorer_reads_back_equal(spark, family):
    train = spark.createDataFrame(raw_rows(), SCHEMA)
    fresh = spark.createDataFrame([r[:1] + r[2:] for r in raw_rows(60, seed=2)] + [(900, None, None, None, None), (901, "1e3", "-4", "never seen", ""), (None, "5", "6", "a", "k")],
                                  "id long, tenure_txt string, fee_txt string, plan string, city string")
    fitted = scorer.fit_scorer(train, STEPS, "label", family=family, features=FEATURES, **({"maxIter": 5} if family == "gbt" else {}))
    path = scratch_path(spark, f"scorer-{family}")
    scorer.save_scorer(fitted, path)
    loaded = scorer.load_scorer(spark, path)
    key = lambda r: (r[0] is None, r[0] or 0)
    here, there = (sorted(map(tuple, s.score(fresh).collect()), key=key) for s in (fitted, loaded))
    assert here == there and len(here) == 63 and all(0 <= s <= 1 for _, s in here)
    # columns in another order, and more of them, do not matter
    mixed = fresh.select(F.lit(1).alias("features_x"), *reversed(fresh.columns))
    assert sorted(map(tuple, loaded.score(mixed).collect()), key=key) == here
    with pytest.raises(ValueError, match="city"):
        loaded.score(fresh.drop("city"))


def test_scorer_is_whole_only_with_its_manifest(spark):
    train = spark.createDataFrame(raw_rows(80), SCHEMA)
    fitted = scorer.fit_scorer(train, STEPS[:3], "label", family=None)
    path = scratch_path(spark, "scorer-part")
    scorer.save_scorer(fitted, path)
    with pytest.raises(ValueError, match="no model"):
        scorer.load_scorer(spark, path).score(train)
    tables.delete_path(spark, f"{path}/manifest")
    with pytest.raises(FileNotFoundError):
        scorer.load_scorer(spark, path)
    with pytest.raises(ValueError, match="unknown"):
        scorer.fit_scorer(train, [{"op": "magic"}], "label", family=None)


def test_training_rows_of_ordered_steps_see_only_rows_before_them(spark):
    train = spark.createDataFrame(raw_rows(200), SCHEMA)
    steps = [STEPS[1], {"op": "ordered", "columns": ["plan"]}]
    plain = scorer.fit_scorer(train, steps, "label", family=None)
    full = {r["plan"]: r["plan_cbe"] for r in plain.features(train).collect()}
    seen = encode.ordered_encoding_wide(clean.clean_frame(train, categorical=["plan"]), ["plan"], "label", "id").collect()
    assert len(full) == 4 and len({r["plan_cbe"] for r in seen}) > 20


def test_medians_of_all_folds_equal_refits(spark):
    rng = np.random.default_rng(3)
    rows = [(k, k % 4, None if k % 7 == 0 else float(rng.integers(0, 20)), float("nan") if k % 5 == 0 else float(rng.normal()), None) for k in range(203)]
    df = spark.createDataFrame(rows, "id long, fold int, a double, b double, empty double")
    got = {(r["fold"], r["feature"]): (r["median"], r["n"], r["n_null"]) for r in encode.fit_median_imputer(df, ["a", "b", "empty"], "fold", 4).collect()}
    for f in range(4):
        part = [r for r in rows if r[1] != f]
        for at, c in ((2, "a"), (3, "b")):
            there = [r[at] for r in part if r[at] is not None and not math.isnan(r[at])]
            median, n, n_null = got[(f, c)]
            assert abs(median - np.median(there)) < 1e-12 and n == len(part) and n_null == len(part) - len(there)
        assert got[(f, "empty")] == (None, len(part), len(part))
    out = encode.apply_median_imputer(df, encode.fit_median_imputer(df, ["a", "empty"]), ["a", "empty"]).collect()
    whole = np.median([r[2] for r in rows if r[2] is not None])
    assert all(r["a"] == (whole if r["id"] % 7 == 0 else rows[r["id"]][2]) and r["a_is_null"] == float(r["id"] % 7 == 0) for r in out)
    assert all(r["empty"] == 0.0 and r["empty_is_null"] == 1.0 for r in out)


def test_trees_see_nulls_through_the_indicator(spark):
    rng = random.Random(4)
    rows = []
    for k in range(600):
        missing = rng.random() < 0.4
        rows.append((k, int(rng.random() < (0.9 if missing else 0.1)), None if missing else rng.random()))
    tr = folds.stratified_folds(spark.createDataFrame(rows, "id long, label int, x double"), "id", "label", k=3)
    oof, _ = models.crossfit(tr, [], "label", "id", "fold", 3, "gbt_shallow", impute_cols=["x"], maxIter=4)
    from churnforge.operators.metrics import auc_value
    assert oof.count() == 600 and auc_value(oof, "label", "score") > 0.85


def test_sketches_of_batches_stay_in_bound(spark):
    rng = np.random.default_rng(5)
    values = [float(x) for x in np.concatenate([rng.normal(size=30_000), np.full(10_000, 0.25)])]
    df = spark.createDataFrame([(k, v, None if k % 2 else v * v, float("nan")) for k, v in enumerate(values)], "k long, x double, y double, none double")
    parts = []
    for b in range(7):
        path = scratch_path(spark, f"sketch-{b}")
        tables.save_fitted(sketches.fit_sketches(df.filter(F.col("k") % 7 == b), ["x", "y", "none"], k=200), path)
        parts.append(tables.load_fitted(spark, path))
    merged = sketches.merge_sketches(parts, k=200)
    assert {r["feature"]: r["n"] for r in merged.collect()} == {"x": 40_000, "y": 20_000}
    q = sketches.sketch_quantiles(merged, [0.0, 0.1, 0.5, 0.9, 1.0])
    for r in sketches.true_ranks(df, q, ["x", "y"]).collect():
        assert r["below"] - sketches.rank_error(200) <= r["p"] <= r["upto"] + sketches.rank_error(200)
    edges = {r["feature"]: r["edges"] for r in sketches.sketch_bins(merged, {"x": 4}).collect()}["x"]
    assert edges[0] == min(values) and edges[-1] == max(values) and edges == sorted(set(edges))
    binned = encode.apply_quantile_bins_multi(df, sketches.sketch_bins(merged, {"x": 4}), ["x"])
    assert binned.filter("x_bin is null").count() == 0
    grouped = sketches.fit_sketches(df.withColumn("g", F.col("k") % 2), ["x"], ["g"])
    assert grouped.count() == 2 and sketches.rank_error(800) < 0.0035


def test_partitions_are_replaced_alone_and_read_alone(spark, tmp_path):
    path = str(tmp_path / "blends")
    a = spark.createDataFrame([(k, k / 100) for k in range(100)], "id long, score double")
    b = a.withColumn("score", 1 - F.col("score"))
    tables.write_partitions(ensemble.fixed_blends(a, b, [(0.95, 0.05), (0.8, 0.2)]), path, ["variant"])
    files = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "blends" / "variant=95_05").glob("*.parquet")}
    tables.write_partitions(ensemble.fixed_blends(b, a, [(0.8, 0.2)]), path, ["variant"])
    assert files == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "blends" / "variant=95_05").glob("*.parquet")}
    back = tables.read_partitions(spark, path, variant="80_20")
    assert back.count() == 100 and abs(back.filter("id = 0").first()["score"] - 0.8) < 1e-12
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(variant" in plan
    assert tables.read_partitions(spark, path, variant=["80_20", "95_05"]).count() == 200


def test_no_score_stays_no_score(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (3, float("nan")), (4, 2.0), (5, -1.0)], "id long, score double")
    got = {r["id"]: r["s"] for r in df.select("id", clean.clip("score").alias("s")).collect()}
    assert got == {1: 0.5, 2: None, 3: None, 4: 0.9999, 5: 0.0001}
    even = spark.createDataFrame([(1, 0.2), (2, None), (3, float("nan")), (4, 0.6)], "id long, score double")
    got = {r["id"]: r["score"] for r in ensemble.calibrate(even, 0.2).collect()}
    assert got[2] is None and got[3] is None and abs(got[1] - 0.1) < 1e-12 and abs(got[4] - 0.3) < 1e-12
    assert all(r["score"] is None for r in ensemble.calibrate(even.filter("id = 2"), 0.2).collect())


def test_rows_without_an_id_keep_their_encodings(spark):
    rows = [(None, "a", 1), (None, "a", 0), (1, "a", 1), (1, "b", 0), (2, "b", 1)]
    df = spark.createDataFrame(rows, "id long, c string, label int")
    wide = encode.ordered_encoding_wide(df, ["c"], "label", "id")
    assert sorted(((r["id"], r["c"], r["label"]) for r in wide.collect()), key=str) == sorted(rows, key=str)
    assert all(r["c_cbe"] is not None for r in wide.collect())
    noisy = encode.add_noise(df.withColumn("x", F.lit(1.0)), ["x"], 0.1)
    assert noisy.filter("x is null").count() == 0 and noisy.filter("id is null").select("x").distinct().count() == 1


def test_simplex_points_around_a_centre():
    for n, step, centre, reach in ((3, 0.1, [0.3, 0.3, 0.4], 0.2), (4, 0.05, [0.0, 0.9, 0.1, 0.0], 0.1), (2, 0.25, [1.0, 0.0], 0.5)):
        want = [w for w in ensemble.simplex_grid(n, step) if all(abs(a - b) <= reach + 1e-9 for a, b in zip(w, centre, strict=True))]
        assert ensemble.simplex_grid(n, step, centre, reach) == want and want
    assert 0 < len(ensemble.simplex_grid(8, 0.02, [1.0] + [0.0] * 7, 0.04)) < 500


def test_hash_folds_cover_every_row(spark):
    df = spark.range(2_000).select(F.col("id"), (F.col("id") % 2).cast("int").alias("label"))
    out = folds.stratified_folds(df, "id", "label", k=5, exact=False)
    sizes = {r["fold"]: r["count"] for r in out.groupBy("fold").count().collect()}
    assert sorted(sizes) == list(range(5)) and sum(sizes.values()) == 2_000 and min(sizes.values()) > 300
    assert out.collect() == folds.stratified_folds(df, "id", "label", k=5, exact=False).collect()
