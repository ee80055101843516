import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from churnforge.operators import encode


def test_te_tiny_by_hand(spark):
    rows = [("a", 1)] + [("b", i % 2) for i in range(20)] + [("c", int(i < 30)) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, y int")
    m = encode.fit_target_encoder(df, ["k"], "y", smoothing=10.0, min_samples_leaf=20.0)
    prior = (1 + 10 + 30) / 121
    got = {r["key"]: r["enc"] for r in m.collect()}
    for key, n, mean in (("a", 1, 1.0), ("b", 20, 0.5), ("c", 100, 0.3)):
        w = 1 / (1 + math.exp(-(n - 20) / 10))
        assert abs(got[key] - (prior * (1 - w) + mean * w)) < 1e-12
    new = spark.createDataFrame([("a",), ("zzz",)], "k string")
    out = [r["k_te"] for r in encode.apply_target_encoding(new, m, ["k"]).collect()]
    assert abs(out[1] - prior) < 1e-12 and abs(out[0] - got["a"]) < 1e-12


def test_leave_fold_out_equals_naive_refit(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": range(600), "k": rng.choice(list("abcdefg"), 600), "y": rng.integers(0, 2, 600),
                        "fold": rng.integers(0, 4, 600)})
    pdf.loc[pdf.k == "g", "fold"] = 2  # a key present in one fold only
    df = spark.createDataFrame(pdf)
    one_pass = encode.fit_fold_target_encoder(df, ["k"], "y", "fold", 4, smoothing=7.0).toPandas()
    for f in range(4):
        naive = encode.fit_target_encoder(df.filter(F.col("fold") != f), ["k"], "y", smoothing=7.0).toPandas()
        prior_f = pdf.loc[pdf.fold != f, "y"].mean()
        got = one_pass[one_pass.fold == f].set_index("key")
        for key in got.index:
            exp = naive.set_index("key")["enc"].get(key, prior_f)
            assert abs(got.loc[key, "enc"] - exp) < 1e-12


def test_quantile_bins_fixtures(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5]], "x double")
    out = encode.apply_quantile_bins(df, encode.fit_quantile_bins(df, "x", 4), "x").collect()
    assert [r["x_bin"] for r in out] == [0, 0, 1, 2, 3]
    sk = spark.createDataFrame([(float(v),) for v in [0] * 8 + [1, 2]], "x double")
    edges = encode.fit_quantile_bins(sk, "x", 4).first()["edges"]
    assert edges == [0.0, 2.0]  # quantiles 0,0,0,0,2: duplicates dropped, one bin left
    const = spark.createDataFrame([(3.0,)] * 5, "x double")
    assert {r["x_bin"] for r in encode.apply_quantile_bins(const, encode.fit_quantile_bins(const, "x", 4), "x").collect()} == {None}


def test_ordinal_one_hot_unknown(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    tr = spark.createDataFrame([("b",), ("a",), ("c",)], "c string")
    sc = spark.createDataFrame([("a",), ("zz",), (None,)], "c string")
    codes = [r["c_ord"] for r in encode.apply_ordinal(sc, encode.fit_ordinal(tr, ["c"]), ["c"]).collect()]
    assert codes == [0, -1, -1]
    model = Pipeline(stages=encode.one_hot_stages(["c"])).fit(tr)
    vecs = [r[0] for r in model.transform(sc).select(vector_to_array("c_ohe")).collect()]
    assert vecs == [[1.0, 0.0, 0.0], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]]


def test_scaler_population_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    z = [r["x"] for r in encode.standard_scale(df, ["x"]).collect()]
    assert abs(sum(z)) < 1e-12 and abs(np.std(z) - 1.0) < 1e-12


def test_ordered_te_uses_only_earlier_rows(spark):
    df = spark.createDataFrame([(i, "k", i % 2) for i in range(50)], "id long, c string, y int")
    out = encode.ordered_target_encoding(df, ["c"], "y", "id", a=1.0).toPandas()
    assert out["enc"].notnull().all() and len(out) == 50
