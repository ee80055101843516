"""Hot keys and lookup strategies: results must not depend on skew or on the join strategy."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from churnforge.operators import encode


def _hot_frame(n=3000, seed=7):
    rng = np.random.default_rng(seed)
    keys = np.where(rng.random(n) < 0.34, "HOT", rng.choice([f"k{i}" for i in range(120)], n))
    return pd.DataFrame({"id": np.arange(n), "c": keys, "y": rng.integers(0, 2, n), "fold": rng.integers(0, 5, n)})


def test_ordered_te_hot_key_matches_brute_force(spark):
    import hashlib
    pdf = _hot_frame()
    out = encode.ordered_target_encoding(spark.createDataFrame(pdf), ["c"], "y", "id", a=1.0, seed=42).toPandas()
    prior = pdf["y"].mean()
    pdf["perm"] = [hashlib.md5(f"{i}|42".encode()).hexdigest() for i in pdf["id"]]
    pdf = pdf.sort_values(["c", "perm", "id"])
    g = pdf.groupby("c")["y"]
    pdf["exp"] = ((g.cumsum() - pdf["y"]) + prior) / (g.cumcount() + 1.0)
    m = out.merge(pdf[["id", "exp"]], on="id")
    assert len(m) == len(pdf) and np.allclose(m["enc"], m["exp"], atol=1e-12)


def test_lookup_literal_and_join_paths_agree(spark):
    pdf = _hot_frame()
    df = spark.createDataFrame(pdf)
    fitted = encode.fit_target_encoder(df, ["c"], "y", smoothing=5.0)
    assert fitted.count() > encode.MAX_LITERAL_ENTRIES  # 121 keys: the join path
    joined = encode.apply_target_encoding(df, fitted, ["c"]).select("id", "c_te").toPandas().set_index("id")
    small = fitted.filter(F.col("key").isin("HOT", "k1", "k2"))  # 3 keys: the literal path
    lit = encode.apply_target_encoding(df, small, ["c"]).select("id", "c", "c_te").toPandas().set_index("id")
    mask = lit["c"].isin(["HOT", "k1", "k2"])
    assert np.allclose(lit.loc[mask, "c_te"], joined.loc[mask[mask].index, "c_te"], atol=1e-12)


def test_fold_encoder_hot_key_one_fold_key(spark):
    pdf = _hot_frame()
    pdf.loc[pdf.c == "k7", "fold"] = 3  # key seen in one fold only -> prior for model 3
    df = spark.createDataFrame(pdf)
    m = encode.fit_fold_target_encoder(df, ["c"], "y", "fold", 5, smoothing=10.0).toPandas()
    row = m[(m.fold == 3) & (m.key == "k7")].iloc[0]
    assert row["n"] == 0 and abs(row["enc"] - row["prior"]) < 1e-15
    hot = m[(m.key == "HOT")].set_index("fold")
    for f in range(5):
        sub = pdf[(pdf.fold != f) & (pdf.c == "HOT")]
        assert hot.loc[f, "n"] == len(sub)


def _paths(df, fitted, cols, value, default):
    """The same lookup by every physical way: literals, broadcast joins, one join in long form, shuffled join."""
    return {"literal": encode.apply_lookup(df, fitted, cols, value, default, "_v", max_literals=10_000),
            "joins": encode.apply_lookup(df, fitted, cols, value, default, "_v", max_literals=0),
            "long": encode.apply_lookup(df, fitted, cols, value, default, "_v", max_literals=0, max_joins=0),
            "shuffled": encode.apply_lookup(df, fitted, cols, value, default, "_v", max_literals=0, max_broadcast_rows=0)}


def test_all_lookup_paths_agree_in_values_and_types(spark):
    pdf = _hot_frame(600)
    pdf["d"] = pdf["c"].str[::-1].where(pdf["id"] % 5 != 0, None)
    pdf["id"] = pdf["id"] // 2                                  # repeated ids
    df = spark.createDataFrame(pdf)
    for n in (1, 65, 500):
        fitted = encode.long_form(df, ["c", "d"]).distinct().orderBy("feature", "key").limit(n).select(
            "feature", "key", F.xxhash64("feature", "key").alias("n"))
        outs = _paths(df, fitted, ["c", "d"], "n", 0)
        want = {(r["feature"], r["key"]): r["n"] for r in fitted.collect()}
        for name, out in outs.items():
            assert dict(out.dtypes)["c_v"] == dict(out.dtypes)["d_v"] == "bigint", name
            rows = out.collect()
            assert len(rows) == len(pdf)
            for r in rows:
                assert r["c_v"] == want.get(("c", r["c"]), 0) and r["d_v"] == want.get(("d", r["d"]), 0), name


def test_null_keys_are_left_out_of_their_own_fold(spark):
    pdf = pd.DataFrame({"id": range(12), "c": [None] * 12, "y": [1, 0] * 6, "fold": [0, 1, 2] * 4})
    df = spark.createDataFrame(pdf, "id long, c string, y int, fold int")
    m = encode.fit_fold_target_encoder(df, ["c"], "y", "fold", 4, smoothing=1.0).orderBy("fold").collect()
    assert [r["n"] for r in m] == [8, 8, 8, 12]                # fold 3 has no rows and keeps its map
    assert m[3]["prior"] == 0.5
    maps = spark.createDataFrame(m, "fold int, feature string, key string, n long, enc double, prior double")
    oof = encode.oof_target_encoding(df, maps, "id", "fold", ["c"])
    assert oof.filter("enc IS NULL").count() == 0
    enc = encode.apply_target_encoding(df, maps, ["c"], fold=0)
    assert {r["c_te"] for r in enc.collect()} == {m[0]["enc"]}


def test_noise_does_not_depend_on_partitions(spark):
    df = spark.range(100).withColumn("e", F.lit(0.0))
    a, b = ({r["id"]: r["e"] for r in encode.add_noise(df.repartition(n), ["e"], 1.0).collect()} for n in (2, 7))
    assert a == b and abs(np.mean(list(a.values()))) < 0.4 and 0.7 < np.std(list(a.values())) < 1.3


def test_group_modes_of_a_hot_group(spark):
    pdf = _hot_frame()
    pdf["g"] = np.where(pdf["id"] % 3 == 0, None, "x")
    got = {r["g"]: r["c_mode"] for r in encode.group_modes(spark.createDataFrame(pdf), "g", ["c"]).collect()}
    assert got == {None: "HOT", "x": "HOT"}
