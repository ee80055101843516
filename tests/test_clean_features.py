
from churnforge.functions import clean
from churnforge.functions import features as fe


def test_dirty_numbers(spark):
    vals = ["12.5", " 12.5 ", " ", "", "abc", "nan", "12.5d", None, "1.5E3", "-inf"]
    df = spark.createDataFrame([(v,) for v in vals], "x string")
    got = [r[0] for r in df.select(clean.to_number("x")).collect()]
    assert got[:8] == [12.5, 12.5, None, None, None, None, None, None]
    assert got[8] == 1500.0 and got[9] == float("-inf")
    filled = [r[0] for r in df.select(clean.to_number("x", 0.0)).collect()]
    assert filled[:8] == [12.5, 12.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_label_maps(spark):
    vals = ["Yes", "No", "True", "False", "1", "0", "maybe", None]
    df = spark.createDataFrame([(v,) for v in vals], "y string")
    p1 = [r[0] for r in df.select(clean.label_default0("y")).collect()]
    p2 = [r[0] for r in df.select(clean.label_strict("y")).collect()]
    assert p1 == [1, 0, 1, 0, 1, 0, 0, 0]
    assert p2 == [1, 0, None, None, None, None, None, None]


def test_null_cross_rules(spark):
    df = spark.createDataFrame([("a", None), (None, "b"), ("a", "b")], "p string, q string")
    prop = [r[0] for r in df.select(fe.cross("p", "q")).collect()]
    fill = [r[0] for r in df.select(fe.cross("p", "q", sep="_X_", null_rule="fill")).collect()]
    text = [r[0] for r in df.select(fe.cross("p", "q", null_rule="text")).collect()]
    assert prop == ["Missing", "Missing", "a_b"]
    assert fill == ["a_X_Missing", "Missing_X_b", "a_X_b"]
    assert text == ["a_nan", "nan_b", "a_b"]


def test_residual_features_and_clip(spark):
    df = spark.createDataFrame([(100.0, 10.0, 9.0), (0.0, 0.0, 0.0)], "total double, monthly double, tenure double")
    r = df.select(*[v.alias(k) for k, v in fe.residual_features("total", "monthly", "tenure").items()]).collect()
    assert r[0]["charge_residual"] == 10.0 and r[0]["charge_residual_sign"] == 1.0
    assert abs(r[0]["charge_residual_relative"] - 10.0 / 91.0) < 1e-12
    assert r[1]["charge_residual_sign"] == 0.0
    sign_txt = df.select(fe.residual_sign_text("total", "monthly", "tenure")).collect()[0][0]
    assert sign_txt == "1.0"
    c = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "s double").select(clean.clip("s")).collect()
    assert [x[0] for x in c] == [0.0001, 0.5, 0.9999]


def test_count_equal_and_pairs(spark):
    df = spark.createDataFrame([("Yes", "No", None), ("Yes", "Yes", "Yes")], "a string, b string, c string")
    assert [r[0] for r in df.select(fe.count_equal(["a", "b", "c"])).collect()] == [1, 3]
    pairs = fe.all_pair_crosses(["a", "b", "c"])
    assert list(pairs) == ["PAIR_a_x_b", "PAIR_a_x_c", "PAIR_b_x_c"]
    assert len(fe.pair_names([f"c{i}" for i in range(19)])) == 171


def test_schema_helpers_and_origin_union(spark):
    from churnforge.operators.shift import append_with_origin
    from churnforge.spec import categorical_complement, string_columns
    from pyspark.ml.feature import VectorAssembler
    df = spark.createDataFrame([(1, "a", 2.0, "x")], "id long, c string, n double, label string")
    assert clean.drop_if_present(df, ["c", "absent"]).columns == ["id", "n", "label"]
    assert categorical_complement(df, ["n"], exclude=["id", "label"]) == ["c"]
    assert string_columns(df, exclude=["label"]) == ["c"]
    assert clean.feature_dim(VectorAssembler(inputCols=["n", "id"], outputCol="features").transform(df), "features") == 2
    other = spark.createDataFrame([(9, 1.0)], "id long, n double")
    u = append_with_origin(df, other).collect()
    assert sorted(r["origin"] for r in u) == ["original", "synthetic"]
