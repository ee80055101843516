"""Many encoded columns: counted and looked up batch by batch, with the values of the column-wise path."""

from pyspark.sql import functions as F

from churnforge.operators import encode

COLS = [f"c{i}" for i in range(12)]


def _rows(spark, n=400):
    key = lambda i: F.when(F.col("id") % (i + 5) == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), (F.col("id") % (i + 2)).cast("string")))
    return spark.range(n).select("id", F.when(F.col("id") % 11 != 0, (F.col("id") % 3 == 0).cast("int")).alias("label"),
                                 (F.col("id") % 4).cast("int").alias("fold"), *[key(i).alias(f"c{i}") for i in range(12)])


def _set(df):
    return sorted((tuple(round(v, 12) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_wide_fold_maps_equal_narrow_ones(spark, monkeypatch):
    rows = _rows(spark)
    cols = ["fold", "feature", "key", "n", "enc", "prior"]
    narrow = [r for c in COLS for r in _set(encode.fit_fold_target_encoder(rows, [c], "label", "fold", 4).select(*cols))]
    wide = encode.fit_fold_target_encoder(rows, COLS, "label", "fold", 4).select(*cols)
    assert _set(wide) == sorted(narrow, key=repr)
    monkeypatch.setattr(encode, "COUNTED_CELLS", 10)       # tasks hand their counts on early
    assert _set(encode.fit_fold_target_encoder(rows, COLS, "label", "fold", 4).select(*cols)) == sorted(narrow, key=repr)


def test_wide_lookup_does_not_shuffle_the_rows(spark):
    rows = _rows(spark).unionByName(_rows(spark, 30))       # ids repeat
    fitted = encode.fit_fold_target_encoder(_rows(spark, 60), COLS, "label", "fold", 4)
    wide = encode.apply_target_encoding(rows, fitted, COLS, fold=1, keep=["id"])
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan
    narrow = rows.select("id", *COLS)
    for c in COLS:
        narrow = encode.apply_target_encoding(narrow, fitted, [c], fold=1)
    assert _set(wide) == _set(narrow.select("id", *[f"{c}_te" for c in COLS]))
