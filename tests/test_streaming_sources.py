import os
import tempfile

from pyspark.sql import functions as F

from churnforge.operators import encode
from churnforge.sources import tables
from churnforge.streaming import score_stream, stream_table
from tests.conftest import SF001


def test_stream_static_scoring(spark):
    orders = tables.read_table(spark, SF001, "orders", ["o_orderkey", "o_orderpriority", "o_orderstatus"])
    train = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"),
                          (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    te = encode.fit_target_encoder(train, ["priority"], "label")
    stream = stream_table(spark, f"{SF001}/orders*.parquet", orders.schema) \
        .select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))
    q = score_stream(stream, te, ["priority"]).writeStream.format("memory").queryName("scored_orders") \
        .outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM scored_orders")
    assert got.count() == orders.count()
    assert got.filter(F.col("priority_te").isNull()).count() == 0


def test_csv_schema_roundtrip_and_optional_sources(spark):
    base = tempfile.mkdtemp(prefix="cf-src-")
    df = spark.createDataFrame([(1, " 12.5 "), (2, "abc")], "id long, x string")
    tables.write_table(df, os.path.join(base, "t.csv"), fmt="csv")
    back = tables.read_csv_typed(spark, os.path.join(base, "t.csv"), df.schema)
    assert sorted(r["id"] for r in back.collect()) == [1, 2]
    present = tables.existing_sources(spark, [os.path.join(base, "t.csv"), os.path.join(base, "missing")])
    assert present == [os.path.join(base, "t.csv")]
    try:
        tables.require_sources(spark, [os.path.join(base, "missing")])
        raise AssertionError("expected a missing-source error")
    except FileNotFoundError:
        pass
    preds = spark.createDataFrame([(1, 0.2), (2, 0.9)], "id long, score double")
    tables.write_predictions(preds, os.path.join(base, "p"))
    assert tables.read_predictions(spark, os.path.join(base, "p")).count() == 2
    tables.append_run_metrics(spark, os.path.join(base, "metrics"), "r1", {"auc": 0.9})
    assert spark.read.parquet(os.path.join(base, "metrics")).count() == 1
