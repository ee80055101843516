"""The network's packed training gives the weights of Spark's own fit."""

import numpy as np
from pyspark.ml.linalg import Vectors

from churnforge.operators import models, network


def test_network_ends_as_sparks_fit(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1100, 4))
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=1100) > 0).astype(float)
    df = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x.tolist(), y)], ["features", "label"]).repartition(3)
    df = models.cut_lineage(df)
    for rounds in (3, 20):
        net = models.estimator("mlp", layers=[4, 8, 5, 2], maxIter=rounds, blockSize=100)
        want, got = net.fit(df), network.fit_network(net, df)
        assert np.allclose(got.weights.toArray(), want.weights.toArray(), atol=1e-6)
        a, b = (np.array([r["probability"][1] for r in m.transform(df).collect()]) for m in (want, got))
        assert np.abs(a - b).max() < 1e-6


def test_pipeline_trains_the_network_by_packed_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(network, "fit_network", lambda net, df: seen.append(df.count()) or net.fit(df))
    df = spark.range(60).selectExpr("cast(id % 7 as double) a", "cast(id % 2 as int) label")
    models.fit_family(df, "mlp", "label", ["a"], maxIter=2, layers=[1, 3, 2])
    assert seen == [60]
