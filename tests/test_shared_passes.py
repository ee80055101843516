"""Fits that share their passes over the rows take the steps that Spark's own fits take."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.linalg import Vectors

from churnforge.operators import cluster, lloyd


def vectors(spark, n=400, d=3, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + 4 * rng.integers(0, 3, size=(n, 1))
    x[: n // 10] = x[0]                                          # many equal rows
    return spark.createDataFrame([(Vectors.dense(r),) for r in x.tolist()], ["features"])


def test_restarts_share_passes_and_end_as_sparks_fits_do(spark, monkeypatch):
    df, passes, summed = vectors(spark), [], lloyd._summed
    monkeypatch.setattr(lloyd, "_summed", lambda blocks, job, given: passes.append(len(given[0])) or summed(blocks, job, given))
    got = cluster.fit_kmeans_each(df, (2, 5), n_init=3)
    held = cluster.cut_lineage(df.select("features"))
    most = 0
    for k in (2, 5):
        runs = [KMeans(k=k, seed=42 + i, maxIter=300, featuresCol="features").fit(held) for i in range(3)]
        best = min(runs, key=lambda m: m.summary.trainingCost)
        assert np.allclose(got[k].clusterCenters(), best.clusterCenters(), atol=1e-9)
        rows = got[k].transform(held).select("prediction").collect()
        assert rows == best.transform(held).select("prediction").collect()
        most = max(most, *(m.summary.numIter for m in runs))
    assert passes[0] == 6 and len(passes) == most                # six fits, as many passes as the longest takes


def test_many_sums_are_added_by_tasks(spark, monkeypatch):
    blocks = lloyd.pack(vectors(spark))
    start = [[[0.0, 0.0, 0.0], [8.0, 8.0, 8.0]], [[0.0, 1.0, 2.0]]]
    plain = lloyd.lloyd(blocks, start)
    monkeypatch.setattr(lloyd, "MAX_SUMS_BYTES", 1)
    for (cost, centers), (cost2, centers2) in zip(plain, lloyd.lloyd(blocks, start), strict=True):
        assert cost == pytest.approx(cost2) and np.allclose(centers, centers2)


def test_shared_silhouettes_equal_the_operator(spark):
    from pyspark.ml.functions import vector_to_array
    df = cluster.cut_lineage(vectors(spark, 300).union(spark.createDataFrame([(Vectors.dense([0.0, 0.0, 0.0]),)], ["features"])))
    models = cluster.fit_kmeans_each(df, (2, 3, 4), n_init=1)
    got = lloyd.mean_silhouettes(lloyd.pack(df), [m.clusterCenters() for m in models.values()])
    for model, value in zip(models.values(), got, strict=True):
        rows = model.transform(df).select(vector_to_array("features").alias("x"), "prediction")
        assert value == pytest.approx(cluster.silhouette(rows, "x", "prediction"), abs=1e-9)
