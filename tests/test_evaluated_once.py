"""Frames that several steps read are evaluated once: an accumulator counts the rows that a source hands out."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnforge.operators import ensemble, models
from churnforge.plans import presets
from tests.conftest import SF001

N = 60


@pytest.fixture
def counted(spark):
    """(long prediction table of models a, b and c, counter of the scores that were computed)."""
    seen = spark.sparkContext.accumulator(0)

    def told(x):
        seen.add(1)
        return x

    score = F.udf(told, T.DoubleType())((F.col("id") * (F.col("m") + 2) % 17) / F.lit(17.0))
    rows = spark.range(N).crossJoin(spark.range(3).withColumnRenamed("id", "m"))
    return rows.select(F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("m") + 1).cast("int")).alias("model"), "id",
                       (F.col("id") % 2).cast("int").alias("label"), score.alias("score")), seen


def test_stack_scores_once(counted):
    oof, seen = counted
    out, test = models.stack(oof, oof.drop("label"), ["a", "b", "c"], "label", k=2)
    assert out.count() == N and seen.value == 3 * N
    assert test.count() == N


def test_model_frame_reads_the_tables_once(spark):
    """What folds, statistics, train and score rows read holds no join or table any more."""
    plan = presets.model_frame(spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "parquet" not in plan and "LogicalRDD" in plan


def test_weight_search_scores_once(counted):
    oof, seen = counted
    weights, best = ensemble.search_blend_weights(oof, ["a", "b", "c"], step=0.5, refine_step=0.25)
    assert sum(weights.values()) == pytest.approx(1.0) and 0 <= best <= 1 and seen.value == 3 * N


def test_summed_tables_come_from_one_pass(spark):
    from __spark_entry__ import queries
    plan = queries()["j2_sum_tables"](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "parquet" not in plan
