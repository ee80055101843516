"""Early stopping with patience for boosted trees.

Spark's boosters stop on a tolerance only. Here the booster runs for a budget of rounds, the loss of every prefix of
its trees is evaluated on the validation rows (one job for all prefixes), and the rule "stop after ``patience`` rounds
without gain" is read off that curve. Where the curve ends before the rule applies, the budget doubles: rounds depend only
on those before them, so that a longer run begins with the same trees. The model is cut back to its best round."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Boosted:
    model: object                   # PipelineModel, cut back to best_round trees
    losses: list[float]             # loss on the validation rows after rounds 1, 2, ..., rounds_run
    best_round: int
    stopped: bool                   # by patience (else the rounds ran out)

    @property
    def rounds_run(self) -> int:
        return len(self.losses)


def patience_stop(losses, patience: int) -> tuple[int, int, bool]:
    """(best round, last round run, stopped by patience), rounds counted from 1. The best round is the first
    with the smallest loss; the run ends ``patience`` rounds after a best that none of them improved on. NaN is
    no gain."""
    best, best_loss = 0, float("inf")
    for r, loss in enumerate(losses, 1):
        if loss < best_loss:
            best, best_loss = r, loss
        if r - best >= patience:
            return max(best, 1), r, True
    return max(best, 1), len(losses), False


def stop_rounds(losses: DataFrame, patience: int, group_cols=("fold",), round_col: str = "round", loss_col: str = "loss") -> DataFrame:
    """The same rule on stored curves, as a DataFrame: (group..., best_round, rounds_run, best_loss). One curve is
    a few hundred rows at most, a group's window is a curve."""
    order = Window.partitionBy(*group_cols).orderBy(round_col)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    loss = F.nanvl(F.col(loss_col).cast("double"), F.lit(None).cast("double"))
    best = F.min(F.when(loss.isNotNull(), F.struct(loss.alias("l"), F.col(round_col).alias("r")))).over(so_far)
    number = F.row_number().over(order)
    rows = losses.select(*group_cols, F.col(round_col).alias("_r"), loss.alias("_l"), best.alias("_b"), number.alias("_n"))
    at = rows.withColumn("_bn", F.max(F.when(F.col("_b.r") == F.col("_r"), F.col("_n"))).over(
        Window.partitionBy(*group_cols).orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)))
    ended = at.withColumn("_end", F.min(F.when(F.col("_n") - F.coalesce("_bn", F.lit(0)) >= patience, F.col("_n"))).over(
        Window.partitionBy(*group_cols)))
    kept = ended.filter(F.col("_end").isNull() | (F.col("_n") <= F.col("_end")))
    least = F.min(F.when(F.col("_l").isNotNull(), F.struct("_l", "_r")))
    return kept.groupBy(*group_cols).agg(least["_r"].alias("best_round"), F.max("_r").alias("rounds_run"), least["_l"].alias("best_loss"))


def first_rounds(model, rounds: int):
    """A boosted classifier of the first trees of another."""
    from pyspark import SparkContext
    from pyspark.ml.classification import GBTClassificationModel
    sc = SparkContext._active_spark_context
    trees, weights = list(model._java_obj.trees()), list(model.treeWeights)
    if rounds >= len(trees):
        return model
    new = sc._gateway.new_array
    java_trees = new(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    java_weights = new(sc._jvm.double, rounds)
    for i in range(rounds):
        java_trees[i], java_weights[i] = trees[i], float(weights[i])
    cut = GBTClassificationModel(sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        f"{model.uid}_{rounds}", java_trees, java_weights))
    for name in ("featuresCol", "labelCol", "predictionCol", "probabilityCol", "rawPredictionCol"):
        cut._set(**{name: model.getOrDefault(name)})
    return cut


def fit_boosted(train: DataFrame, valid: DataFrame, family: str, label: str, numeric, categorical=(), onehot=(),
                patience: int = 10, max_rounds: int = 200, **params) -> Boosted:
    """Fit on ``train``, stop by the loss on ``valid``. Feature stages are fitted on ``train`` alone; ``params``
    are those of the booster (but for maxIter)."""
    from pyspark.ml import PipelineModel
    from churnforge.operators.models import prepare_features, tree_bins, estimator
    from churnforge.session import cut_lineage
    if family not in ("gbt", "gbt_shallow"):
        raise ValueError("patience needs a boosted family")
    prep, levels = prepare_features(train, numeric, categorical, onehot)
    keep = ["features", label, *([params["weightCol"]] if params.get("weightCol") else [])]
    tr, va = (cut_lineage(prep.transform(d).select(*keep)) for d in (train, valid))
    kw = tree_bins(params, levels)
    budget = min(max_rounds, max(2 * patience, 8))
    while True:
        model = estimator(family, label, **(kw | {"maxIter": budget})).fit(tr)
        losses = [float(x) for x in model.evaluateEachIteration(va)]
        best, run, stopped = patience_stop(losses, patience)
        if stopped or budget >= max_rounds:
            break
        budget = min(max_rounds, 2 * budget)
    return Boosted(PipelineModel(stages=[*prep.stages, first_rounds(model, best)]), losses[:run], best, stopped)
