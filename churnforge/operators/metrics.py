"""Exact ROC-AUC as a distributed aggregate (R1-R3, R5) and average ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnforge.operators.running import prefix_sums


def auc(df: DataFrame, label: str, score: str, group_cols=(), out: str = "auc", counts=None,
        num_bins: int | None = None, weight: str | None = None) -> DataFrame:
    """R1 (no groups), R2 (group by fold), R3 (group by model), R5 (label = split flag).

    Ties count one half. Rows are first reduced to distinct scores (map-side combine), then a
    skew-safe running count of negatives gives AUC = sum(pos * (neg_below + neg/2)) / (P * N).
    ``counts=(pos_col, neg_col)``: the rows are already (score, positives, negatives) counts and
    ``label`` is ignored. ``num_bins``: scores in 0..1 are taken as equal inside 1/num_bins wide bins,
    so that at most that many rows a group are shuffled (approximate; exact without it). ``weight``: a row
    counts as so many rows (null: none), n_pos and n_neg are sums of weights."""
    group_cols = list(group_cols)
    if counts is None:
        y = F.col(label).cast("long")
        base = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
        w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1)
        pos, neg = y * w, (F.lit(1) - y) * w
    else:
        base = df.filter(F.col(score).isNotNull())
        pos, neg = F.col(counts[0]).cast("long"), F.col(counts[1]).cast("long")
    value = F.col(score).cast("double")
    if num_bins:
        value = F.floor(value * num_bins).cast("double")
    dist = base.groupBy(*group_cols, value.alias("_s")).agg(F.sum(pos).alias("_pos"), F.sum(neg).alias("_neg"))
    run = prefix_sums(dist, ["_s"], ["_neg"], group_cols)
    return run.groupBy(*group_cols).agg(
        F.try_divide(F.sum(F.col("_pos") * (F.col("_neg_before") + F.col("_neg") / 2.0)),
                     F.sum("_pos").cast("double") * F.sum("_neg").cast("double")).alias(out),
        F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))


def auc_value(df: DataFrame, label: str, score: str) -> float:
    row = auc(df, label, score).first()
    return float(row["auc"]) if row and row["auc"] is not None else float("nan")


def rank_table(df: DataFrame, score: str, group_cols=()) -> DataFrame:
    """Per distinct score (per group): average-tie rank and rank / n."""
    group_cols = list(group_cols)
    dist = df.filter(F.col(score).isNotNull()).groupBy(*group_cols, score).agg(F.count(F.lit(1)).alias("_c"))
    run = prefix_sums(dist, [score], ["_c"], group_cols, total_suffix="_total").withColumnRenamed("_c_total", "_n")
    rank = F.col("_c_before") + (F.col("_c") + F.lit(1)) / 2.0
    return run.select(*group_cols, score, rank.alias("avg_rank"), (rank / F.col("_n")).alias("rank_pct"))


def average_rank(df: DataFrame, score: str, group_cols=(), out: str = "rank_pct", power: float | None = None) -> DataFrame:
    """Average-tie rank divided by n (scipy rankdata / n); W2 when ``power`` is given.

    The per-score rank table joins back on the score; AQE turns it into a broadcast when it is
    small at run time and splits a hot score's partition when one score value dominates."""
    group_cols = list(group_cols)
    ranks = rank_table(df, score, group_cols)
    val = F.col("rank_pct") if power is None else F.pow(F.col("rank_pct"), F.lit(float(power)))
    ranks = ranks.select(*group_cols, score, val.alias(out))
    return df.join(ranks, group_cols + [score], "left")
