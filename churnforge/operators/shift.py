"""Pseudo-labels, honest evaluation and train/score drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnforge.functions.clean import confident
from churnforge.operators.metrics import auc


def tag_union(train: DataFrame, score: DataFrame, split_col: str = "split",
              train_tag: str = "train", score_tag: str = "score") -> DataFrame:
    """One frame of both parts, each row tagged with its origin."""
    return train.withColumn(split_col, F.lit(train_tag)).unionByName(
        score.withColumn(split_col, F.lit(score_tag)), allowMissingColumns=True)


def append_with_origin(base: DataFrame, extra: DataFrame, origin_col: str = "origin",
                       base_tag: str = "synthetic", extra_tag: str = "original") -> DataFrame:
    """U4: append another labelled table to the training rows, flagged by origin."""
    return base.withColumn(origin_col, F.lit(base_tag)).unionByName(
        extra.withColumn(origin_col, F.lit(extra_tag)), allowMissingColumns=True)


def pseudo_label(train: DataFrame, score_rows: DataFrame, preds: DataFrame, id_col: str, label: str,
                 high: float = 0.985, low: float = 0.015, score: str = "score",
                 flag: str = "is_pseudo") -> DataFrame:
    """L20 (J1 + P12 + U2 + U3): score rows whose earlier prediction is >= high (label 1) or
    <= low (label 0), both inclusive, appended to the training rows with ``flag`` = true."""
    cand = score_rows.drop(label).join(preds.select(id_col, score), id_col, "inner")
    conf = confident(cand, score, high, low) \
        .withColumn(label, F.when(F.col(score) >= high, F.lit(1)).otherwise(F.lit(0))).drop(score)
    return train.withColumn(flag, F.lit(False)).unionByName(conf.withColumn(flag, F.lit(True)),
                                                            allowMissingColumns=True)


def honest_auc(scored: DataFrame, label: str, score: str, flag: str = "is_pseudo") -> DataFrame:
    """AUC over all rows (as the reference reports it) beside the AUC on original rows only,
    in one grouped pass: each row is tagged with every subset it belongs to."""
    subsets = F.when(F.col(flag), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("original")))
    tagged = scored.select(label, score, F.explode(subsets).alias("subset"))
    return auc(tagged, label, score, ["subset"]).select("subset", "auc")


def drift_flags(importances: DataFrame, threshold_pct: float = 15.0) -> DataFrame:
    """L18 tail: features whose adversarial importance exceeds the threshold (percent)."""
    return importances.filter(F.col("importance_pct") > threshold_pct).orderBy(F.desc("importance_pct"))


def prune_features(df: DataFrame, drifting) -> DataFrame:
    """L19."""
    return df.drop(*list(drifting))
