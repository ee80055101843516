"""Alignment and lookups (J1-J4). The reference aligns tables by row position; here every
alignment is an equi-join on the id, with an explicit coverage check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def align_predictions(rows: DataFrame, preds: DataFrame, id_col: str = "id") -> DataFrame:
    """Attach an earlier prediction table to its rows by id (inner)."""
    return rows.join(preds, id_col, "inner")


def sum_tables(tables: dict[str, DataFrame], id_col: str = "id", score: str = "score") -> DataFrame:
    """Per-id sum of several prediction tables (plus how many tables had the id)."""
    long = reduce(DataFrame.unionByName, [t.select(id_col, F.col(score).alias("_s")) for t in tables.values()])
    return long.groupBy(id_col).agg(F.sum("_s").alias(score), F.count(F.lit(1)).alias("n_tables"))


def id_coverage(left: DataFrame, right: DataFrame, id_col: str = "id") -> DataFrame:
    """One row (left_only, right_only, both) from one full outer join on distinct ids."""
    lft = left.select(id_col).distinct().withColumn("_l", F.lit(1))
    rgt = right.select(id_col).distinct().withColumn("_r", F.lit(1))
    j = lft.join(rgt, id_col, "full_outer")
    return j.agg(F.count_if(F.col("_r").isNull()).alias("left_only"),
                 F.count_if(F.col("_l").isNull()).alias("right_only"),
                 F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("both"))


def require_same_ids(left: DataFrame, right: DataFrame, id_col: str = "id") -> None:
    """J3 as a guard: stop when either table has an id the other lacks."""
    row = id_coverage(left, right, id_col).first()
    if row["left_only"] or row["right_only"]:
        raise ValueError(f"id sets differ: {row['left_only']} only left, {row['right_only']} only right")
