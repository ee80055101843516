"""Fold assignment and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnforge.operators.running import row_numbers


def shuffle_key(id_col: str, seed: int = 42) -> Column:
    """A stable pseudo-random order: md5 of 'id|seed' (same value in any SQL engine with md5)."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))


def stratified_folds(df: DataFrame, id_col: str, label: str, k: int = 10, seed: int = 42,
                     out: str = "fold", exact: bool = True) -> DataFrame:
    """Each row in exactly one of k folds; within a class, fold sizes differ by at most 1.

    exact=True ranks the (id, label) pairs within their class in shuffled order (skew-safe running
    count over those two columns only), deals them out round-robin and joins the fold back; rows that
    repeat an id and label share a fold. exact=False is the one-pass hash form
    pmod(xxhash64(id, seed), k) (balanced only in expectation)."""
    if not exact:
        return df.withColumn(out, F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(k)).cast("int"))
    pairs = df.select(F.col(id_col).alias("_fold_id"), F.col(label).alias("_fold_label")).distinct()
    keyed = pairs.withColumn("_fold_order", shuffle_key("_fold_id", seed))
    ranked = row_numbers(keyed, ["_fold_order", "_fold_id"], ["_fold_label"], out="_fold_rank")
    dealt = ranked.select("_fold_id", "_fold_label", (F.col("_fold_rank") % k).cast("int").alias("_fold_new"))
    same = F.col(id_col).eqNullSafe(F.col("_fold_id")) & F.col(label).eqNullSafe(F.col("_fold_label"))
    return df.drop(out).join(dealt, same).drop("_fold_id", "_fold_label").withColumnRenamed("_fold_new", out)


def holdout(df: DataFrame, id_col: str, label: str, valid_share_folds: int = 5, seed: int = 42,
            out: str = "holdout") -> DataFrame:
    """M1: stratified 80/20 split = fold 0 of a 5-fold assignment is the validation part."""
    tagged = stratified_folds(df, id_col, label, k=valid_share_folds, seed=seed, out="_ho_fold")
    return tagged.withColumn(out, F.when(F.col("_ho_fold") == 0, F.lit("valid")).otherwise(F.lit("fit"))) \
                 .drop("_ho_fold")


def sample_rows(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """M2: n rows without replacement (all, if there are fewer), reproducible: the first n in a hashed order.

    The ids get a skew-safe running row number over that order, whatever n is, and the n chosen ids pick
    their rows; rows that repeat an id come together, as one."""
    ids = df.select(F.col(id_col).alias("_sample_id")).distinct().withColumn("_sample_order", shuffle_key("_sample_id", seed))
    chosen = row_numbers(ids, ["_sample_order", "_sample_id"], out="_sample_idx").filter(F.col("_sample_idx") < n)
    return df.join(chosen.select("_sample_id"), F.col(id_col).eqNullSafe(F.col("_sample_id")), "left_semi")
