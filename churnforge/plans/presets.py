"""End-to-end presets assembled from the operators.

flagship: order frame -> P5/P6 cleaning -> E1-E6 features -> D2 scaling -> W3 folds ->
leave-fold-out target encoding (one pass for all folds) -> cross-fitted logistic regression ->
exact OOF AUC per fold and overall (R1, R2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnforge.functions import clean
from churnforge.functions import features as fe
from churnforge.operators import encode, folds, metrics, models
from churnforge.plans import frames
from churnforge.session import cut_lineage

CATS = ["priority", "segment", "nation", "flag"]
BASE_NUMS = ["tenure", "monthly", "total", "acctbal"]
RESIDUALS = ["charge_residual", "charge_residual_sign", "charge_residual_relative", "monthly_over_total",
             "tenure_over_monthly"]


def model_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned, featured and scaled order frame (train and score rows). The joins and line aggregates run once: the
    statistics, the folds, the train and the score rows read one checkpoint."""
    f = clean.clean_frame(frames.order_frame(spark, sf_dir), categorical=CATS)
    f = f.withColumns(fe.residual_features("total", "monthly", "tenure"))
    f = cut_lineage(f.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in RESIDUALS}))
    nums = BASE_NUMS + RESIDUALS
    return encode.standard_scale(f, nums, fit_df=f.filter(F.col("split") == "train"))


def folded_train(spark: SparkSession, sf_dir: str, k: int = 5) -> tuple[DataFrame, DataFrame]:
    mf = model_frame(spark, sf_dir)
    tr = folds.stratified_folds(mf.filter(F.col("split") == "train"), "id", "label", k=k)
    return cut_lineage(tr), mf.filter(F.col("split") == "score")


def crossfit_oof(spark: SparkSession, sf_dir: str, family: str = "logreg", k: int = 5, **params):
    tr, sc = folded_train(spark, sf_dir, k)
    te_map = encode.fit_fold_target_encoder(tr, CATS, "label", "fold", k, smoothing=20.0)
    return models.crossfit(tr, BASE_NUMS + RESIDUALS, "label", "id", "fold", k, family, score_rows=sc,
                           te_cols=CATS, te_map=te_map, **params)


def flagship(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    oof, _test = crossfit_oof(spark, sf_dir, "logreg", k, C=1.0)
    oof = cut_lineage(oof)
    per_fold = metrics.auc(oof, "label", "score", ["fold"]).select(
        F.concat(F.lit("fold_"), F.col("fold").cast("string")).alias("scope"), "auc", "n_pos", "n_neg")
    overall = metrics.auc(oof, "label", "score").select(F.lit("oof").alias("scope"), "auc", "n_pos", "n_neg")
    return overall.unionByName(per_fold)


def pair_logreg_oof(spark: SparkSession, sf_dir: str, k: int = 3, C: float = 0.1):
    """v20 pattern: quantile bins (fit on train + score, as the reference) -> all pair crosses of the
    categories and bins -> leave-fold-out target encoding of every pair -> cross-fitted logistic
    regression with C on the pair encodings (L6)."""
    bins = {"tenure": 15, "monthly": 20, "total": 20}
    f = frames.order_frame(spark, sf_dir)
    binned = encode.apply_quantile_bins_multi(f, encode.fit_quantile_bins_multi(f, bins), list(bins))
    src = CATS + [f"{c}_bin" for c in bins]
    filled = clean.clean_frame(binned.select("id", "label", "split", *src), categorical=src)
    pairs = fe.all_pair_crosses(src, sep="_X_", null_rule="fill")
    wide = filled.select("id", "label", "split", *[v.alias(n) for n, v in pairs.items()])
    tr = folds.stratified_folds(wide.filter(F.col("split") == "train"), "id", "label", k=k)
    te_map = encode.fit_fold_target_encoder(tr, list(pairs), "label", "fold", k, smoothing=20.0)
    return models.crossfit(tr, [], "label", "id", "fold", k, "logreg", score_rows=wide.filter(F.col("split") == "score"),
                           te_cols=list(pairs), te_map=te_map, model_name="pair_logreg", scale=True, C=C)


def reference_distribution_features(df: DataFrame, ref: DataFrame, label: str = "label",
                                    nums=("tenure", "monthly", "total"), k: int = 8, n_init: int = 10) -> DataFrame:
    """Reference-distribution feature build against a reference population ``ref``:
    E7 surcharge, E14/E15 class z-scores and quartile distances, K4 k-means fitted once on the
    (unscaled) reference, E12 + D11 n-gram churn rate from the reference (unseen -> 0), E13 count."""
    from churnforge.operators.cluster import kmeans_features
    from churnforge.operators.refdist import class_stats, reference_features
    add = lambda d: d.withColumn("surcharge", fe.charge_residual("total", "monthly", "tenure"))
    df, ref = add(df), add(ref)
    cols = list(nums) + ["surcharge"]
    out = reference_features(df, class_stats(ref, label, cols), cols)
    out = kmeans_features(out, ref, k=k, cols=cols, n_init=n_init)
    ngram = fe.cross("priority", "segment", "flag", null_rule="text")
    out = encode.apply_group_mean(out, encode.fit_group_mean(ref, ngram, label), ngram, "ngram_rate", 0.0)
    return out.withColumn("n_flag_a_or_urgent", fe.count_equal(["flag"], "A") + fe.count_equal(["priority"], "1-URGENT"))


def reference_distribution_booster(spark: SparkSession, sf_dir: str, k: int = 3, max_iter: int = 10):
    """SURVEY 3.2 end to end: features against the labelled rows as reference population ->
    cross-fitted GBT -> score predictions calibrated to the training base rate (L17).
    Returns (oof, calibrated score-row predictions)."""
    from churnforge.operators.ensemble import calibrate
    f = cut_lineage(frames.order_frame(spark, sf_dir))
    ref = f.filter(F.col("split") == "train")
    feats = cut_lineage(reference_distribution_features(f, ref))
    num_cols = [c for c in feats.columns if c.startswith(("zscore_", "dist_", "kmeans_dist_"))]
    num_cols += ["ngram_rate", "n_flag_a_or_urgent", "surcharge", "tenure", "monthly", "total"]
    tr = folds.stratified_folds(feats.filter(F.col("split") == "train"), "id", "label", k=k)
    oof, test = models.crossfit(tr, num_cols, "label", "id", "fold", k, "gbt",
                                score_rows=feats.filter(F.col("split") == "score"), maxIter=max_iter)
    rate = ref.select(F.avg(F.col("label").cast("double"))).first()[0]
    return oof, calibrate(test.select("id", "score"), rate)
