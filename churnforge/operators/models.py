"""Model-level operators on Spark ML.

Each operator is a loop over a handful of folds / trials / families on the driver; every fit and
every scoring pass is a distributed Spark ML job over the DataFrame. Out-of-fold scores are a long
table (model, id, fold, score); score-set predictions are averaged over the fold models (A8)."""

from __future__ import annotations

import json
import random
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnforge.operators import encode
from churnforge.operators.metrics import auc, auc_value
from churnforge.session import balance, cut_lineage
from churnforge.sources.tables import positive_probability


def estimator(family: str, label: str = "label", features: str = "features", n_rows: int | None = None,
              **params):
    """Spark ML stand-ins for the reference's model families (parameter map in the README)."""
    from pyspark.ml.classification import (FMClassifier, GBTClassifier, LogisticRegression,
                                           MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier)
    common = dict(labelCol=label, featuresCol=features)
    if family == "gbt":  # L2 / L3: boosted trees
        p = dict(maxIter=20, maxDepth=5, stepSize=0.1, subsamplingRate=0.8, seed=42, maxBins=64)
        p.update(params)
        return GBTClassifier(**common, **p)
    if family == "gbt_shallow":  # L4: shallow, many small trees
        p = dict(maxIter=30, maxDepth=3, stepSize=0.1, subsamplingRate=0.7, featureSubsetStrategy="sqrt",
                 seed=43, maxBins=64)
        p.update(params)
        return GBTClassifier(**common, **p)
    if family == "rf":
        p = dict(numTrees=50, maxDepth=8, seed=44, maxBins=64)
        p.update(params)
        return RandomForestClassifier(**common, **p)
    if family == "logreg":  # L6 / L11: C -> regParam = 1 / (C * n)
        c = params.pop("C", 1.0)
        reg = params.pop("regParam", None)
        if reg is None:
            reg = 1.0 / (c * n_rows) if n_rows else 0.0
        p = dict(maxIter=100, regParam=reg, standardization=False)
        p.update(params)
        return LogisticRegression(**common, **p)
    if family == "mlp":  # L7: needs the input width
        p = dict(maxIter=50, seed=42, blockSize=512)
        p.update(params)
        return MultilayerPerceptronClassifier(**common, **p)
    if family == "nb":  # Gaussian NB: continuous inputs of any sign
        p = dict(modelType="gaussian")
        p.update(params)
        return NaiveBayes(**common, **p)
    if family == "fm":  # factorization machine (pairwise interactions)
        p = dict(factorSize=8, maxIter=50, stepSize=0.05, seed=42)
        p.update(params)
        return FMClassifier(**common, **p)
    raise ValueError(f"unknown family {family}")


def _positive_score(df: DataFrame) -> DataFrame:
    return positive_probability(df)


def prepare_features(df: DataFrame, numeric, categorical=(), onehot=()):
    """Fitted feature stages: raw categories as indexed inputs that trees split by category (a level
    unseen in the fit is one more level), others as one-hot slots, one assembled vector. Returns
    (PipelineModel, largest number of levels)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    stages, inputs = [], list(numeric)
    if categorical:
        out = [c + "_cat" for c in categorical]
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=out, handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
        inputs += out
    if onehot:
        stages += encode.one_hot_stages(onehot)
        inputs += [c + "_ohe" for c in onehot]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    fitted = Pipeline(stages=stages).fit(df)
    levels = max((len(labels) + 1 for labels in fitted.stages[0].labelsArray), default=0) if categorical else 0
    return fitted, levels


def tree_bins(params: dict, levels: int) -> dict:
    """Tree parameters with as many bins as the widest category has levels."""
    return params | ({"maxBins": max(params.get("maxBins", 64), levels)} if levels else {})


#: Families whose Spark ML estimators take row weights.
WEIGHTED_FAMILIES = ("gbt", "gbt_shallow", "rf", "logreg", "nb")


def fit_family(df: DataFrame, family: str, label: str, numeric, categorical=(), onehot=(), n_rows: float | None = None,
               weight_col: str | None = None, **params):
    """One fitted pipeline (feature stages, then the model). Trees get as many bins as the widest
    category has levels; a network's first layer is as wide as the features. ``weight_col``: a row of
    weight w counts as w rows (``n_rows`` is then the sum of the weights)."""
    from pyspark.ml import PipelineModel
    from churnforge.functions.clean import feature_dim
    prep, levels = prepare_features(df, numeric, categorical, onehot)
    ready = prep.transform(df)
    kw = tree_bins(params, levels) if family in ("gbt", "gbt_shallow", "rf") else dict(params)
    if weight_col:
        if family not in WEIGHTED_FAMILIES:
            raise ValueError(f"{family} takes no row weights")
        kw["weightCol"] = weight_col
    if family == "mlp":
        kw.setdefault("layers", [feature_dim(ready, "features"), 512, 256, 128, 2])
    model = estimator(family, label, n_rows=n_rows, **kw)
    if family == "mlp":
        from churnforge.operators.network import fit_network
        return PipelineModel(stages=[*prep.stages, fit_network(model, ready)])
    return PipelineModel(stages=[*prep.stages, model.fit(ready)])


def crossfit(train: DataFrame, feature_cols, label: str, id_col: str, fold_col: str, k: int,
             family: str = "logreg", score_rows: DataFrame | None = None, te_cols=(), te_map: DataFrame | None = None,
             model_name: str | None = None, early_stopping: bool = False, parallelism: int | None = None,
             keep_models: bool = False, categorical=(), onehot=(), ordered_cols=(), scale: bool = False, impute_cols=(),
             weight_col: str | None = None, balanced: bool = False, patience: int | None = None, max_rounds: int = 200,
             keep_rounds: bool = False, **params):
    """L1: K models, each fitted on the other folds; every training row is scored once (OOF) and the
    score rows are scored by every fold model and averaged.

    Encodings are those of the fold: with ``te_map`` (from encode.fit_fold_target_encoder) fold f's
    model, validation and score rows all use map f; ``ordered_cols`` (L5, D9) show a training row the
    rows before it and all others the full statistics of the fold's training rows; ``categorical`` (L3)
    are indexed on the fold's training rows; ``onehot`` (D4) likewise; ``scale`` (D2) standardises the
    numbers and encodings by the fold's training rows.
    Numbers in ``impute_cols`` (L4) may be null: they get the median of the fold's training rows, and trees
    see a null through one indicator column each. ``weight_col`` (D13) weighs the training rows, ``balanced``
    weighs positives by the negatives per positive of the fold's training rows.
    L9: early_stopping carves a validation slice out of fold-train (never the scored fold); it stops by
    Spark's tolerance, or with ``patience`` after so many rounds without gain, at most ``max_rounds``, and keeps
    the best round (boosting.fit_boosted).
    Up to ``parallelism`` (default: all K, at most 10) fold models are fitted concurrently, as
    CrossValidator's parallelism does; each fit is still a distributed job.
    Returns (oof: model,id,fold,label,score ; test: model,id,score), plus the K fitted pipelines when
    ``keep_models``, plus the loss curves (model, fold, round, loss) when ``keep_rounds``."""
    from concurrent.futures import ThreadPoolExecutor
    name = model_name or family
    # K fits read the same rows: balance them by bytes, then cut the lineage once (reliable checkpoint
    # in the shared folder, so a lost executor re-reads rather than recomputes)
    train = cut_lineage(balance(train))
    sizes = {r[0]: r[1] for r in train.groupBy(fold_col).agg(
        F.sum(weight_col).cast("double") if weight_col else F.count(F.lit(1))).collect()}      # k rows
    n_rows = sum(sizes.values())
    if score_rows is not None:
        score_rows = cut_lineage(balance(score_rows))
    feats = [*feature_cols, *(c for c in impute_cols if c not in feature_cols), *(c + encode.IS_NULL for c in impute_cols),
             *(c + "_te" for c in te_cols), *(c + "_cbe" for c in ordered_cols)]
    medians = encode.median_table(encode.fit_median_imputer(train, impute_cols, fold_col, k)) if impute_cols else {}

    priors: dict = {}
    if te_map is not None and te_cols:              # all folds' encodings by one lookup, written once
        inputs = {*feature_cols, *impute_cols, *categorical, *onehot, *ordered_cols, id_col, label, fold_col, weight_col}
        rest = lambda d: [c for c in d.columns if c in inputs]
        encoded, priors = encode.apply_fold_encodings(train, te_map, te_cols, k, keep=rest(train))
        train = cut_lineage(encoded)
        if score_rows is not None:
            score_rows = cut_lineage(encode.apply_fold_encodings(score_rows, te_map, te_cols, k, keep=rest(score_rows))[0])

    def one_fold(f: int):
        rows, sc = train, score_rows
        if te_map is not None and te_cols:
            rows, sc = (encode.fold_encodings(d, te_cols, f, priors) if d is not None else None for d in (rows, sc))
        tr, va = rows.filter(F.col(fold_col) != f), rows.filter(F.col(fold_col) == f)
        if ordered_cols:
            full = encode.resolve_target_encoding(encode.fit_ordered_encoder(tr, ordered_cols, label))
            tr = encode.ordered_encoding_wide(tr, ordered_cols, label, id_col)
            va, sc = (encode.apply_target_encoding(d, full, ordered_cols, suffix="_cbe") if d is not None else None
                      for d in (va, sc))
        if impute_cols:
            tr, va, sc = (encode.impute_by(d, medians[f], impute_cols) if d is not None else None for d in (tr, va, sc))
        weight = weight_col
        if balanced:
            tr, weight = encode.class_weight(tr, label, "_weight", weight_col), "_weight"
        if scale and feats:
            stats = encode.fit_scaler(tr, feats)
            row = stats.first()
            tr, va, sc = (encode.scale_by(d, row, feats) if d is not None else None for d in (tr, va, sc))
        kw, curve = dict(params), []
        slice_ = F.pmod(F.xxhash64(F.col(id_col), F.lit(f)), F.lit(10)) == 0
        if patience is not None:
            from churnforge.operators.boosting import fit_boosted
            run = fit_boosted(tr.filter(~slice_), tr.filter(slice_), family, label, feats, categorical, onehot, patience=patience,
                              max_rounds=max_rounds, **(kw | ({"weightCol": weight} if weight else {})))
            model, curve = run.model, run.losses
        else:
            if early_stopping and family.startswith("gbt"):
                tr = tr.withColumn("_es_val", slice_)
                kw.update(validationIndicatorCol="_es_val", validationTol=0.001)
            model = fit_family(tr, family, label, feats, categorical, onehot, n_rows=n_rows - sizes.get(f, 0), weight_col=weight, **kw)
        oof_f = _positive_score(model.transform(va)).select(
            F.lit(name).alias("model"), id_col, F.lit(f).alias("fold"), label, "score")
        test_f = _positive_score(model.transform(sc)).select(id_col, "score") if sc is not None else None
        return oof_f, test_f, model, curve

    workers = min(k, 10) if parallelism is None else max(1, min(parallelism, k))
    with ThreadPoolExecutor(max_workers=workers) as pool:
        results = list(pool.map(one_fold, range(k)))
    oof = reduce(DataFrame.unionByName, [r[0] for r in results])
    test = None
    tests = [r[1] for r in results if r[1] is not None]
    if tests:
        test = reduce(DataFrame.unionByName, tests).groupBy(id_col).agg(F.avg("score").alias("score")) \
            .withColumn("model", F.lit(name))
    out = [oof, test]
    if keep_models:
        out.append([r[2] for r in results])
    if keep_rounds:
        rows = [(name, f, i, loss) for f, r in enumerate(results) for i, loss in enumerate(r[3], 1)]      # k x max_rounds at most
        out.append(train.sparkSession.createDataFrame(rows, "model string, fold int, round int, loss double"))
    return tuple(out)


def oof_checks(oof: DataFrame, id_col: str = "id") -> DataFrame:
    """Per model and fold: rows, distinct ids and scores inside 0..1 (invariants, not values)."""
    return oof.groupBy("model", "fold").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(id_col).alias("n_ids"),
        F.count_if(F.col("score").between(0, 1)).alias("n_in_range"))


def logreg_gradient(df: DataFrame, features, label: str, coefficients, intercept: float, reg: float,
                    weight_col: str | None = None) -> DataFrame:
    """(term, gradient): the gradient of the penalised mean log-loss at the given coefficients, as one
    aggregate over the rows; the intercept is not penalised. At an optimum every component is 0."""
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    z = sum((F.lit(float(b)) * F.col(c) for b, c in zip(coefficients, features, strict=True)), F.lit(float(intercept)))
    miss = w * (F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) - F.col(label).cast("double"))
    row = df.agg(F.sum(w).alias("n"), F.sum(miss).alias("g0"), *[F.sum(miss * F.col(c)).alias(f"g{i}") for i, c in enumerate(features, 1)])
    terms = [F.struct(F.lit("intercept").alias("term"), (F.col("g0") / F.col("n")).alias("gradient"))]
    terms += [F.struct(F.lit(c).alias("term"), (F.col(f"g{i}") / F.col("n") + F.lit(float(reg) * float(b))).alias("gradient"))
              for i, (c, b) in enumerate(zip(features, coefficients, strict=True), 1)]
    return row.select(F.explode(F.array(*terms)).alias("t")).select("t.term", "t.gradient")


def fold_importances(spark, fold_models, feature_cols, how: str = "mean") -> DataFrame:
    """A9 (mean over the fold models) / A10 (sum): feature importances x 100, sorted (T1); of trees their own,
    of a linear model the shares of the absolute coefficients.
    The table has one row per feature, so it is built on the driver."""
    import numpy as np

    def of(model) -> np.ndarray:
        if hasattr(model, "featureImportances"):
            return model.featureImportances.toArray()
        size = np.abs(model.coefficients.toArray())
        return size / size.sum() if size.sum() else size

    mats = np.array([of(m.stages[-1]) for m in fold_models])
    agg = mats.mean(axis=0) if how == "mean" else mats.sum(axis=0)
    rows = sorted(((c, float(v) * 100.0) for c, v in zip(feature_cols, agg)), key=lambda t: -t[1])
    return spark.createDataFrame(rows, "feature string, importance_pct double")


def top_features(importances: DataFrame, k: int = 5) -> DataFrame:
    """The k most important features."""
    return importances.orderBy(F.desc("importance_pct"), "feature").limit(k)


def multi_crossfit(train: DataFrame, feature_cols, label: str, id_col: str, fold_col: str, k: int, families,
                   score_rows: DataFrame | None = None, te_cols=(), te_map=None, params=None):
    """Several families on the same folds -> one long OOF table and one long test table. A family
    is a name, or (model name, family, crossfit options): options replace the shared inputs, so that one
    member may take raw categories (L3), another ordered encodings (L5)."""
    params = params or {}
    oofs, tests = [], []
    for member in families:
        name, fam, options = (member, member, {}) if isinstance(member, str) else member
        shared = {"te_cols": te_cols, "te_map": te_map, "feature_cols": feature_cols}
        oof, test = crossfit(train, label=label, id_col=id_col, fold_col=fold_col, k=k, family=fam, score_rows=score_rows,
                             model_name=name, **(shared | params.get(name, {}) | options))
        oofs.append(oof)
        if test is not None:
            tests.append(test)
    return reduce(DataFrame.unionByName, oofs), (reduce(DataFrame.unionByName, tests) if tests else None)


# ---------------------------------------------------------------- L10 tuning
# The reference's ranges by Spark ML's names; minimum child weight, minimum gain and column share have no
# exact counterpart and take the nearest one.
DEFAULT_SPACE = {
    "stepSize": ("log", 0.005, 0.05),
    "maxDepth": ("int", 3, 9),
    "subsamplingRate": ("float", 0.4, 0.95),
    "featureSubsetStrategy": ("share", 0.3, 0.95),
    "minInstancesPerNode": ("int", 1, 20),
    "minInfoGain": ("log", 0.001, 10.0),
    "te_smoothing": ("float", 1.0, 50.0),
}


def _draw(rng: random.Random, spec):
    kind, lo, hi = spec
    if kind == "int":
        return rng.randint(lo, hi)
    if kind == "log":
        import math
        return math.exp(rng.uniform(math.log(lo), math.log(hi)))
    if kind == "share":  # Spark takes a share of the columns as text
        return f"{rng.uniform(lo, hi):.3f}"
    return rng.uniform(lo, hi)


def random_search(train: DataFrame, feature_cols, label: str, id_col: str, n_trials: int = 30, seed: int = 42,
                  space=None, te_cols=(), family: str = "gbt", max_iter: int = 20, parallelism: int = 4):
    """Seeded random search on a stratified 80/20 hold-out (M1); target-encoding smoothing is
    searched jointly. The counts and sums per key are aggregated and looked up once, before the trials;
    a trial's smoothing is an expression over them. Parameters are drawn up front from one seeded
    generator, so the trial list does not depend on ``parallelism`` (trials run concurrently, as
    TrainValidationSplit's parallelism).
    Returns (trials DataFrame(trial, params, auc), best params dict)."""
    from concurrent.futures import ThreadPoolExecutor
    from churnforge.operators.folds import holdout
    space = dict(space or DEFAULT_SPACE)
    rng = random.Random(seed)
    draws = [{k: _draw(rng, v) for k, v in space.items()} for _ in range(n_trials)]
    ho = cut_lineage(balance(holdout(train, id_col, label, seed=seed)))
    prior = None
    if te_cols:
        stats, prior = encode.fit_target_stats(ho.filter(F.col("holdout") == "fit"), te_cols, label)
        ho = cut_lineage(encode.apply_target_stats(ho, stats, te_cols))
    fit, valid = ho.filter(F.col("holdout") == "fit"), ho.filter(F.col("holdout") == "valid")

    def trial(t: int):
        p = dict(draws[t])
        smoothing = p.pop("te_smoothing", 20.0)
        enc = {c + "_te": encode.smoothed_stats(c, prior, smoothing) for c in te_cols}
        tr, va = (d.withColumns(enc) if enc else d for d in (fit, valid))
        model = fit_family(tr, family, label, [*feature_cols, *enc], maxIter=max_iter, **p)
        a = auc_value(_positive_score(model.transform(va)), label, "score")
        p["te_smoothing"] = smoothing
        return (t, json.dumps(p, sort_keys=True), float(a))

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, n_trials))) as pool:
        rows = list(pool.map(trial, range(n_trials)))
    trials = train.sparkSession.createDataFrame(rows, "trial int, params string, auc double")
    best = max(rows, key=lambda r: (r[2], -r[0]))
    return trials, json.loads(best[1])


# ---------------------------------------------------------------- L11 stacking, L18 adversarial, L22 AutoML
def stack(oof_long: DataFrame, test_long: DataFrame | None, models, label: str, id_col: str = "id",
          k: int = 5, seed: int = 42, **params):
    """Logistic regression on the K x models OOF matrix. The stacker itself is cross-fitted
    (its OOF AUC is honest); the final stacker fits all OOF rows and scores the averaged test scores. The prediction
    tables are evaluated once: folds, fits and counts read one checkpoint of the matrix."""
    from churnforge.operators.ensemble import wide_scores
    from churnforge.operators.folds import stratified_folds
    wide = cut_lineage(wide_scores(oof_long, models, id_col, keep=[label]))
    wide = stratified_folds(wide, id_col, label, k=k, seed=seed, out="_stack_fold")
    if test_long is not None:
        wide = cut_lineage(wide)
    feats = [f"s_{m}" for m in models]
    oof, _ = crossfit(wide, feats, label, id_col, "_stack_fold", k, "logreg", model_name="stack", **({"C": 1.0} | params))
    test = None
    if test_long is not None:
        final = fit_family(wide, "logreg", label, feats, n_rows=wide.count(), **({"C": 1.0} | params))
        test = _positive_score(final.transform(wide_scores(test_long, models, id_col))).select(id_col, "score")
    return oof, test


def adversarial_validation(df: DataFrame, feature_cols, split_col: str = "split", score_tag: str = "score",
                           id_col: str = "id", k: int = 5, family: str = "gbt", drift_auc: float = 0.52,
                           importance_pct: float = 15.0, categorical=(), **params):
    """Classify score rows against training rows with K cross-fitted models. Returns (OOF AUC,
    drifted?, importances DataFrame(feature, importance_pct) averaged over the fold models (A9) and
    sorted (T1), [features above the threshold])."""
    from churnforge.operators.folds import stratified_folds
    from churnforge.operators.shift import drift_flags
    lab = df.withColumn("_is_score", (F.col(split_col) == score_tag).cast("int"))
    lab = stratified_folds(lab, id_col, "_is_score", k=k, out="_adv_fold")
    oof, _, fold_models = crossfit(lab, feature_cols, "_is_score", id_col, "_adv_fold", k, family,
                                   keep_models=True, categorical=categorical, **params)
    a = auc_value(oof, "_is_score", "score")
    imps = fold_importances(df.sparkSession, fold_models, [*feature_cols, *categorical], "mean")
    flagged = [r["feature"] for r in drift_flags(imps, importance_pct).collect()]      # at most the features
    return a, a > drift_auc, imps, flagged


def drift_summary(df: DataFrame, feature_cols, top: int = 5, **options) -> DataFrame:
    """L18 report: one row with the AUC, the drift flag, the top features and the flagged ones."""
    a, drifted, imps, flagged = adversarial_validation(df, feature_cols, **options)
    best = [r["feature"] for r in top_features(imps, top).collect()]
    return df.sparkSession.createDataFrame([(a, bool(drifted), best, sorted(flagged))],
                                           "auc double, drifted boolean, top_features array<string>, flagged array<string>")


def leaderboard(oof_long: DataFrame, label: str = "label", top: int = 15) -> DataFrame:
    """Models ranked by OOF AUC."""
    return auc(oof_long, label, "score", ["model"]).orderBy(F.desc("auc"), "model").limit(top)


AUTOML_FAMILIES = ("gbt", "rf", "logreg", "gbt_shallow", "fm", "nb", "mlp")


def automl(train: DataFrame, feature_cols, label: str, id_col: str, fold_col: str, k: int,
           families=AUTOML_FAMILIES, score_rows: DataFrame | None = None, params=None, weighted: bool = False):
    """Cross-fit several families on the same folds, stack them, rank everything by OOF AUC; with
    ``weighted`` also their greedily weighted blend (L12; its AUC is that of the rows the weights were chosen on).
    Returns (leaderboard DataFrame, oof_long, test_long); best_model picks the winner."""
    oof, test = multi_crossfit(train, feature_cols, label, id_col, fold_col, k, families, score_rows,
                               params=params)
    # the stack, the blend and the leaderboard read one scoring pass of every fold model
    oof, test = (cut_lineage(d) if d is not None else None for d in (oof, test))
    st_oof, st_test = stack(oof, test, list(families), label, id_col, k=k)
    all_oof = oof.unionByName(st_oof.select(*oof.columns))
    if weighted:
        from churnforge.operators.ensemble import select_models, weighted_blend
        _, weights = select_models(oof, list(families), label, id_col=id_col)
        rows = oof.filter(F.col("model") == families[0]).select(id_col, "fold", label)
        blend = rows.join(weighted_blend(oof, weights, id_col), id_col).withColumn("model", F.lit("weighted"))
        all_oof = all_oof.unionByName(blend.select(*oof.columns))
        if test is not None:
            blended = weighted_blend(test, weights, id_col).withColumn("model", F.lit("weighted"))
            test = test.unionByName(blended.select(*test.columns))
    if test is not None and st_test is not None:
        test = test.unionByName(st_test.withColumn("model", F.lit("stack")).select(*test.columns))
    return leaderboard(all_oof, label), all_oof, test


def best_model(board: DataFrame, among=None) -> str:
    """L22 tail: the best model of a leaderboard, of those in ``among`` if given (a stack is not one fit)."""
    rows = board if among is None else board.filter(F.col("model").isin(*among))
    return rows.orderBy(F.desc("auc"), "model").first()["model"]


def fit_final(train: DataFrame, feature_cols, label: str, family: str = "gbt", **params):
    """L23 half one: refit the chosen family on all training rows (save with sources.save_model)."""
    return fit_family(train, family, label, feature_cols, n_rows=train.count(), **params)


def score_with(model, df: DataFrame, id_col: str = "id", labels=None) -> DataFrame:
    """Score rows with a (re)loaded pipeline; positive-class probability, found by the label
    names if the model has them (S12)."""
    return positive_probability(model.transform(df), labels=labels).select(id_col, "score")
