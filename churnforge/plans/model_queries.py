"""Registered queries of models, scorers and fitted state, with values that SQL can state.

SQL solves a penalised logistic regression of two features by itself (Newton's method, written out step by step), so
that coefficients and out-of-fold AUCs of the cross-fit are compared as numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnforge.functions import clean
from churnforge.functions import features as fe
from churnforge.operators import boosting, cluster, encode, ensemble, folds, metrics, models, scorer, sketches
from churnforge.plans import frames
from churnforge.plans.catalog import (CATS, D1_NUMS, NUMS, VARIANTS, _checked, _filled_sql, _holed, _long_sql, _oof_checks_sql,
                                      _reread, _scratch, auc_sql)
from churnforge.plans.oracle import folds_cte, num, with_orders
from churnforge.plans.registry import r6, register
from churnforge.session import cut_lineage
from churnforge.sources import tables

#: A fit that stands still: Spark's optimiser stops on the relative gain of a step.
EXACT = {"tol": 1e-14, "maxIter": 1000}


# =============================================================== L1 / L6 / L11 / D13: fits checked by value
def logreg_sql(src: str, c: float, steps: int = 10, name: str = "b") -> list[str]:
    """CTEs that end in <name>(grp, n, b0, b1, b2): the minimum of sum(w * log-loss) + (b1^2 + b2^2) / (2 C) for every grp
    of <src>(grp, x1, x2, y, w), by Newton's method from 0; the 3 x 3 systems are solved by determinants."""
    out = [f"{name}0 AS (SELECT grp, sum(w) AS n, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM {src} GROUP BY grp)"]
    for t in range(1, steps + 1):
        last = name if t == steps else f"{name}{t}"
        out.append(f"""{name}g{t} AS MATERIALIZED (
  SELECT grp, any_value(n) AS n, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2,
    sum(w * (p - y)) AS g0, sum(w * (p - y) * x1) + any_value(b1) / {c!r} AS g1, sum(w * (p - y) * x2) + any_value(b2) / {c!r} AS g2,
    sum(w * p * (1 - p)) AS h00, sum(w * p * (1 - p) * x1) AS h01, sum(w * p * (1 - p) * x2) AS h02,
    sum(w * p * (1 - p) * x1 * x1) + 1 / {c!r} AS h11, sum(w * p * (1 - p) * x1 * x2) AS h12, sum(w * p * (1 - p) * x2 * x2) + 1 / {c!r} AS h22
  FROM (SELECT s.*, b.n, b0, b1, b2, 1.0 / (1.0 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p FROM {src} s JOIN {name}{t - 1} b ON s.grp = b.grp) z
  GROUP BY grp)""")
        out.append(f"""{last} AS MATERIALIZED (
  SELECT grp, n, b0 - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det AS b0,
    b1 - (h00 * (g1 * h22 - g2 * h12) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det AS b1,
    b2 - (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det AS b2
  FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM {name}g{t}) z)""")
    return out


def held_out_sql(src: str, k: int, x1: str = "x1", x2: str = "x2", w: str = "1.0") -> str:
    """The training rows of every fold model: (grp, x1, x2, y, w) with grp the fold that is left out."""
    return f"ho AS (SELECT f.f AS grp, {x1} AS x1, {x2} AS x2, CAST(label AS DOUBLE) AS y, {w} AS w FROM {src} JOIN range({k}) f(f) ON fold <> f.f)"


#: Per fold model: coefficients, and the AUC of the rows it scores.
FOLD_FITS = """
SELECT CAST(b.grp AS INTEGER) AS fold, round(b0, 4) AS intercept, round(b1, 4) AS coef_1, round(b2, 4) AS coef_2,
       round(sum(pos * (neg_before + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc
FROM b JOIN run ON run.fold = b.grp GROUP BY b.grp, b0, b1, b2"""


def oof_sql(src: str, x1: str = "x1", x2: str = "x2") -> list[str]:
    return [f"oof AS (SELECT fold, label, b0 + b1 * {x1} + b2 * {x2} AS score FROM {src} JOIN b ON fold = b.grp)", auc_sql("oof", "fold").strip()]


def fold_fits(oof: DataFrame, fitted, label: str = "label") -> DataFrame:
    """(fold, intercept, coef_1, coef_2, auc) of the fold models of a two-feature cross-fit."""
    rows = [(f, float(m.stages[-1].intercept), *(float(x) for x in m.stages[-1].coefficients)) for f, m in enumerate(fitted)]
    fits = oof.sparkSession.createDataFrame(rows, "fold int, intercept double, coef_1 double, coef_2 double")
    aucs = metrics.auc(oof, label, "score", ["fold"]).select("fold", "auc")
    return fits.join(aucs, "fold").select("fold", *[F.round(c, 4).alias(c) for c in ("intercept", "coef_1", "coef_2")], r6("auc").alias("auc"))


def _scaled_pair(spark, sf, orders=None, k=5):
    """Training rows with two numbers scaled by all of them, in folds."""
    orders = frames.order_frame(spark, sf) if orders is None else orders
    tr = orders.filter("split = 'train'").select("id", "label", "total", "acctbal")
    tr = encode.standard_scale(tr, ["total", "acctbal"])
    return folds.stratified_folds(tr, "id", "label", k=k)


SCALED_PAIR_SQL = [
    "st AS (SELECT avg(total) AS tm, stddev_pop(total) AS ts, avg(acctbal) AS am, stddev_pop(acctbal) AS asd FROM order_frame WHERE split = 'train')",
    "sc AS (SELECT id, label, split, (total - tm) / ts AS x1, (acctbal - am) / asd AS x2 FROM order_frame, st)",
    folds_cte(k=5, source="sc")]


@register("l1_crossfit_values", with_orders(*SCALED_PAIR_SQL, held_out_sql("folded", 5), *logreg_sql("ho", 1.0), *oof_sql("folded")) + FOLD_FITS)
def q_l1_values(spark: SparkSession, sf: str) -> DataFrame:
    """L1 by value: the coefficients of every fold model and the AUC of the rows it scores."""
    oof, _, fitted = models.crossfit(_scaled_pair(spark, sf), ["total", "acctbal"], "label", "id", "fold", 5, "logreg", keep_models=True,
                                     C=1.0, **EXACT)
    return fold_fits(oof, fitted)


@register("d13_weighted_crossfit_values", with_orders(
    *SCALED_PAIR_SQL,
    "ratio AS (SELECT f.f AS grp, sum(1.0 - label) / sum(label) AS r FROM folded JOIN range(5) f(f) ON fold <> f.f GROUP BY f.f)",
    "ho AS (SELECT f.f AS grp, x1, x2, CAST(label AS DOUBLE) AS y, (1 + id % 3) * CASE WHEN label = 1 THEN r.r ELSE 1.0 END AS w "
    "FROM folded JOIN range(5) f(f) ON fold <> f.f JOIN (SELECT f.f AS grp, sum((1 + id % 3) * (1.0 - label)) / sum((1 + id % 3) * label) AS r "
    "FROM folded JOIN range(5) f(f) ON fold <> f.f GROUP BY f.f) r ON r.grp = f.f)",
    # the penalty follows the sum of the rows' own weights
    *logreg_sql("(SELECT grp, x1, x2, y, w / scale AS w FROM ho JOIN (SELECT grp, sum(w) AS total FROM ho GROUP BY grp) t USING (grp) "
                "JOIN (SELECT f.f AS grp, sum(1 + id % 3) AS own FROM folded JOIN range(5) f(f) ON fold <> f.f GROUP BY f.f) o USING (grp), "
                "LATERAL (SELECT total / own AS scale) l)", 1.0),
    *oof_sql("folded")) + FOLD_FITS)
def q_d13_values(spark, sf):
    """D13 in a learner: rows weighted by 1 to 3, positives raised to the weight of the negatives in every fold."""
    tr = _scaled_pair(spark, sf).withColumn("w", (F.col("id") % 3 + 1).cast("double"))
    oof, _, fitted = models.crossfit(tr, ["total", "acctbal"], "label", "id", "fold", 5, "logreg", keep_models=True, weight_col="w",
                                     balanced=True, C=1.0, **EXACT)
    return fold_fits(oof, fitted)


@register("d13_weighted_auc", with_orders() + """
SELECT model, round(sum(pos * (neg_before + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc, sum(pos) AS w_pos, sum(neg) AS w_neg FROM (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_before
  FROM (SELECT model, score, CAST(sum(w * label) AS DOUBLE) AS pos, CAST(sum(w * (1 - label)) AS DOUBLE) AS neg
        FROM (SELECT *, CASE WHEN id % 5 = 0 THEN 0 ELSE 1 + id % 4 END AS w FROM score_tables WHERE split = 'train') t GROUP BY model, score) d) r
GROUP BY model""")
def q_d13_auc(spark, sf):
    s = frames.score_tables(spark, sf).filter(F.col("split") == "train").withColumn(
        "w", F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(1 + F.col("id") % 4))
    a = metrics.auc(s, "label", "score", ["model"], weight="w")
    return a.select("model", r6("auc").alias("auc"), F.col("n_pos").alias("w_pos"), F.col("n_neg").alias("w_neg"))


STACK_SQL = [
    "sc AS (SELECT id, label, max(CASE WHEN model = 'a' THEN score END) AS x1, max(CASE WHEN model = 'c' THEN score END) AS x2 "
    "FROM score_tables WHERE split = 'train' GROUP BY id, label)",
    folds_cte(k=5, source="sc", where="true")]


@register("l11_stack_values", with_orders(*STACK_SQL, held_out_sql("folded", 5), *logreg_sql("ho", 1.0), *oof_sql("folded")) + """
SELECT CAST(fold AS INTEGER) AS fold, round(sum(pos * (neg_before + neg / 2.0)) / (sum(pos) * sum(neg)), 5) AS auc,
       (SELECT round(avg(1.0 / (1.0 + exp(-score))), 5) FROM oof o WHERE o.fold = run.fold) AS mean_score FROM run GROUP BY fold""")
def q_l11_values(spark, sf):
    """L11 by value: the cross-fitted stacker over two score tables."""
    s = frames.score_tables(spark, sf)
    oof, _ = models.stack(s.filter("split = 'train'"), None, ["a", "c"], "label", **EXACT)
    means = oof.groupBy("fold").agg(F.avg("score").alias("m"))
    return metrics.auc(oof, "label", "score", ["fold"]).join(means, "fold").select(
        F.col("fold").cast("int").alias("fold"), F.round("auc", 5).alias("auc"), F.round("m", 5).alias("mean_score"))


L6_SQL = [
    "tr AS (" + _filled_sql() + ")",
    "px AS (SELECT id, label, priority || '_X_' || segment AS k1, segment || '_X_' || nation AS k2 FROM tr)",
    folds_cte(k=3, source="px", where="true"),
    *[f"t{i} AS (SELECT f.f AS fold, k{i} AS key, count(*) AS n, sum(CAST(label AS DOUBLE)) AS s FROM folded JOIN range(3) f(f) ON fold <> f.f "
      f"GROUP BY f.f, k{i})" for i in (1, 2)],
    "pri AS (SELECT f.f AS fold, avg(CAST(label AS DOUBLE)) AS prior FROM folded JOIN range(3) f(f) ON fold <> f.f GROUP BY f.f)",
    # every row under every fold model, encoded and then scaled by that model's training rows
    "en AS (SELECT id, label, folded.fold AS own, pri.fold AS fold, "
    + ", ".join(f"CASE WHEN t{i}.n IS NULL THEN prior ELSE prior + (t{i}.s / t{i}.n - prior) / (1.0 + exp(-(t{i}.n - 20.0) / 20.0)) END AS e{i}" for i in (1, 2))
    + " FROM folded CROSS JOIN pri " + " ".join(f"LEFT JOIN t{i} ON t{i}.fold = pri.fold AND t{i}.key = folded.k{i}" for i in (1, 2)) + ")",
    "ms AS (SELECT fold, avg(e1) AS m1, stddev_pop(e1) AS s1, avg(e2) AS m2, stddev_pop(e2) AS s2 FROM en WHERE own <> fold GROUP BY fold)",
    "xs AS (SELECT id, label, own, fold, (e1 - m1) / s1 AS x1, (e2 - m2) / s2 AS x2 FROM en JOIN ms USING (fold))",
    "ho AS (SELECT fold AS grp, x1, x2, CAST(label AS DOUBLE) AS y, 1.0 AS w FROM xs WHERE own <> fold)"]


@register("l6_pair_logreg_values", with_orders(*L6_SQL, *logreg_sql("ho", 0.1), *oof_sql("(SELECT * FROM xs WHERE own = fold)")) + FOLD_FITS)
def q_l6_values(spark, sf):
    """L6 by value: two pair crosses, encoded and scaled per fold, C = 0.1."""
    f = clean.clean_frame(frames.order_frame(spark, sf).filter("split = 'train'"), categorical=CATS)
    pairs = {"priority_segment": fe.cross("priority", "segment", sep="_X_", null_rule="fill"),
             "segment_nation": fe.cross("segment", "nation", sep="_X_", null_rule="fill")}
    tr = folds.stratified_folds(f.select("id", "label", *[v.alias(n) for n, v in pairs.items()]), "id", "label", k=3)
    te_map = encode.fit_fold_target_encoder(tr, list(pairs), "label", "fold", 3, smoothing=20.0)
    oof, _, fitted = models.crossfit(tr, [], "label", "id", "fold", 3, "logreg", te_cols=list(pairs), te_map=te_map, scale=True,
                                     keep_models=True, C=0.1, **EXACT)
    return fold_fits(oof, fitted)


POINT = (0.3, -0.2, 0.1)


@register("l1_gradient_at_a_point", with_orders(*SCALED_PAIR_SQL[:2]) + f"""
SELECT term, round(g, 6) AS gradient FROM (
  SELECT avg(p - label) AS intercept, avg((p - label) * x1) + 0.05 * ({POINT[1]}) AS total, avg((p - label) * x2) + 0.05 * {POINT[2]} AS acctbal
  FROM (SELECT *, 1.0 / (1.0 + exp(-({POINT[0]} + {POINT[1]} * x1 + {POINT[2]} * x2))) AS p FROM sc WHERE split = 'train') t) s
UNPIVOT (g FOR term IN (intercept, total, acctbal))""")
def q_gradient(spark, sf):
    tr = encode.standard_scale(frames.order_frame(spark, sf).filter("split = 'train'"), ["total", "acctbal"])
    g = models.logreg_gradient(tr, ["total", "acctbal"], "label", POINT[1:], POINT[0], 0.05)
    return g.select("term", r6("gradient").alias("gradient"))


@register("l1_l6_l11_optimality", """
SELECT model, n_terms, true AS at_optimum FROM (VALUES ('crossfit', 15), ('pairs', 22), ('stack', 4)) v(model, n_terms)""")
def q_optimality(spark, sf):
    """The gradient of the penalised likelihood at the coefficients of Spark's fits: no component above 1e-4."""
    parts = []
    orders = cut_lineage(frames.order_frame(spark, sf))     # scaled numbers, bins, pairs and score tables read it

    def check(name, rows, features, model, c):
        lr = model.stages[-1]
        n = rows.count()
        parts.append(models.logreg_gradient(rows, features, "label", list(lr.coefficients), lr.intercept, 1.0 / (c * n)).withColumn("model", F.lit(name)))

    tr = cut_lineage(_scaled_pair(spark, sf, orders))
    _, _, fitted = models.crossfit(tr, ["total", "acctbal"], "label", "id", "fold", 5, "logreg", keep_models=True, C=1.0)
    for f, m in enumerate(fitted):
        check("crossfit", tr.filter(F.col("fold") != f), ["total", "acctbal"], m, 1.0)
    bins = {"tenure": 15, "monthly": 20, "total": 20}
    o = orders.filter("split = 'train'")
    binned = encode.apply_quantile_bins_multi(o, encode.fit_quantile_bins_multi(o, bins), list(bins))
    src = CATS + [f"{c}_bin" for c in bins]
    pairs = fe.all_pair_crosses(src, sep="_X_", null_rule="fill")
    wide = clean.clean_frame(binned.select("id", "label", *src), categorical=src).select("id", "label", *[v.alias(n) for n, v in pairs.items()])
    enc = [f"{n}_te" for n in pairs]
    wide = encode.apply_target_encoding(wide, encode.fit_target_encoder(wide, list(pairs), "label"), list(pairs))
    wide = cut_lineage(encode.standard_scale(wide.select("label", *enc), enc))
    check("pairs", wide, enc, models.fit_final(wide, enc, "label", "logreg", C=0.1), 0.1)
    s = cut_lineage(ensemble.wide_scores(frames.score_tables(spark, sf, orders).filter("split = 'train'"), ["a", "b", "c"], keep=["label"]))
    check("stack", s, ["s_a", "s_b", "s_c"], models.fit_final(s, ["s_a", "s_b", "s_c"], "label", "logreg", C=1.0), 1.0)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("model").agg(F.count(F.lit(1)).cast("int").alias("n_terms"), (F.max(F.abs("gradient")) < 1e-4).alias("at_optimum"))


# =============================================================== L9: patience and best round
@register("l9_patience_rule", """
WITH losses AS (
  SELECT l_returnflag AS curve, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS round, round(avg(l_discount), 6) AS loss
  FROM lineitem GROUP BY ALL
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY curve ORDER BY round) AS n FROM losses
), best AS (
  SELECT a.curve, a.n, (SELECT b.n FROM numbered b WHERE b.curve = a.curve AND b.n <= a.n ORDER BY b.loss, b.n LIMIT 1) AS bn FROM numbered a
), ends AS (
  SELECT curve, coalesce(min(CASE WHEN n - bn >= 6 THEN n END), max(n)) AS last FROM best GROUP BY curve
)
SELECT curve, (SELECT x.round FROM numbered x WHERE x.curve = e.curve AND x.n <= e.last ORDER BY x.loss, x.n LIMIT 1) AS best_round,
       (SELECT x.round FROM numbered x WHERE x.curve = e.curve AND x.n = e.last) AS rounds_run,
       (SELECT min(x.loss) FROM numbered x WHERE x.curve = e.curve AND x.n <= e.last) AS best_loss FROM ends e""")
def q_l9_rule(spark, sf):
    """The rule on curves that SQL can state: monthly mean discounts per return flag."""
    li = tables.read_table(spark, sf, "lineitem", ["l_returnflag", "l_shipdate", "l_discount"])
    losses = li.groupBy(F.col("l_returnflag").alias("curve"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("int").alias("round")) \
        .agg(r6(F.avg("l_discount")).alias("loss"))
    return boosting.stop_rounds(losses, 6, ["curve"])


PATIENCE, MAX_ROUNDS = 5, 40


def _patience(spark, sf):
    """Boosted cross-fit with patience; the loss curves are stored and read back."""
    from churnforge.plans.presets import BASE_NUMS, RESIDUALS, folded_train
    tr, _ = folded_train(spark, sf, k=3)
    oof, _, rounds = models.crossfit(tr, BASE_NUMS + RESIDUALS, "label", "id", "fold", 3, "gbt", patience=PATIENCE, max_rounds=MAX_ROUNDS,
                                     keep_rounds=True, stepSize=0.3)
    path = _scratch(spark, "loss-curves")
    tables.write_table(rounds, path)
    return oof, _reread(spark.read.parquet(path), path)


@register("l9_patience_rounds")
def q_l9_rounds(spark, sf):
    return boosting.stop_rounds(_patience(spark, sf)[1], PATIENCE).select("fold", "best_round", "rounds_run")


@register("l9_patience_invariants", with_orders(folds_cte(k=3)) + """
SELECT fold, count(*) AS n_rows, true AS best_is_argmin, true AS ends_by_the_rule FROM folded GROUP BY fold""")
def q_l9_checks(spark, sf):
    """What SQL can say of the stored curves: the best round has the smallest loss, and the curve ends PATIENCE rounds
    later or with the rounds."""
    oof, curves = _patience(spark, sf)
    curves.createOrReplaceTempView("_l9_curves")
    told = spark.sql("SELECT fold, min_by(round, struct(loss, round)) AS argmin, max(round) AS last FROM _l9_curves GROUP BY fold")
    kept = boosting.stop_rounds(curves, PATIENCE).select(F.col("fold").alias("f"), "best_round", "rounds_run")
    n = oof.filter(F.col("score").between(0, 1)).groupBy("fold").agg(F.countDistinct("id").alias("n_rows"))
    both = told.join(kept, told.fold == kept.f).join(n, "fold")
    ends = (F.col("last") == F.col("rounds_run")) & ((F.col("last") == F.col("argmin") + PATIENCE) | (F.col("last") == MAX_ROUNDS))
    return both.select("fold", "n_rows", (F.col("best_round") == F.col("argmin")).alias("best_is_argmin"), ends.alias("ends_by_the_rule"))


# =============================================================== S10 / S11 / L23: a whole scorer
SCORER_STEPS = [
    {"op": "numbers", "columns": {"tenure": "tenure_txt", "monthly": "monthly_txt", "total": "total_txt"}, "fill": 0.0},
    {"op": "categories", "columns": CATS},
    {"op": "scale", "columns": D1_NUMS},
    {"op": "ordinal", "columns": CATS},
    {"op": "target", "columns": CATS, "smoothing": 10.0},
]


def _raw_labelled(spark, sf):
    return frames.raw_order_frame(spark, sf).withColumn("label", clean.label_default0("churn_text"))


def _saved_scorer(spark, raw, steps, **model):
    fitted = scorer.fit_scorer(raw.filter("split = 'train'"), steps, "label", **model)
    path = _scratch(spark, "scorer")
    scorer.save_scorer(fitted, path)
    return fitted, scorer.load_scorer(spark, path), path


@register("s10_scorer_features", with_orders(
    "st AS (SELECT " + ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in D1_NUMS) + " FROM order_frame WHERE split = 'train')",
    "filled AS (" + _filled_sql(where="true") + ")",
    "lf AS (" + _long_sql("(SELECT * FROM filled WHERE split = 'train')", "label") + ")",
    "pr AS (SELECT avg(CAST(label AS DOUBLE)) AS prior FROM filled WHERE split = 'train')",
    "te AS (SELECT feature, key, prior * (1.0 - w) + (s / n) * w AS enc, code FROM (SELECT feature, key, count(*) AS n, "
    "sum(CAST(label AS DOUBLE)) AS s, any_value(prior) AS prior, 1.0 / (1.0 + exp(-(count(*) - 20.0) / 10.0)) AS w, "
    "CAST(row_number() OVER (PARTITION BY feature ORDER BY key) - 1 AS INTEGER) AS code FROM lf, pr GROUP BY feature, key) z)")
    + "SELECT f.id, " + ", ".join([f"round(coalesce((f.{c} - {c}_m) / nullif({c}_s, 0), 0), 6) AS {c}" for c in D1_NUMS]
                                  + [f"coalesce(t_{c}.code, -1) AS {c}_ord, round(coalesce(t_{c}.enc, prior), 6) AS {c}_te" for c in CATS])
    + " FROM filled f, st, pr " + " ".join(f"LEFT JOIN te t_{c} ON t_{c}.feature = '{c}' AND t_{c}.key = f.{c}" for c in CATS)
    + " WHERE f.split = 'score'")
def q_scorer_features(spark, sf):
    """Raw text-typed score rows through the steps of a scorer that was read back from its folder."""
    raw = _raw_labelled(spark, sf)
    _, loaded, path = _saved_scorer(spark, raw, SCORER_STEPS, family=None)
    out = loaded.features(raw.filter("split = 'score'"))
    return _reread(out.select("id", *[r6(c).alias(c) for c in D1_NUMS],
                              *[x for c in CATS for x in (F.col(f"{c}_ord"), r6(f"{c}_te").alias(f"{c}_te"))]), path)


@register("l23_whole_scorer", with_orders() + "SELECT id, true AS same, true AS in_range FROM raw_orders WHERE split = 'score'")
def q_whole_scorer(spark, sf):
    """Scores of raw rows by the scorer read back from its folder, against the session that fitted it."""
    raw = _raw_labelled(spark, sf)
    steps = [*SCORER_STEPS[:2], {"op": "residuals", "total": "total", "monthly": "monthly", "tenure": "tenure"},
             {"op": "bins", "columns": {"tenure": 15, "total": 20}}, {"op": "crosses", "pairs": [["segment", "total_bin"], ["priority", "flag"]]},
             {"op": "ordered", "columns": ["segment_X_total_bin"]}, {"op": "counts", "columns": ["nation"]},
             {"op": "target", "columns": [*CATS, "priority_X_flag"], "smoothing": 20.0}]
    feats = [*D1_NUMS, "charge_residual", "charge_residual_relative", "segment_X_total_bin_cbe", "nation_freq", *(f"{c}_te" for c in [*CATS, "priority_X_flag"])]
    fitted, loaded, path = _saved_scorer(spark, raw, steps, family="gbt", features=feats, categorical=["priority"], labels=["0", "1"], maxIter=10)
    rows = raw.filter("split = 'score'").drop("label")
    here, there = fitted.score(rows).withColumnRenamed("score", "s1"), loaded.score(rows).withColumnRenamed("score", "s2")
    return _reread(rows.select("id").join(here, "id", "left").join(there, "id", "left").select(
        "id", F.col("s1").eqNullSafe(F.col("s2")).alias("same"), F.coalesce(F.col("s2").between(0, 1), F.lit(False)).alias("in_range")), path)


# =============================================================== L4 / P4: nulls kept
KEPT = ["tenure", "monthly", "total"]
NULL_FRAME = ("nf AS (SELECT id, CASE WHEN churn_text IN ('Yes', 'True', '1') THEN 1 ELSE 0 END AS label, split, "
              + ", ".join(f"{num(c + '_txt')} AS {c}" for c in KEPT) + " FROM raw_orders)")


@register("l4_median_imputer_folds", with_orders(
    NULL_FRAME, folds_cte(k=5, source="nf"),
    "lo AS (" + " UNION ALL ".join(f"SELECT f.f AS fold, '{c}' AS feature, {c} AS x FROM folded JOIN range(5) f(f) ON fold <> f.f" for c in KEPT) + ")") + """
SELECT CAST(fold AS INTEGER) AS fold, feature, round(quantile_cont(x, 0.5), 6) AS median, count(*) AS n, count(*) - count(x) AS n_null
FROM lo GROUP BY fold, feature""")
def q_l4_medians(spark, sf):
    """The medians of all fold models from one pass of counts."""
    tr = folds.stratified_folds(frames.order_frame(spark, sf, fill=None).filter("split = 'train'"), "id", "label", k=5)
    m = encode.fit_median_imputer(tr, KEPT, "fold", 5)
    return m.select("fold", "feature", r6("median").alias("median"), "n", "n_null")


@register("l4_imputed_columns", with_orders(
    NULL_FRAME, "me AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in KEPT) + " FROM nf WHERE split = 'train')")
    + "SELECT id, " + ", ".join(f"round(coalesce({c}, m_{c}), 6) AS {c}, CAST({c} IS NULL AS DOUBLE) AS {c}_is_null" for c in KEPT) + " FROM nf, me")
def q_l4_columns(spark, sf):
    f = frames.order_frame(spark, sf, fill=None)
    out = encode.apply_median_imputer(f, encode.fit_median_imputer(f.filter("split = 'train'"), KEPT), KEPT)
    return out.select("id", *[x for c in KEPT for x in (r6(c).alias(c), F.col(f"{c}_is_null"))])


@register("l4_null_routed_oof_invariants", _oof_checks_sql(["gbt_shallow"], 3))
def q_l4_oof(spark, sf):
    """The shallow booster on numbers whose nulls were kept: medians and indicators per fold, raw categories."""
    f = cut_lineage(clean.clean_frame(frames.order_frame(spark, sf, fill=None), categorical=CATS).filter("split = 'train'"))
    tr = folds.stratified_folds(f, "id", "label", k=3)
    oof, _ = models.crossfit(tr, ["acctbal"], "label", "id", "fold", 3, "gbt_shallow", impute_cols=KEPT, categorical=CATS, maxIter=10)
    return _checked(oof)


# =============================================================== R4 / K5 / K10: clusterings checked by value
@register("r4_silhouettes_by_label", """
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), u AS (
  SELECT vec_id, label, unnest(e) / sqrt(list_inner_product(e, e)) AS x, unnest(range(len(e))) AS place FROM v
), s AS (
  SELECT label, place, sum(x) AS s FROM u GROUP BY label, place
), n AS (
  SELECT label, count(*) AS n FROM v GROUP BY label
), d AS (
  SELECT u.vec_id, u.label, s.label AS other, 1 - sum(u.x * s.s) / any_value(n.n) AS d, any_value(n.n) AS n
  FROM u JOIN s ON s.place = u.place JOIN n ON n.label = s.label GROUP BY u.vec_id, u.label, s.label
), ab AS (
  SELECT vec_id, max(CASE WHEN label = other AND n > 1 THEN d * n / (n - 1) END) AS a, min(CASE WHEN label <> other THEN d END) AS b
  FROM d GROUP BY vec_id
)
SELECT vec_id, round(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM ab""")
def q_r4(spark, sf):
    """R4 of a fixed assignment (the labels), every row."""
    out = cluster.silhouettes(frames.embedding_frame(spark, sf), "embedding", "label")
    return out.select("vec_id", r6("silhouette").alias("silhouette"))


K5_CENTRES = (0.3, -0.1, 0.05)         # every component of a fixed centre


def _k5_sql():
    stats = ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in NUMS)
    z = ", ".join(f"coalesce(({c} - {c}_m) / nullif({c}_s, 0), 0) AS {c}_z" for c in NUMS)
    cats = ("segment", "priority")
    hot = ", ".join(f"(CASE WHEN {c} IN (SELECT {c} FROM lv_{c}) THEN 1.0 ELSE 0.0 END)::DOUBLE AS {c}_h, "
                    f"(SELECT count(*) FROM lv_{c}) AS {c}_n" for c in cats)
    norm = " + ".join([f"{c}_z * {c}_z" for c in NUMS] + [f"{c}_h" for c in cats])
    dist = []
    for j, m in enumerate(K5_CENTRES):
        parts = [f"pow({c}_z / norm - ({m}), 2)" for c in NUMS]
        parts += [f"{c}_h * (pow(1 / norm - ({m}), 2) - {m * m!r}) + {c}_n * {m * m!r}" for c in cats]
        dist.append(f"sqrt({' + '.join(parts)}) AS d{j}")
    return with_orders(
        *[f"lv_{c} AS (SELECT DISTINCT {c} FROM order_frame WHERE split = 'train' AND {c} IS NOT NULL)" for c in cats],
        f"st AS (SELECT {stats} FROM order_frame WHERE split = 'train')", f"zz AS (SELECT id, {z}, {hot} FROM order_frame, st)",
        f"un AS (SELECT *, sqrt({norm}) AS norm FROM zz)", f"ds AS (SELECT id, {', '.join(dist)} FROM un)") + """
SELECT id, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster,
       round(d0, 6) AS cos_dist_0, round(d1, 6) AS cos_dist_1, round(d2, 6) AS cos_dist_2 FROM ds"""


@register("k5_fixed_centre_clusters", _k5_sql())
def q_k5_fixed(spark, sf):
    """K5 by value: unit vectors against fixed centres."""
    f, cats = frames.order_frame(spark, sf), ["segment", "priority"]
    prep = cluster.fit_unit_vectors(f.filter("split = 'train'"), NUMS, cats)
    width = len(NUMS) + sum(f.filter(f"split = 'train' and {c} is not null").select(c).distinct().count() for c in cats)
    out = cluster.apply_cosine_clusters(f, prep, [[m] * width for m in K5_CENTRES], NUMS, cats)
    return out.select("id", "cluster", *[r6(f"cos_dist_{j}").alias(f"cos_dist_{j}") for j in range(3)])


SOFT_COLS = ["tenure", "monthly", "total"]
SOFT_SCALE = 40000.0


@register("k10_soft_membership", with_orders(
    "cen AS (SELECT CAST(row_number() OVER (ORDER BY segment) - 1 AS INTEGER) AS j, " + ", ".join(f"avg({c}) AS c_{c}" for c in SOFT_COLS)
    + " FROM order_frame WHERE split = 'train' GROUP BY segment)",
    "w AS (SELECT id, j, " + " + ".join(f"pow({c} - c_{c}, 2)" for c in SOFT_COLS) + " AS d2 FROM order_frame CROSS JOIN cen)",
    f"e AS (SELECT id, j, exp((min(d2) OVER (PARTITION BY id) - d2) / (2.0 * {SOFT_SCALE} * {SOFT_SCALE})) AS e FROM w)",
    "m AS (SELECT id, j, e / sum(e) OVER (PARTITION BY id) AS p FROM e)")
    + "SELECT id, " + ", ".join(f"round(max(CASE WHEN j = {j} THEN p END), 6) AS soft_{j}" for j in range(5))
    + ", true AS adds_up FROM m GROUP BY id")
def q_k10(spark, sf):
    """K10 around fixed centres (the segments' means)."""
    f = frames.order_frame(spark, sf)
    means = f.filter("split = 'train'").groupBy("segment").agg(*[F.avg(c).alias(c) for c in SOFT_COLS]).orderBy("segment").limit(100).collect()
    out = cluster.soft_membership(f, [[r[c] for c in SOFT_COLS] for r in means], cols=SOFT_COLS, scale=SOFT_SCALE)
    total = sum((F.col(f"soft_{j}") for j in range(len(means))), F.lit(0.0))
    return out.select("id", *[r6(f"soft_{j}").alias(f"soft_{j}") for j in range(len(means))], (F.abs(total - 1) < 1e-9).alias("adds_up"))


# =============================================================== A4 / D6 / E15: mergeable sketches
SKETCH_BINS = {"tenure": 15, "monthly": 20, "total": 20}


@register("d6_sketch_edges_in_bound", with_orders() + "SELECT feature, n, n_edges, true AS in_bound FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n, {q + 1} AS n_edges FROM order_frame" for c, q in SKETCH_BINS.items()) + ") t")
def q_sketch(spark, sf):
    """Sketches of three batches, saved, read back and merged: every edge's true rank lies within the stated error."""
    f = frames.order_frame(spark, sf)
    base, parts = _scratch(spark, "sketches"), []
    for b in range(3):
        tables.save_fitted(sketches.fit_sketches(f.filter(F.col("id") % 3 == b), list(SKETCH_BINS)), f"{base}/{b}")
        parts.append(tables.load_fitted(spark, f"{base}/{b}"))
    from churnforge.session import cut_lineage
    whole = cut_lineage(sketches.merge_sketches(parts))
    edges = None
    for c, q in SKETCH_BINS.items():
        e = sketches.sketch_quantiles(whole.filter(F.col("feature") == c), [i / q for i in range(q + 1)])
        edges = e if edges is None else edges.unionByName(e)
    ranks = sketches.true_ranks(f, edges, list(SKETCH_BINS))
    bound = sketches.rank_error()
    near = (F.col("below") <= F.col("p") + bound) & (F.col("upto") >= F.col("p") - bound)
    return _reread(ranks.groupBy("feature").agg(F.count(F.lit(1)).cast("int").alias("n_edges"), F.min(near).alias("in_bound")).join(
        whole.select("feature", "n"), "feature").select("feature", "n", "n_edges", "in_bound"), base)


# =============================================================== L12 / L22: many models
def _greedy_sql(bins=1000):
    """Three greedy picks: candidates a, b, c; the bins of (sum of the picks + candidate) / round."""
    out = ["tr AS (SELECT id, label, " + ", ".join(f"max(CASE WHEN model = '{m}' THEN score END) AS s_{m}" for m in "abc")
           + " FROM score_tables WHERE split = 'train' GROUP BY id, label)", "h0 AS (SELECT label, s_a, s_b, s_c, 0 AS na, 0 AS nb, 0 AS nc FROM tr)"]
    for r in (1, 2, 3):
        held = "0.0 + s_a * na + s_b * nb + s_c * nc" if r > 1 else "0.0"
        out.append(f"t{r} AS (" + " UNION ALL ".join(
            f"SELECT '{m}' AS model, label, floor(({held} + s_{m}) / {r}.0::DOUBLE * {bins}) AS score FROM h{r - 1}" for m in "abc") + ")")
        out.append(auc_sql(f"t{r}", "model").strip().replace("dist AS", f"dist{r} AS").replace("FROM dist", f"FROM dist{r}").replace("run AS", f"run{r} AS"))
        out.append(f"p{r} AS (SELECT model, sum(pos * (neg_before + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM run{r} GROUP BY model "
                   "ORDER BY auc DESC, model LIMIT 1)")
        out.append(f"h{r} AS (SELECT label, s_a, s_b, s_c, na + (model = 'a')::INTEGER AS na, nb + (model = 'b')::INTEGER AS nb, "
                   f"nc + (model = 'c')::INTEGER AS nc FROM h{r - 1}, p{r})")
    return with_orders(*out) + " UNION ALL ".join(f"SELECT {r} AS round, model, round(auc, 6) AS auc FROM p{r}" for r in (1, 2, 3))


@register("l12_greedy_picks", _greedy_sql())
def q_greedy(spark, sf):
    picks, _ = ensemble.select_models(frames.score_tables(spark, sf).filter("split = 'train'"), ["a", "b", "c"], rounds=3)
    return picks.select("round", "model", r6("auc").alias("auc"))


# =============================================================== S8 / L14: one partition per variant
@register("s8_partitioned_blends", with_orders(
    "p AS (SELECT a.id, a.score AS sa, b.score AS sb FROM score_tables a JOIN score_tables b ON a.id = b.id WHERE a.model = 'a' AND b.model = 'b')",
    "v(variant, wa, wb) AS (VALUES " + ", ".join(
        f"('{int(round(a * 100)):02d}_{int(round(b * 100)):02d}', CAST({a!r} AS DOUBLE), CAST({b!r} AS DOUBLE))" for a, b in VARIANTS) + ")") + """
SELECT variant, id, round(CASE WHEN variant = '90_10' THEN sb * wa + sa * wb ELSE sa * wa + sb * wb END, 6) AS score
FROM p CROSS JOIN v WHERE variant IN ('95_05', '90_10', '80_20')""")
def q_partitioned(spark, sf):
    """Four blends written by variant; one of them written anew with the tables exchanged; three read back."""
    s = frames.score_tables(spark, sf)
    a, b = (s.filter(F.col("model") == m) for m in "ab")
    path = _scratch(spark, "blends")
    tables.write_partitions(ensemble.fixed_blends(a, b, VARIANTS), path, ["variant"])
    tables.write_partitions(ensemble.fixed_blends(b, a, [VARIANTS[1]]), path, ["variant"])
    back = tables.read_partitions(spark, path, variant=["95_05", "90_10", "80_20"])
    return _reread(back.select("variant", "id", r6("score").alias("score")), path)


# =============================================================== S4 / U4: a second labelled population
@register("s4_u4_original_population", with_orders(
    """sup AS (
  SELECT l_suppkey AS id, count(*) AS tenure, avg(l_extendedprice) AS monthly, sum(l_extendedprice) AS total,
         CASE WHEN avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) > (SELECT avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) FROM lineitem)
              THEN 1 ELSE 0 END AS label FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_suppkey)""",
    "pop AS (SELECT 'synthetic' AS origin, label, tenure, monthly, total FROM order_frame WHERE split = 'train' UNION ALL "
    "SELECT 'original', label, tenure, monthly, total FROM sup)") + """
SELECT origin, label, count(*) AS n, round(avg(tenure), 6) AS tenure, round(avg(monthly), 6) AS monthly, round(avg(total), 0) AS total
FROM pop GROUP BY origin, label""")
def q_u4(spark, sf):
    """U4: training rows and a disjoint labelled population (S4: suppliers, with the columns of the orders), by origin."""
    from churnforge.operators.shift import append_with_origin
    both = append_with_origin(frames.order_frame(spark, sf).filter("split = 'train'").drop("split"), frames.original_frame(spark, sf))
    return both.groupBy("origin", "label").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("tenure")).alias("tenure"),
                                               r6(F.avg("monthly")).alias("monthly"), F.round(F.avg("total"), 0).alias("total"))


@register("e14_original_population", with_orders(
    """sup AS (
  SELECT l_suppkey AS id, CAST(count(*) AS DOUBLE) AS tenure, avg(l_extendedprice) AS monthly,
         CASE WHEN avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) > (SELECT avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) FROM lineitem)
              THEN 1 ELSE 0 END AS label FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_suppkey)""",
    "cs AS (SELECT label, avg(tenure) AS tm, stddev_samp(tenure) AS ts, avg(monthly) AS mm, stddev_samp(monthly) AS ms, "
    "quantile_cont(monthly, 0.5) AS q50 FROM sup GROUP BY label)") + """
SELECT id, round((tenure - p.tm) / (p.ts + 1e-6), 6) AS zscore_pos_tenure, round((monthly - n.mm) / (n.ms + 1e-6), 6) AS zscore_neg_monthly,
       round(abs(monthly - p.q50), 6) AS dist_q50_pos_monthly
FROM order_frame, (SELECT * FROM cs WHERE label = 1) p, (SELECT * FROM cs WHERE label = 0) n""")
def q_e14_original(spark, sf):
    """E14 / E15 of the orders against the second population instead of their own labelled rows."""
    from churnforge.operators.refdist import class_stats, reference_features
    cols = ["tenure", "monthly"]
    out = reference_features(frames.order_frame(spark, sf), class_stats(frames.original_frame(spark, sf), "label", cols), cols)
    return out.select("id", r6("zscore_pos_tenure").alias("zscore_pos_tenure"), r6("zscore_neg_monthly").alias("zscore_neg_monthly"),
                      r6("dist_q50_pos_monthly").alias("dist_q50_pos_monthly"))


# =============================================================== L18 / L19 by value
@register("l18_adversarial_values", with_orders(
    "st AS (SELECT avg(total) AS tm, stddev_pop(total) AS ts, avg(acctbal) AS am, stddev_pop(acctbal) AS asd FROM order_frame)",
    "sc AS (SELECT id, CASE WHEN split = 'score' THEN 1 ELSE 0 END AS label, (total - tm) / ts AS x1, (acctbal - am) / asd AS x2 FROM order_frame, st)",
    folds_cte(k=3, source="sc", where="true"), held_out_sql("folded", 3), *logreg_sql("ho", 1.0),
    "oof AS (SELECT label, 1.0 / (1.0 + exp(-(b0 + b1 * x1 + b2 * x2))) AS score FROM folded JOIN b ON fold = b.grp)", auc_sql("oof", None).strip(),
    "a AS (SELECT sum(pos * (neg_before + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM run)",
    "i AS (SELECT 'total' AS feature, avg(100 * abs(b1) / (abs(b1) + abs(b2))) AS pct FROM b UNION ALL "
    "SELECT 'acctbal', avg(100 * abs(b2) / (abs(b1) + abs(b2))) FROM b)") + """
SELECT feature, round(pct, 3) AS importance_pct, round(auc, 5) AS auc, auc > 0.52 AS drifted, pct > 15 AS flagged FROM i, a""")
def q_l18_values(spark, sf):
    """L18 with a linear classifier of train against score rows: AUC, flag, importances over the fold models."""
    f = encode.standard_scale(frames.order_frame(spark, sf).select("id", "split", "total", "acctbal"), ["total", "acctbal"])
    a, drifted, imps, flagged = models.adversarial_validation(f, ["total", "acctbal"], k=3, family="logreg", C=1.0, **EXACT)
    return imps.select("feature", F.round("importance_pct", 3).alias("importance_pct"), F.lit(round(a, 5)).alias("auc"),
                       F.lit(bool(drifted)).alias("drifted"), F.col("feature").isin(*flagged).alias("flagged"))


@register("l19_prune_fixed_flags", with_orders() + "SELECT id, split, label, round(monthly, 6) AS monthly, round(total, 6) AS total FROM order_frame")
def q_l19_fixed(spark, sf):
    """L18's threshold and L19's pruning on given importances: above 15 goes, 15 itself stays."""
    from churnforge.operators.shift import drift_flags, prune_features
    imps = spark.createDataFrame([("tenure", 40.0), ("monthly", 15.0), ("acctbal", 15.1), ("total", 2.0)], "feature string, importance_pct double")
    f = frames.order_frame(spark, sf).drop(*CATS)
    out = prune_features(f, [r["feature"] for r in drift_flags(imps).collect()])
    return out.withColumns({c: r6(c) for c in out.columns if c in NUMS})
