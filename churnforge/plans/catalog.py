"""Registered queries: one per operator of the inventory, each with (where SQL can state it)
an independent DuckDB oracle over the same driver tables.

Every query reads whole tables (order_frame covers every order; doc_frame every document;
embedding_frame every vector). Doubles are rounded to 6 places on both sides so the
order-insensitive value hash compares values, not last-bit summation order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnforge.functions import clean
from churnforge.functions import features as fe
from churnforge.operators import encode, folds, metrics
from churnforge.plans import frames
from churnforge.plans.oracle import folds_cte, num, with_orders
from churnforge.plans.registry import REGISTRY, r6, register

def _orders(spark, sf, fill=0.0):
    return frames.order_frame(spark, sf, fill)


CATS = ["priority", "segment", "nation", "flag"]
NUMS = ["tenure", "monthly", "total"]


# =============================================================== 2.2 cleaning
@register("p1_label_default0", with_orders() + """
SELECT id, CASE WHEN churn_text IN ('Yes', 'True', '1') THEN 1 ELSE 0 END AS label FROM raw_orders""")
def q_p1(spark: SparkSession, sf: str) -> DataFrame:
    raw = frames.raw_order_frame(spark, sf)
    return raw.select("id", clean.label_default0("churn_text").alias("label"))


@register("p2_label_strict", with_orders() + """
SELECT id, CAST(CASE WHEN churn_text = 'Yes' THEN 1 WHEN churn_text = 'No' THEN 0 END AS DOUBLE) AS label FROM raw_orders""")
def q_p2(spark, sf):
    # nullable label reported as double so null survives any pandas round trip unchanged
    raw = frames.raw_order_frame(spark, sf)
    return raw.select("id", clean.label_strict("churn_text").cast("double").alias("label"))


@register("p4_numeric_coerce", with_orders() + f"""
SELECT id, round({num('tenure_txt')}, 6) AS tenure, round({num('monthly_txt')}, 6) AS monthly,
       round({num('total_txt')}, 6) AS total FROM raw_orders""")
def q_p4(spark, sf):
    raw = frames.raw_order_frame(spark, sf)
    return raw.select("id", *[r6(clean.to_number(f"{c}_txt")).alias(c) for c in NUMS])


@register("p5_numeric_fill0", with_orders() + """
SELECT id, round(tenure, 6) AS tenure, round(monthly, 6) AS monthly, round(total, 6) AS total FROM order_frame""")
def q_p5(spark, sf):
    raw = frames.raw_order_frame(spark, sf)
    return raw.select("id", *[r6(clean.to_number(f"{c}_txt", 0.0)).alias(c) for c in NUMS])


@register("p6_fill_missing", with_orders() + """
SELECT id, coalesce(priority, 'Missing') AS priority, coalesce(segment, 'Missing') AS segment,
       coalesce(nation, 'Missing') AS nation, coalesce(flag, 'Missing') AS flag FROM order_frame""")
def q_p6(spark, sf):
    f = _orders(spark, sf)
    return clean.clean_frame(f.select("id", *CATS), categorical=CATS)


@register("p7_drop_null_rows", with_orders("kept AS (SELECT id, " + num("monthly_txt") + " AS monthly, "
                                           + num("total_txt") + " AS total FROM raw_orders)") + """
SELECT id, round(monthly, 6) AS monthly, round(total, 6) AS total FROM kept
WHERE monthly IS NOT NULL AND total IS NOT NULL""")
def q_p7(spark, sf):
    raw = frames.raw_order_frame(spark, sf)
    f = raw.select("id", clean.to_number("monthly_txt").alias("monthly"), clean.to_number("total_txt").alias("total"))
    kept = clean.drop_null_rows(f, ["monthly", "total", "not_a_column"])
    return kept.select("id", r6("monthly").alias("monthly"), r6("total").alias("total"))


@register("p8_drop_null_label", with_orders() + """
SELECT id, label FROM (SELECT id, CAST(CASE WHEN churn_text = 'Yes' THEN 1 WHEN churn_text = 'No' THEN 0 END AS INTEGER) AS label
FROM raw_orders) t WHERE label IS NOT NULL""")
def q_p8(spark, sf):
    raw = frames.raw_order_frame(spark, sf)
    return clean.drop_null_label(raw.select("id", clean.label_strict("churn_text").alias("label")), "label")


@register("p11_split_back", with_orders() + """
SELECT split, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_pos FROM order_frame GROUP BY split""")
def q_p11(spark, sf):
    f = _orders(spark, sf)
    parts = [clean.split_back(f, "split", tag).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("label").cast("long").alias("n_pos")) for tag in ("train", "score")]
    return parts[0].unionByName(parts[1])


#: score_tables with a null for every 13th id and NaN for every 17th, in both dialects.
HOLED_SQL = ("holed AS (SELECT model, id, split, label, CASE WHEN id % 13 = 0 THEN NULL WHEN id % 17 = 0 THEN CAST('nan' AS DOUBLE) "
             "ELSE score END AS score FROM score_tables)")


def _holed(spark, sf):
    k = F.col("id")
    return frames.score_tables(spark, sf).withColumn("score", F.when(k % 13 == 0, F.lit(None)).when(
        k % 17 == 0, F.lit(float("nan"))).otherwise(F.col("score")))


@register("p15_clip", with_orders(HOLED_SQL) + """
SELECT model, id, CASE WHEN isnan(score) THEN NULL WHEN score > 0.6 THEN 0.6 WHEN score < 0.2 THEN 0.2 ELSE score END AS score
FROM holed""")
def q_p15(spark, sf):
    return _holed(spark, sf).select("model", "id", clean.clip("score", 0.2, 0.6).alias("score"))


# =============================================================== 2.3 features
@register("e1_e6_residual_features", with_orders() + """
SELECT id,
  round(total - monthly * tenure, 6) AS charge_residual,
  CAST(sign(total - monthly * tenure) AS DOUBLE) AS charge_residual_sign,
  round((total - monthly * tenure) / nullif(monthly * tenure + 1.0, 0.0), 6) AS charge_residual_relative,
  round(monthly / nullif(total + 1.0, 0.0), 6) AS monthly_over_total,
  round(tenure / nullif(monthly + 1.0, 0.0), 6) AS tenure_over_monthly
FROM order_frame""")
def q_e1(spark, sf):
    f = _orders(spark, sf)
    feats = fe.residual_features("total", "monthly", "tenure")
    return f.select("id", *[(r6(v) if k != "charge_residual_sign" else v).alias(k) for k, v in feats.items()])


@register("e3_sign_text", with_orders() + """
SELECT id, CAST(CAST(sign(total - monthly * tenure) AS DOUBLE) AS VARCHAR) AS charge_residual_sign FROM order_frame""")
def q_e3(spark, sf):
    f = _orders(spark, sf)
    return f.select("id", fe.residual_sign_text("total", "monthly", "tenure").alias("charge_residual_sign"))


@register("e7_surcharge", with_orders() + """
SELECT id, round(total - tenure * monthly, 6) AS surcharge FROM order_frame""")
def q_e7(spark, sf):
    f = _orders(spark, sf)
    return f.select("id", r6(fe.charge_residual("total", "monthly", "tenure")).alias("surcharge"))


@register("e8_cross_propagate", with_orders() + """
SELECT id, coalesce(priority || '_' || segment, 'Missing') AS priority_segment FROM order_frame""")
def q_e8(spark, sf):
    f = _orders(spark, sf)
    return f.select("id", fe.cross("priority", "segment", null_rule="propagate").alias("priority_segment"))


LISTED_PAIRS = [("priority", "segment"), ("segment", "nation"), ("nation", "flag"), ("priority", "flag")]


@register("e9_listed_pairs", with_orders() + "SELECT id, " + ", ".join(
    f"coalesce({a} || '_' || {b}, 'Missing') AS {a}_{b}" for a, b in LISTED_PAIRS) + " FROM order_frame")
def q_e9(spark, sf):
    return _orders(spark, sf).select("id", *[v.alias(n) for n, v in fe.listed_crosses(LISTED_PAIRS).items()])


@register("e10_triple_cross", with_orders() + """
SELECT id, coalesce(priority || '_' || segment || '_' || flag, 'Missing') AS triple FROM order_frame""")
def q_e10(spark, sf):
    f = _orders(spark, sf)
    return f.select("id", fe.cross("priority", "segment", "flag").alias("triple"))


@register("e12_ngram_text_nulls", with_orders() + """
SELECT id, coalesce(priority, 'nan') || '_' || coalesce(segment, 'nan') || '_' || coalesce(flag, 'nan') AS ngram
FROM order_frame""")
def q_e12(spark, sf):
    f = _orders(spark, sf)
    return f.select("id", fe.cross("priority", "segment", "flag", null_rule="text").alias("ngram"))


def _pairs_sql():
    cols = CATS
    out = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            out.append(f"coalesce({a}, 'Missing') || '_X_' || coalesce({b}, 'Missing') AS PAIR_{a}_x_{b}")
    return ",\n  ".join(out)


@register("e9_e11_all_pair_crosses", with_orders() + f"""
SELECT id,
  {_pairs_sql()}
FROM order_frame""")
def q_e11(spark, sf):
    f = _orders(spark, sf)
    return f.select("id", *[v.alias(k) for k, v in fe.all_pair_crosses(CATS).items()])


@register("e13_count_equal", with_orders() + """
SELECT id, (CASE WHEN flag = 'A' THEN 1 ELSE 0 END) + (CASE WHEN priority = '1-URGENT' THEN 1 ELSE 0 END)
  + (CASE WHEN segment = '1-URGENT' THEN 1 ELSE 0 END) AS n_urgent_or_a FROM order_frame""")
def q_e13(spark, sf):
    f = _orders(spark, sf)
    a = fe.count_equal(["flag"], "A")
    u = fe.count_equal(["priority", "segment"], "1-URGENT")
    return f.select("id", (a + u).alias("n_urgent_or_a"))


@register("e16_e18_report_features", with_orders() + """
SELECT id,
  round(total / nullif(tenure + 1.0, 0.0), 6) AS avg_charge_per_tenure,
  round(monthly * tenure, 6) AS expected_total_charges,
  round(total - monthly * tenure, 6) AS charge_discrepancy,
  round((total - monthly * tenure) / nullif(monthly * tenure + 1.0, 0.0), 6) AS pct_discrepancy,
  (CASE WHEN flag = 'R' THEN 1 ELSE 0 END) + (CASE WHEN flag = 'A' THEN 1 ELSE 0 END) AS num_services,
  round(monthly / nullif(((CASE WHEN flag = 'R' THEN 1 ELSE 0 END) + (CASE WHEN flag = 'A' THEN 1 ELSE 0 END)) + 1.0, 0.0), 6) AS monthly_per_service,
  CAST(coalesce(flag = 'R', false) AND coalesce(segment = 'BUILDING', false) AS INTEGER) AS is_family,
  CAST(coalesce(priority = '1-URGENT', false) AND NOT coalesce(flag = 'R', false) AND NOT coalesce(segment = 'BUILDING', false) AS INTEGER) AS is_vulnerable
FROM order_frame""")
def q_e16(spark, sf):
    f = _orders(spark, sf).withColumn("svc_r", F.when(F.col("flag") == "R", "Yes").otherwise("No")) \
        .withColumn("svc_a", F.when(F.col("flag") == "A", "Yes").otherwise("No")) \
        .withColumn("partner", F.when(F.col("flag") == "R", "Yes").otherwise("No")) \
        .withColumn("dependents", F.when(F.col("segment") == "BUILDING", "Yes").otherwise("No")) \
        .withColumn("senior", F.when(F.col("priority") == "1-URGENT", "1").otherwise("0"))
    rep = fe.report_features("total", "monthly", "tenure")
    svc = fe.service_features(["svc_r", "svc_a"], "monthly")
    hh = fe.household_flags("partner", "dependents", "senior")
    cols = [r6(v).alias(k) for k, v in rep.items()]
    cols += [svc["num_services"].alias("num_services"), r6(svc["monthly_per_service"]).alias("monthly_per_service")]
    cols += [v.alias(k) for k, v in hh.items()]
    return f.select("id", *cols)


# =============================================================== 2.8 folds, ranks; 2.11 metrics
@register("w3_stratified_folds", with_orders(folds_cte(k=10)) + """
SELECT id, label, fold FROM folded""")
def q_w3(spark, sf):
    f = _orders(spark, sf).filter(F.col("split") == "train").select("id", "label")
    return folds.stratified_folds(f, "id", "label", k=10, seed=42)


@register("m1_holdout", with_orders(folds_cte(k=5)) + """
SELECT id, CASE WHEN fold = 0 THEN 'valid' ELSE 'fit' END AS holdout FROM folded""")
def q_m1(spark, sf):
    f = _orders(spark, sf).filter(F.col("split") == "train").select("id", "label")
    return folds.holdout(f, "id", "label").select("id", "holdout")


@register("m2_sample_rows", with_orders() + """
SELECT id FROM order_frame ORDER BY md5(CAST(id AS VARCHAR) || '|7'), id LIMIT 1000""")
def q_m2(spark, sf):
    f = _orders(spark, sf).select("id")
    return folds.sample_rows(f, "id", 1000, seed=7)


AUC_SQL = """
dist AS (
  SELECT {g} score, sum(label) AS pos, sum(1 - label) AS neg FROM {src} GROUP BY {g} score
),
run AS (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY {p} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_before
  FROM dist
)"""


def auc_sql(src: str, group: str | None) -> str:
    g = f"{group}, " if group else ""
    p = group if group else "1"
    return AUC_SQL.format(g=g, src=src, p=p)


@register("r1_r3_auc_per_model", with_orders(auc_sql("(SELECT * FROM score_tables WHERE split = 'train')", "model")) + """
SELECT model, round(sum(pos * (neg_before + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc,
       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg
FROM run GROUP BY model""")
def q_r1(spark, sf):
    s = frames.score_tables(spark, sf).filter(F.col("split") == "train")
    a = metrics.auc(s, "label", "score", ["model"])
    return a.select("model", r6("auc").alias("auc"), F.col("n_pos").cast("long"), F.col("n_neg").cast("long"))


@register("r2_auc_per_fold", with_orders(folds_cte(k=5),
                                         "fs AS (SELECT f.fold, s.label, s.score FROM folded f JOIN score_tables s "
                                         "ON f.id = s.id WHERE s.model = 'a')",
                                         auc_sql("fs", "fold").strip()) + """
SELECT fold, round(sum(pos * (neg_before + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc FROM run GROUP BY fold""")
def q_r2(spark, sf):
    s = frames.score_tables(spark, sf).filter((F.col("split") == "train") & (F.col("model") == "a"))
    fo = folds.stratified_folds(s.select("id", "label", "score"), "id", "label", k=5)
    return metrics.auc(fo, "label", "score", ["fold"]).select("fold", r6("auc").alias("auc"))


@register("r5_drift_auc", with_orders(
    "drift AS (SELECT CASE WHEN split = 'score' THEN 1 ELSE 0 END AS label, total AS score FROM order_frame)",
    auc_sql("drift", None).strip()) + """
SELECT round(sum(pos * (neg_before + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc FROM run""")
def q_r5(spark, sf):
    f = _orders(spark, sf).select((F.col("split") == "score").cast("int").alias("is_score"), "total")
    return metrics.auc(f, "is_score", "total").select(r6("auc").alias("auc"))


RANK_SQL = """
ranked AS (
  SELECT model, id, score,
    (rank() OVER (PARTITION BY model ORDER BY score) - 1) + (count(*) OVER (PARTITION BY model, score) + 1) / 2.0 AS avg_rank,
    count(*) OVER (PARTITION BY model) AS n
  FROM score_tables
)"""


@register("w1_average_rank", with_orders(RANK_SQL) + """
SELECT model, id, round(avg_rank / n, 6) AS rank_pct FROM ranked""")
def q_w1(spark, sf):
    s = frames.score_tables(spark, sf)
    return metrics.average_rank(s, "score", ["model"]).select("model", "id", r6("rank_pct").alias("rank_pct"))


@register("w2_rank_power", with_orders(RANK_SQL) + """
SELECT model, id, round(pow(avg_rank / n, 2.5), 6) AS rank_pow FROM ranked""")
def q_w2(spark, sf):
    s = frames.score_tables(spark, sf)
    r = metrics.average_rank(s, "score", ["model"], out="rank_pow", power=2.5)
    return r.select("model", "id", r6("rank_pow").alias("rank_pow"))


# =============================================================== 2.4 encoders
def _train_filled(spark, sf):
    f = _orders(spark, sf)
    return clean.clean_frame(f, categorical=CATS).filter(F.col("split") == "train")


def _filled_sql(src="order_frame", where="split = 'train'"):
    cats = ", ".join(f"coalesce({c}, 'Missing') AS {c}" for c in CATS)
    return f"SELECT id, label, split, tenure, monthly, total, acctbal, {cats} FROM {src} WHERE {where}"


def _long_sql(src: str, keep: str) -> str:
    return "\n  UNION ALL ".join(f"SELECT {keep}, '{c}' AS feature, {c} AS key FROM {src}" for c in CATS)


@register("d2_standard_scale", with_orders(
    "st AS (SELECT " + ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in NUMS)
    + " FROM order_frame WHERE split = 'train')") + "SELECT id, " + ", ".join(
    f"round(coalesce(({c} - {c}_m) / nullif({c}_s, 0.0), 0.0), 6) AS {c}_z" for c in NUMS)
    + " FROM order_frame, st")
def q_d2(spark, sf):
    f = _orders(spark, sf)
    out = encode.standard_scale(f, NUMS, fit_df=f.filter(F.col("split") == "train"), suffix="_z")
    return out.select("id", *[r6(f"{c}_z").alias(f"{c}_z") for c in NUMS])


ORD_SQL = with_orders(
    "lf AS (" + _long_sql("order_frame WHERE split = 'train'", "id") + ")",
    "codes AS (SELECT feature, key, CAST(row_number() OVER (PARTITION BY feature ORDER BY key) - 1 AS INTEGER) AS code "
    "FROM (SELECT DISTINCT feature, key FROM lf WHERE key IS NOT NULL) d)") + "SELECT o.id, " + ", ".join(
    f"coalesce((SELECT code FROM codes WHERE feature = '{c}' AND key = o.{c}), -1) AS {c}_ord" for c in CATS) \
    + " FROM order_frame o"


@register("d3_ordinal_encode", ORD_SQL)
def q_d3(spark, sf):
    f = _orders(spark, sf)
    fitted = encode.fit_ordinal(f.filter(F.col("split") == "train"), CATS)
    return encode.apply_ordinal(f, fitted, CATS).select("id", *[f"{c}_ord" for c in CATS])


@register("d4_one_hot_slot", ORD_SQL.replace(") AS priority_ord", ") AS priority_slot").replace(") AS segment_ord", ") AS segment_slot").replace(") AS nation_ord", ") AS nation_slot").replace(") AS flag_ord", ") AS flag_slot"))
def q_d4(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    f = _orders(spark, sf)
    model = Pipeline(stages=encode.one_hot_stages(CATS)).fit(f.filter(F.col("split") == "train"))
    out = model.transform(f)
    # position of the single 1.0 in each one-hot vector; all zeros (unseen / null) -> -1
    return out.select("id", *[(F.array_position(vector_to_array(f"{c}_ohe"), 1.0) - 1).cast("int").alias(f"{c}_slot")
                              for c in CATS])


@register("d5_l2_normalize", with_orders() + "SELECT id, " + ", ".join(
    f"round(coalesce({c} / nullif(sqrt(tenure * tenure + monthly * monthly + total * total), 0.0), 0.0), 6) AS {c}_l2"
    for c in NUMS) + " FROM order_frame")
def q_d5(spark, sf):
    f = _orders(spark, sf)
    return f.select("id", *[r6(v).alias(f"{k}_l2") for k, v in encode.l2_normalize(NUMS).items()])


BINS = {"tenure": 15, "monthly": 20, "total": 20}


def _plist(q):
    return "[" + ", ".join(f"CAST({i / q!r} AS DOUBLE)" for i in range(q + 1)) + "]"


@register("d6_quantile_bins", with_orders(
    "e AS (SELECT " + ", ".join(f"list_sort(list_distinct(quantile_cont({c}, {_plist(q)}))) AS {c}_e"
                                for c, q in BINS.items()) + " FROM order_frame)") + "SELECT id, " + ", ".join(
    f"CASE WHEN len({c}_e) >= 2 AND {c} >= {c}_e[1] AND {c} <= {c}_e[len({c}_e)] "
    f"THEN CAST(greatest(len(list_filter({c}_e, lambda x: x < {c})) - 1, 0) AS INTEGER) END AS {c}_bin"
    for c in BINS) + " FROM order_frame, e")
def q_d6(spark, sf):
    from churnforge.session import cut_lineage
    f = cut_lineage(_orders(spark, sf).select("id", *BINS))     # fit and apply read it
    fitted = encode.fit_quantile_bins_multi(f, BINS)  # all columns in one pass
    out = encode.apply_quantile_bins_multi(f, fitted, list(BINS))
    return out.select("id", *[f"{c}_bin" for c in BINS])


def te_map_sql(k=5, smoothing=20.0, msl=20.0):
    return [
        folds_cte(k=k),
        "tr AS (" + _filled_sql("folded", "true").replace("SELECT id, label,", "SELECT id, label, fold,") + ")",
        "lf AS (" + _long_sql("tr", "fold, label") + ")",
        "per_fold AS (SELECT feature, key, fold, count(*) AS n_f, sum(CAST(label AS DOUBLE)) AS s_f FROM lf GROUP BY feature, key, fold)",
        "totals AS (SELECT feature, key, sum(n_f) AS n_all, sum(s_f) AS s_all FROM per_fold GROUP BY feature, key)",
        "fstats AS (SELECT fold, count(*) AS rows_f, sum(CAST(label AS DOUBLE)) AS pos_f FROM tr GROUP BY fold)",
        "priors AS (SELECT fold, (sum(pos_f) OVER () - pos_f) / (sum(rows_f) OVER () - rows_f) AS prior FROM fstats)",
        "m AS (SELECT p.fold, t.feature, t.key, CAST(t.n_all - coalesce(pf.n_f, 0) AS BIGINT) AS n, "
        "t.s_all - coalesce(pf.s_f, 0.0) AS s, p.prior FROM totals t CROSS JOIN priors p "
        "LEFT JOIN per_fold pf ON pf.feature = t.feature AND pf.key = t.key AND pf.fold = p.fold)",
        f"te AS (SELECT fold, feature, key, n, prior, CASE WHEN n > 0 THEN prior * (1.0 - w) + (s / n) * w ELSE prior END AS enc "
        f"FROM (SELECT *, 1.0 / (1.0 + exp(-(n - {msl}) / {smoothing})) AS w FROM m) z)",
    ]


def _te_folds(spark, sf, k=5):
    tr = _train_filled(spark, sf)
    fo = folds.stratified_folds(tr, "id", "label", k=k)
    return fo, encode.fit_fold_target_encoder(fo, CATS, "label", "fold", k, smoothing=20.0, min_samples_leaf=20.0)


@register("d7_te_fold_map", with_orders(*te_map_sql()) + """
SELECT fold, feature, key, n, round(enc, 6) AS enc FROM te""")
def q_d7_map(spark, sf):
    _fo, m = _te_folds(spark, sf)
    return m.select(F.col("fold").cast("int"), "feature", "key", F.col("n").cast("long"), r6("enc").alias("enc"))


@register("d7_te_oof", with_orders(*te_map_sql(), "rows AS (" + _long_sql("tr", "id, fold") + ")") + """
SELECT r.id, r.feature, round(te.enc, 6) AS enc FROM rows r
LEFT JOIN te ON te.fold = r.fold AND te.feature = r.feature AND te.key = r.key""")
def q_d7_oof(spark, sf):
    fo, m = _te_folds(spark, sf)
    return encode.oof_target_encoding(fo, m, "id", "fold", CATS).select("id", "feature", r6("enc").alias("enc"))


@register("d7_te_apply_score", with_orders(
    "tr AS (" + _filled_sql() + ")",
    "sc AS (" + _filled_sql(where="split = 'score'") + ")",
    "lf AS (" + _long_sql("tr", "label") + ")",
    "pr AS (SELECT avg(CAST(label AS DOUBLE)) AS prior FROM tr)",
    "st AS (SELECT feature, key, count(*) AS n, sum(CAST(label AS DOUBLE)) AS s FROM lf GROUP BY feature, key)",
    "te AS (SELECT feature, key, prior * (1.0 - w) + (s / n) * w AS enc FROM "
    "(SELECT st.*, pr.prior, 1.0 / (1.0 + exp(-(n - 20.0) / 10.0)) AS w FROM st, pr) z)") + "SELECT sc.id, " + ", ".join(
    f"round(coalesce((SELECT enc FROM te WHERE feature = '{c}' AND key = sc.{c}), (SELECT prior FROM pr)), 6) AS {c}_te"
    for c in CATS) + " FROM sc")
def q_d7_apply(spark, sf):
    f = clean.clean_frame(_orders(spark, sf), categorical=CATS)
    fitted = encode.fit_target_encoder(f.filter(F.col("split") == "train"), CATS, "label", smoothing=10.0,
                                       min_samples_leaf=20.0)
    out = encode.apply_target_encoding(f.filter(F.col("split") == "score"), fitted, CATS)
    return out.select("id", *[r6(f"{c}_te").alias(f"{c}_te") for c in CATS])


@register("d9_ordered_te", with_orders(
    "tr AS (" + _filled_sql() + ")",
    "lf AS (" + _long_sql("tr", "id, label, md5(CAST(id AS VARCHAR) || '|42') AS perm") + ")",
    "pr AS (SELECT avg(CAST(label AS DOUBLE)) AS prior FROM tr)") + """
SELECT id, feature, round((coalesce(sum(CAST(label AS DOUBLE)) OVER w, 0.0) + 1.0 * prior)
                          / (coalesce(count(*) OVER w, 0) + 1.0), 6) AS enc
FROM lf, pr
WINDOW w AS (PARTITION BY feature, key ORDER BY perm, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def q_d9(spark, sf):
    tr = _train_filled(spark, sf)
    return encode.ordered_target_encoding(tr, CATS, "label", "id", a=1.0, seed=42) \
        .select("id", "feature", r6("enc").alias("enc"))


@register("d10_count_encoding", with_orders(
    "lf AS (" + _long_sql("order_frame", "id") + ")",
    "cnt AS (SELECT feature, key, count(*) AS n FROM lf WHERE key IS NOT NULL GROUP BY feature, key)") + "SELECT o.id, " + ", ".join(
    f"coalesce((SELECT n FROM cnt WHERE feature = '{c}' AND key = o.{c}), 0) AS {c}_freq" for c in CATS)
    + " FROM order_frame o")
def q_d10(spark, sf):
    f = _orders(spark, sf)
    fitted = encode.fit_count_encoder(f, CATS)
    out = encode.apply_count_encoding(f, fitted, CATS)
    return out.select("id", *[F.col(f"{c}_freq").cast("long").alias(f"{c}_freq") for c in CATS])


NGRAM_SQL = "coalesce(priority, 'nan') || '_' || coalesce(segment, 'nan') || '_' || coalesce(flag, 'nan')"


@register("d11_group_mean_lookup", with_orders(
    f"gm AS (SELECT {NGRAM_SQL} AS k, avg(CAST(label AS DOUBLE)) AS mean FROM order_frame WHERE split = 'train' GROUP BY k)") + f"""
SELECT o.id, round(coalesce(gm.mean, 0.0), 6) AS ngram_rate FROM order_frame o LEFT JOIN gm ON gm.k = {NGRAM_SQL}""")
def q_d11(spark, sf):
    f = _orders(spark, sf)
    key = fe.cross("priority", "segment", "flag", null_rule="text")
    fitted = encode.fit_group_mean(f.filter(F.col("split") == "train"), key, "label")
    out = encode.apply_group_mean(f, fitted, key, "ngram_rate", default=0.0)
    return out.select("id", r6("ngram_rate").alias("ngram_rate"))


@register("d13_class_weight", with_orders(
    "r AS (SELECT CAST(sum(1 - label) AS DOUBLE) / sum(label) AS ratio FROM order_frame WHERE split = 'train')") + """
SELECT id, round(CASE WHEN label = 1 THEN ratio ELSE 1.0 END, 6) AS weight FROM order_frame, r WHERE split = 'train'""")
def q_d13(spark, sf):
    tr = _orders(spark, sf).filter(F.col("split") == "train")
    return encode.class_weight(tr, "label").select("id", r6("weight").alias("weight"))


# =============================================================== reference population
REF_COLS = ["tenure", "monthly", "total"]


def _ref_sql():
    long = "\n  UNION ALL ".join(
        f"SELECT label AS class, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM order_frame WHERE split = 'train'"
        for c in REF_COLS)
    return [f"rl AS ({long})",
            "cs AS (SELECT class, feature, avg(x) AS mean, stddev_samp(x) AS std, quantile_cont(x, 0.25) AS q25, "
            "quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75 FROM rl GROUP BY class, feature)"]


@register("a3_a4_class_stats", with_orders(*_ref_sql()) + """
SELECT class, feature, round(mean, 6) AS mean, round(std, 6) AS std, round(q25, 6) AS q25,
       round(q50, 6) AS q50, round(q75, 6) AS q75 FROM cs""")
def q_a3(spark, sf):
    ref = _orders(spark, sf).filter(F.col("split") == "train")
    from churnforge.operators.refdist import class_stats
    st = class_stats(ref, "label", REF_COLS)
    return st.select("class", "feature", *[r6(c).alias(c) for c in ("mean", "std", "q25", "q50", "q75")])


def _ref_feature_sql():
    parts = []
    for c in REF_COLS:
        p = f"(SELECT {{s}} FROM cs WHERE class = 1 AND feature = '{c}')"
        n = f"(SELECT {{s}} FROM cs WHERE class = 0 AND feature = '{c}')"
        parts.append(f"round(({c} - {p.format(s='mean')}) / ({p.format(s='std')} + 1e-6), 6) AS zscore_pos_{c}")
        parts.append(f"round(({c} - {n.format(s='mean')}) / ({n.format(s='std')} + 1e-6), 6) AS zscore_neg_{c}")
        for q in ("q25", "q50", "q75"):
            parts.append(f"round(abs({c} - {p.format(s=q)}), 6) AS dist_{q}_pos_{c}")
    return ",\n  ".join(parts)


@register("e14_e15_reference_distances", with_orders(*_ref_sql()) + f"""
SELECT id,
  {_ref_feature_sql()}
FROM order_frame""")
def q_e14(spark, sf):
    from churnforge.operators.refdist import class_stats, reference_features
    f = _orders(spark, sf)
    st = class_stats(f.filter(F.col("split") == "train"), "label", REF_COLS)
    out = reference_features(f, st, REF_COLS)
    new = [c for c in out.columns if c.startswith(("zscore_", "dist_"))]
    return out.select("id", *[r6(c).alias(c) for c in new])


# =============================================================== 2.7 aggregates
@register("a1_a2_base_rates", with_orders() + """
SELECT split, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_pos, CAST(sum(1 - label) AS BIGINT) AS n_neg,
       round(avg(CAST(label AS DOUBLE)), 6) AS base_rate FROM order_frame GROUP BY split""")
def q_a1(spark, sf):
    f = _orders(spark, sf)
    return f.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("label") == 1).alias("n_pos"),
                                  F.count_if(F.col("label") == 0).alias("n_neg"), r6(F.avg("label")).alias("base_rate"))


MODE_SQL = """
{name} AS (
  SELECT {g}, {c} AS {out} FROM (
    SELECT {g}, {c}, row_number() OVER (PARTITION BY {g} ORDER BY count(*) DESC, {c}) AS rn
    FROM {src} WHERE {c} IS NOT NULL GROUP BY {g}, {c}) t WHERE rn = 1
)"""


@register("a5_a7_group_stats", with_orders(MODE_SQL.format(name="fm", g="nation", c="flag", out="flag_mode",
                                                           src="order_frame").strip()) + """
SELECT o.nation, count(*) AS n_rows, round(avg(CAST(o.label AS DOUBLE)), 6) AS label_rate, any_value(fm.flag_mode) AS flag_mode
FROM order_frame o LEFT JOIN fm ON o.nation = fm.nation GROUP BY o.nation""")
def q_a5(spark, sf):
    f = _orders(spark, sf)
    rates = f.groupBy("nation").agg(F.count(F.lit(1)).alias("n_rows"), r6(F.avg("label")).alias("label_rate"))
    return rates.join(encode.group_modes(f, "nation", ["flag"]), "nation", "left")


@register("a8_fold_average", with_orders(*te_map_sql(), "sc AS (" + _filled_sql(where="split = 'score'") + ")") + """
SELECT sc.id, round(avg(coalesce(te.enc, te2.prior)), 6) AS score
FROM sc CROSS JOIN (SELECT DISTINCT fold, prior FROM te) te2
LEFT JOIN te ON te.fold = te2.fold AND te.feature = 'nation' AND te.key = sc.nation
GROUP BY sc.id""")
def q_a8(spark, sf):
    from churnforge.operators.ensemble import fold_average
    _fo, m = _te_folds(spark, sf)
    sc = clean.clean_frame(_orders(spark, sf), categorical=CATS).filter(F.col("split") == "score")
    per_fold = [encode.apply_target_encoding(sc.select("id", "nation"), m, ["nation"], fold=f)
                .select("id", F.col("nation_te").alias("score")) for f in range(5)]
    from functools import reduce
    return fold_average(reduce(DataFrame.unionByName, per_fold)).select("id", r6("score").alias("score"))


@register("t2_top5_rates", with_orders() + """
SELECT nation, round(avg(CAST(label AS DOUBLE)), 6) AS rate FROM order_frame WHERE split = 'train'
GROUP BY nation ORDER BY rate DESC, nation LIMIT 5""")
def q_t2(spark, sf):
    f = _orders(spark, sf).filter(F.col("split") == "train")
    return f.groupBy("nation").agg(r6(F.avg("label")).alias("rate")).orderBy(F.desc("rate"), "nation").limit(5)


# =============================================================== 2.6 joins, 2.9 unions, pseudo-labels
@register("j1_align_predictions", with_orders() + """
SELECT o.id, o.label, s.score FROM order_frame o JOIN score_tables s ON o.id = s.id
WHERE o.split = 'score' AND s.model = 'a'""")
def q_j1(spark, sf):
    from churnforge.operators.joins import align_predictions
    f = _orders(spark, sf).filter(F.col("split") == "score").select("id", "label")
    p = frames.score_tables(spark, sf).filter(F.col("model") == "a").select("id", "score")
    return align_predictions(f, p)


@register("j2_sum_tables", with_orders() + """
SELECT id, round(sum(score), 6) AS score, count(*) AS n_tables FROM score_tables GROUP BY id""")
def q_j2(spark, sf):
    from churnforge.operators.joins import sum_tables
    from churnforge.session import cut_lineage
    s = cut_lineage(frames.score_tables(spark, sf))        # three tables from one pass
    t = sum_tables({m: s.filter(F.col("model") == m) for m in ("a", "b", "c")})
    return t.select("id", r6("score").alias("score"), "n_tables")


@register("j3_id_coverage", with_orders(
    "l AS (SELECT DISTINCT id FROM score_tables WHERE model = 'a' AND split = 'train')",
    "r AS (SELECT DISTINCT id FROM score_tables WHERE model = 'b')") + """
SELECT count(*) FILTER (WHERE r.id IS NULL) AS left_only, count(*) FILTER (WHERE l.id IS NULL) AS right_only,
       count(*) FILTER (WHERE l.id IS NOT NULL AND r.id IS NOT NULL) AS both
FROM l FULL OUTER JOIN r ON l.id = r.id""")
def q_j3(spark, sf):
    from churnforge.operators.joins import id_coverage
    s = frames.score_tables(spark, sf)
    return id_coverage(s.filter((F.col("model") == "a") & (F.col("split") == "train")), s.filter(F.col("model") == "b"))


@register("u1_union_tagged", with_orders() + """
SELECT id, 'train' AS part FROM order_frame WHERE split = 'train'
UNION ALL SELECT id, 'score' AS part FROM order_frame WHERE split = 'score'""")
def q_u1(spark, sf):
    from churnforge.operators.shift import tag_union
    f = _orders(spark, sf).select("id", "split")
    return tag_union(f.filter("split = 'train'").drop("split"), f.filter("split = 'score'").drop("split"),
                     split_col="part")


PSEUDO_SQL = [
    "sa AS (SELECT id, score FROM score_tables WHERE model = 'a' AND split = 'score')",
    "rk AS (SELECT id, ((rank() OVER (ORDER BY score) - 1) + (count(*) OVER (PARTITION BY score) + 1) / 2.0) "
    "/ count(*) OVER () AS rp FROM sa)",
    "inj AS (SELECT id, label, false AS is_pseudo FROM order_frame WHERE split = 'train' UNION ALL "
    "SELECT id, CASE WHEN rp >= 0.985 THEN 1 ELSE 0 END AS label, true AS is_pseudo FROM rk WHERE rp >= 0.985 OR rp <= 0.015)",
]


def _pseudo(spark, sf):
    from churnforge.operators.shift import pseudo_label
    f = _orders(spark, sf).select("id", "label", "split")
    s = frames.score_tables(spark, sf).filter((F.col("model") == "a") & (F.col("split") == "score"))
    preds = metrics.average_rank(s.select("id", "score"), "score", out="rank_pct") \
        .select("id", F.col("rank_pct").alias("score"))
    return pseudo_label(f.filter("split = 'train'").drop("split"), f.filter("split = 'score'").drop("split"),
                        preds, "id", "label")


@register("l20_u3_pseudo_labels", with_orders(*PSEUDO_SQL) + "SELECT id, label, is_pseudo FROM inj")
def q_l20(spark, sf):
    return _pseudo(spark, sf).select("id", "label", "is_pseudo")


@register("l21_honest_auc", with_orders(
    *PSEUDO_SQL,
    "sc AS (SELECT i.label, i.is_pseudo, s.score FROM inj i JOIN score_tables s ON i.id = s.id AND s.model = 'b')",
    auc_sql("sc", None).strip().replace("run AS", "run_all AS"),
    auc_sql("(SELECT * FROM sc WHERE NOT is_pseudo)", None).strip().replace("dist AS", "dist2 AS")
    .replace("FROM dist", "FROM dist2").replace("run AS", "run_orig AS")) + """
SELECT 'all' AS subset, round(sum(pos * (neg_before + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc FROM run_all
UNION ALL
SELECT 'original' AS subset, round(sum(pos * (neg_before + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc FROM run_orig""")
def q_l21(spark, sf):
    from churnforge.operators.shift import honest_auc
    inj = _pseudo(spark, sf)
    b = frames.score_tables(spark, sf).filter(F.col("model") == "b").select("id", "score")
    return honest_auc(inj.join(b, "id"), "label", "score").select("subset", r6("auc").alias("auc"))


# =============================================================== 2.10 combination operators
def _grid_sql(steps=10):
    """All weights in tenths that add up to 1, numbered in lexicographic order; made by SQL itself."""
    return (f"g AS (SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS INTEGER) AS wid, a / {steps}.0::DOUBLE AS w_a, "
            f"b / {steps}.0::DOUBLE AS w_b, ({steps} - a - b) / {steps}.0::DOUBLE AS w_c "
            f"FROM range({steps + 1}) t(a), range({steps + 1}) u(b) WHERE a + b <= {steps})")


@register("l12_blend_grid_auc", with_orders(
    "tr AS (SELECT id, label, max(CASE WHEN model = 'a' THEN score END) AS s_a, max(CASE WHEN model = 'b' THEN score END) AS s_b, "
    "max(CASE WHEN model = 'c' THEN score END) AS s_c FROM score_tables WHERE split = 'train' GROUP BY id, label)",
    _grid_sql(),
    "bl AS (SELECT wid, w_a, w_b, w_c, label, 0.0 + w_a * s_a + w_b * s_b + w_c * s_c AS score FROM tr CROSS JOIN g)",
    auc_sql("bl", "wid, w_a, w_b, w_c").strip().replace("PARTITION BY wid, w_a, w_b, w_c", "PARTITION BY wid")) + """
SELECT wid, w_a, w_b, w_c, round(sum(pos * (neg_before + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc
FROM run GROUP BY wid, w_a, w_b, w_c""")
def q_l12(spark, sf):
    from churnforge.operators.ensemble import blend_grid_auc, simplex_grid
    s = frames.score_tables(spark, sf).filter(F.col("split") == "train")
    res = blend_grid_auc(s, ["a", "b", "c"], simplex_grid(3, 0.1))
    return res.select("wid", "w_a", "w_b", "w_c", r6("auc").alias("auc"))


@register("l13_weighted_blend", with_orders() + """
SELECT id, round(sum(score * CASE model WHEN 'a' THEN 0.5 WHEN 'b' THEN 0.3 ELSE 0.2 END), 6) AS score
FROM score_tables GROUP BY id""")
def q_l13(spark, sf):
    from churnforge.operators.ensemble import weighted_blend
    s = frames.score_tables(spark, sf)
    return weighted_blend(s, {"a": 0.5, "b": 0.3, "c": 0.2}).select("id", r6("score").alias("score"))


VARIANTS = [(0.95, 0.05), (0.90, 0.10), (0.85, 0.15), (0.80, 0.20)]


@register("l14_fixed_blends", with_orders(
    "p AS (SELECT a.id, a.score AS sa, b.score AS sb FROM score_tables a JOIN score_tables b ON a.id = b.id "
    "WHERE a.model = 'a' AND b.model = 'b')",
    "v(variant, wa, wb) AS (VALUES " + ", ".join(
        f"('{int(round(a * 100)):02d}_{int(round(b * 100)):02d}', CAST({a!r} AS DOUBLE), CAST({b!r} AS DOUBLE))"
        for a, b in VARIANTS) + ")") + """
SELECT variant, id, round(sa * wa + sb * wb, 6) AS score FROM p CROSS JOIN v""")
def q_l14(spark, sf):
    from churnforge.operators.ensemble import fixed_blends
    s = frames.score_tables(spark, sf)
    out = fixed_blends(s.filter(F.col("model") == "a"), s.filter(F.col("model") == "b"), VARIANTS)
    return out.select("variant", "id", r6("score").alias("score"))


@register("l15_equal_blend", with_orders() + """
SELECT id, round(avg(score), 6) AS score FROM score_tables GROUP BY id""")
def q_l15(spark, sf):
    from churnforge.operators.ensemble import equal_blend
    return equal_blend(frames.score_tables(spark, sf)).select("id", r6("score").alias("score"))


@register("l16_rank_power_average", with_orders(RANK_SQL) + """
SELECT id, round(avg(pow(avg_rank / n, 2.5)), 6) AS score, count(*) AS n_tables FROM ranked GROUP BY id""")
def q_l16(spark, sf):
    from churnforge.operators.ensemble import rank_power_average
    out = rank_power_average(frames.score_tables(spark, sf), power=2.5)
    return out.select("id", r6("score").alias("score"), "n_tables")


@register("l17_calibrate", with_orders(
    HOLED_SQL,
    "br AS (SELECT avg(CAST(label AS DOUBLE)) AS rate FROM order_frame WHERE split = 'train')",
    "sa AS (SELECT id, CASE WHEN isnan(score) THEN NULL ELSE score END AS score FROM holed WHERE model = 'a' AND split = 'score')",
    "ms AS (SELECT avg(score) AS m FROM sa)") + """
SELECT id, round(CASE WHEN score IS NULL THEN NULL ELSE greatest(least(score * rate / m, 0.9999), 0.0001) END, 6) AS score
FROM sa, br, ms""")
def q_l17(spark, sf):
    from churnforge.operators.ensemble import calibrate
    f = _orders(spark, sf)
    rate = f.filter(F.col("split") == "train").select(F.avg(F.col("label").cast("double"))).scalar()
    sa = _holed(spark, sf).filter((F.col("model") == "a") & (F.col("split") == "score"))
    return calibrate(sa.select("id", "score"), rate).select("id", r6("score").alias("score"))


# =============================================================== 2.5 cluster profile / rate model (fixed assignment)
@register("k8_cluster_profile", with_orders(
    MODE_SQL.format(name="mp", g="segment", c="priority", out="priority_mode", src="order_frame").strip(),
    MODE_SQL.format(name="mf", g="segment", c="flag", out="flag_mode", src="order_frame").strip()) + """
SELECT o.segment AS cluster, count(*) AS size, round(avg(CAST(o.label AS DOUBLE)), 6) AS label_rate,
  round(avg(o.tenure), 6) AS tenure_mean, round(avg(o.monthly), 6) AS monthly_mean, round(avg(o.total), 6) AS total_mean,
  any_value(mp.priority_mode) AS priority_mode, any_value(mf.flag_mode) AS flag_mode
FROM order_frame o LEFT JOIN mp ON o.segment = mp.segment LEFT JOIN mf ON o.segment = mf.segment GROUP BY o.segment""")
def q_k8(spark, sf):
    from churnforge.operators.cluster import cluster_profile
    f = _orders(spark, sf)
    prof = cluster_profile(f, "segment", "label", NUMS, ["priority", "flag"])
    return prof.select(F.col("segment").alias("cluster"), "size", r6("label_rate").alias("label_rate"),
                       *[r6(f"{c}_mean").alias(f"{c}_mean") for c in NUMS], "priority_mode", "flag_mode")


@register("k9_cluster_rate_predict", with_orders(
    "rt AS (SELECT segment, avg(CAST(label AS DOUBLE)) AS rate FROM order_frame WHERE split = 'train' GROUP BY segment)",
    "gm AS (SELECT avg(CAST(label AS DOUBLE)) AS g FROM order_frame WHERE split = 'train')") + """
SELECT o.id, round(coalesce(rt.rate, gm.g), 6) AS score FROM order_frame o LEFT JOIN rt ON o.segment = rt.segment, gm
WHERE o.split = 'score'""")
def q_k9(spark, sf):
    from churnforge.operators.cluster import apply_cluster_rate, fit_cluster_rate
    f = _orders(spark, sf)
    fitted = fit_cluster_rate(f.filter(F.col("split") == "train"), "segment", "label")
    out = apply_cluster_rate(f.filter(F.col("split") == "score"), fitted, "segment", "score")
    return out.select("id", r6("score").alias("score"))


# =============================================================== 2.10 model operators (rows-only: no SQL oracle)
@register("l1_crossfit_logreg_oof")
def q_l1(spark, sf):
    from churnforge.plans.presets import crossfit_oof
    oof, _ = crossfit_oof(spark, sf, "logreg", k=5, C=1.0)
    return oof


@register("l1_crossfit_score_average")
def q_l1_test(spark, sf):
    from churnforge.plans.presets import crossfit_oof
    _, test = crossfit_oof(spark, sf, "logreg", k=5, C=1.0)
    return test


def _trimodel(spark, sf, k=3):
    """L8 over the reference's three boosters and a linear model: L3 on raw categories, L4 shallow trees on
    target encodings, L5 on ordered encodings, logistic regression on target encodings."""
    from churnforge.operators.models import multi_crossfit
    from churnforge.plans.presets import BASE_NUMS, CATS, RESIDUALS, folded_train
    tr, _sc = folded_train(spark, sf, k=k)
    te_map = encode.fit_fold_target_encoder(tr, CATS, "label", "fold", k, smoothing=20.0)
    plain = {"te_cols": (), "te_map": None}
    members = [("gbt_native", "gbt", plain | {"categorical": CATS, "maxIter": 10}),
               ("gbt_shallow", "gbt_shallow", {"maxIter": 10}),
               ("gbt_ordered", "gbt", plain | {"ordered_cols": CATS, "maxIter": 10}),
               "logreg"]
    oof, _ = multi_crossfit(tr, BASE_NUMS + RESIDUALS, "label", "id", "fold", k, members, te_cols=CATS, te_map=te_map)
    return oof


@register("l2_l8_trimodel_oof")
def q_l8(spark, sf):
    return _trimodel(spark, sf)


def _oof_checks_sql(models, k, frame="folded"):
    rows = ", ".join(f"('{m}')" for m in models)
    return with_orders(folds_cte(k=k), f"ms(model) AS (VALUES {rows})") + f"""
SELECT model, fold, count(*) AS n_rows, count(DISTINCT id) AS n_ids, count(*) AS n_in_range
FROM {frame} CROSS JOIN ms GROUP BY model, fold"""


def _checked(oof):
    """An invariant check, not a value check: every training id once per model, in its fold, scored in 0..1."""
    from churnforge.operators.models import oof_checks
    out = oof_checks(oof)
    return out.select("model", F.col("fold").cast("int").alias("fold"), "n_rows", "n_ids", "n_in_range")


@register("l3_l4_l5_l8_oof_invariants", _oof_checks_sql(["gbt_native", "gbt_shallow", "gbt_ordered", "logreg"], 3))
def q_l8_checks(spark, sf):
    return _checked(_trimodel(spark, sf))


@register("l1_crossfit_oof_invariants", _oof_checks_sql(["logreg"], 5))
def q_l1_checks(spark, sf):
    from churnforge.plans.presets import crossfit_oof
    return _checked(crossfit_oof(spark, sf, "logreg", k=5, C=1.0)[0])


@register("l6_pair_te_oof_invariants", _oof_checks_sql(["pair_logreg"], 3))
def q_l6_checks(spark, sf):
    from churnforge.plans.presets import pair_logreg_oof
    return _checked(pair_logreg_oof(spark, sf, k=3, C=0.1)[0])


@register("l9_early_stopping_oof_invariants", _oof_checks_sql(["gbt"], 3))
def q_l9_checks(spark, sf):
    from churnforge.plans.presets import crossfit_oof
    return _checked(crossfit_oof(spark, sf, "gbt", k=3, early_stopping=True)[0])


@register("l9_gbt_early_stopping_oof")
def q_l9(spark, sf):
    from churnforge.plans.presets import crossfit_oof
    oof, _ = crossfit_oof(spark, sf, "gbt", k=3, early_stopping=True)
    return oof


@register("l10_random_search_trials")
def q_l10(spark, sf):
    from churnforge.operators.models import random_search
    from churnforge.plans.presets import BASE_NUMS, CATS, RESIDUALS, model_frame
    tr = model_frame(spark, sf).filter(F.col("split") == "train")
    trials, _best = random_search(tr, BASE_NUMS + RESIDUALS, "label", "id", n_trials=30, te_cols=CATS)
    return trials


@register("l11_stack_oof")
def q_l11(spark, sf):
    from churnforge.operators.models import stack
    s = frames.score_tables(spark, sf)
    oof, _ = stack(s.filter(F.col("split") == "train"), s.filter(F.col("split") == "score"), ["a", "b", "c"], "label")
    return oof


@register("l18_adversarial_importance")
def q_l18(spark, sf):
    from churnforge.operators.models import adversarial_validation
    d = frames.doc_frame(spark, sf)
    _auc, _drift, imps, _flagged = adversarial_validation(d, ["n_chars"], id_col="doc_id", categorical=["lang", "source"],
                                                         k=3, maxIter=10)
    return imps


@register("l18_drift_summary")
def q_l18_summary(spark, sf):
    from churnforge.operators.models import drift_summary
    d = frames.doc_frame(spark, sf)
    return drift_summary(d, ["n_chars"], id_col="doc_id", categorical=["lang", "source"], k=3, maxIter=10)


AUTOML_PARAMS = {"gbt": {"maxIter": 10}, "rf": {"numTrees": 20}, "fm": {"maxIter": 20}, "mlp": {"maxIter": 20}}


def _automl(spark, sf):
    from churnforge.operators.models import automl
    from churnforge.plans.presets import BASE_NUMS, RESIDUALS, folded_train
    tr, sc = folded_train(spark, sf, k=3)
    board, _oof, _test = automl(tr, BASE_NUMS + RESIDUALS, "label", "id", "fold", 3,
                                families=("gbt", "rf", "logreg", "fm", "nb", "mlp"), score_rows=sc, params=AUTOML_PARAMS,
                               weighted=True)
    return board, tr, sc


@register("l22_automl_leaderboard")
def q_l22(spark, sf):
    return _automl(spark, sf)[0]


@register("k1_k3_kmeans_embeddings")
def q_k1(spark, sf):
    from churnforge.operators.cluster import kmeans_features
    e = frames.embedding_frame(spark, sf)
    out = kmeans_features(e, e, k=10, array_col="embedding", n_init=10)
    return out.drop("embedding")


@register("k4_reference_kmeans")
def q_k4(spark, sf):
    from churnforge.operators.cluster import kmeans_features
    f = _orders(spark, sf)
    f = f.withColumn("surcharge", fe.charge_residual("total", "monthly", "tenure"))
    cols = ["tenure", "monthly", "total", "surcharge"]
    return kmeans_features(f.select("id", *cols), f.filter(F.col("split") == "train"), k=8, cols=cols, n_init=10)


@register("k1_k3_two_resolutions")
def q_k1_scaled(spark, sf):
    """v18 pattern: k = 10 and k = 30 on the scaled numerics, fitted on train, ids and distances for every row."""
    from churnforge.operators.cluster import assemble, fit_kmeans_each, kmeans_features
    from churnforge.session import cut_lineage
    f = cut_lineage(_orders(spark, sf).select("id", "split", *NUMS, "acctbal"))       # the joins run once
    train = f.filter(F.col("split") == "train")
    scaled = encode.standard_scale(f.select("id", "split", *NUMS, "acctbal"), [*NUMS, "acctbal"], fit_df=train)
    fitted = scaled.filter(F.col("split") == "train")
    for k, model in fit_kmeans_each(assemble(fitted, [*NUMS, "acctbal"]), (10, 30), n_init=10).items():
        scaled = kmeans_features(scaled, fitted, k=k, cols=[*NUMS, "acctbal"], prefix=f"k{k}_dist_", id_out=f"k{k}_cluster_id", model=model)
    return scaled


@register("k1_k3_fit_invariants", "SELECT count(*) AS n_rows, count(*) AS n_nearest, true AS beats_fixed_start FROM embeddings")
def q_k1_checks(spark, sf):
    """An invariant check: every row gets the cluster of its smallest distance, and the fit costs no more than centres
    at the label means."""
    from churnforge.operators.cluster import centroid_distances, kmeans_features
    e = frames.embedding_frame(spark, sf)
    out = kmeans_features(e, e, k=10, array_col="embedding", n_init=10)
    dists = [f"kmeans_dist_{j}" for j in range(10)]
    least = F.least(*[F.col(d) for d in dists])
    own = F.element_at(F.array(*[F.col(d) for d in dists]), F.col("kmeans_cluster_id").cast("int") + 1)
    fit = out.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(own == least).alias("n_nearest"), F.sum(least * least).alias("cost"))
    means = e.select("label", F.posexplode("embedding").alias("at", "x")).groupBy("label", "at").agg(F.avg("x").alias("m")) \
        .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("c")).orderBy("label").limit(10).collect()
    fixed = centroid_distances(e, [[x["m"] for x in r["c"]] for r in means], array_col="embedding", prefix="fixed_")
    start = F.least(*[F.col(f"fixed_{j}") for j in range(len(means))])
    start_cost = fixed.agg(F.sum(start * start).alias("start_cost"))
    return fit.crossJoin(F.broadcast(start_cost)).select(        # one row beside one row
        "n_rows", "n_nearest", (F.col("cost") <= F.col("start_cost")).alias("beats_fixed_start"))


@register("k5_cosine_clusters")
def q_k5(spark, sf):
    from churnforge.operators.cluster import cosine_clusters
    from churnforge.session import cut_lineage
    f = cut_lineage(_orders(spark, sf).select("id", "split", *NUMS, "segment", "priority"))       # the joins run once
    out = cosine_clusters(f, f.filter(F.col("split") == "train"), NUMS, ["segment", "priority"], k=3)
    return out.select("id", "cluster", *[f"cos_dist_{j}" for j in range(3)])


def _unit_sql():
    levels = {"segment": 5, "priority": 5}
    z = ", ".join(f"coalesce(({c} - {c}_m) / nullif({c}_s, 0), 0) AS {c}_z" for c in NUMS)
    stats = ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in NUMS)
    hot = " + ".join(f"CASE WHEN {c} IN (SELECT DISTINCT {c} FROM order_frame WHERE split = 'train') THEN 1 ELSE 0 END" for c in levels)
    norm = " + ".join([f"{c}_z * {c}_z" for c in NUMS] + ["hot"])
    return with_orders(f"st AS (SELECT {stats} FROM order_frame WHERE split = 'train')",
                       f"zz AS (SELECT id, {z}, {hot} AS hot FROM order_frame, st)") + "SELECT id, " + ", ".join(
        f"round(coalesce({c}_z / nullif(sqrt({norm}), 0), 0), 6) AS {c}_unit" for c in NUMS) + " FROM zz"


@register("k5_unit_vectors", _unit_sql())
def q_k5_units(spark, sf):
    from churnforge.operators.cluster import apply_unit_vectors, fit_unit_vectors
    from pyspark.ml.functions import vector_to_array
    f = _orders(spark, sf)
    cats = ["segment", "priority"]
    out = apply_unit_vectors(f, fit_unit_vectors(f.filter(F.col("split") == "train"), NUMS, cats), NUMS, cats)
    unit = vector_to_array("features")
    return out.select("id", *[r6(unit[i]).alias(f"{c}_unit") for i, c in enumerate(NUMS)])


@register("k6_silhouette_scan")
def q_k6(spark, sf):
    from churnforge.operators.cluster import array_to_features, choose_k_by_silhouette
    e = array_to_features(frames.embedding_frame(spark, sf), "embedding")
    _k, scores = choose_k_by_silhouette(e, k_min=2, k_max=20)
    return spark.createDataFrame(scores, "k int, silhouette double")


@register("k6_k9_cluster_chain")
def q_k_chain(spark, sf):
    """K6 -> K7 -> K8 -> K9 in one path; rows are the score rows' cluster and rate."""
    from churnforge.operators.cluster import cluster_then_rate
    from churnforge.session import cut_lineage
    f = cut_lineage(_orders(spark, sf).select("id", "label", "split", *NUMS, "segment", "priority"))      # the joins run once
    _k, _profile, _train, scored = cluster_then_rate(f.filter("split = 'train'"), f.filter("split = 'score'"), NUMS,
                                                     ["segment", "priority"], "label", k_max=20, n_init=2)
    return scored


# =============================================================== 2.1 sources and sinks
def _scratch(spark, name):
    import uuid
    from churnforge.session import scratch_path
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def _reread(df, path):
    """The result that was read from a scratch folder, held by a checkpoint; the folder goes."""
    from churnforge.session import cut_lineage
    from churnforge.sources import tables
    held = cut_lineage(df)
    tables.delete_path(df.sparkSession, path)
    return held


@register("s1_s8_csv_typed_roundtrip", REGISTRY["p4_numeric_coerce"][1])
def q_s1(spark, sf):
    from pyspark.sql import types as T
    from churnforge.sources import tables
    raw = frames.raw_order_frame(spark, sf).select("id", *[f"{c}_txt" for c in NUMS])
    path = _scratch(spark, "orders-csv")
    tables.write_table(raw, path, fmt="csv")  # S8 (CSV with header)
    schema = T.StructType([T.StructField("id", T.LongType())] +
                          [T.StructField(f"{c}_txt", T.StringType()) for c in NUMS])
    # Declared schema; keep blanks as text so P4 decides what is a number
    back = tables.read_csv_typed(spark, path, schema, verbatim=True)
    return _reread(back.select("id", *[r6(clean.to_number(f"{c}_txt")).alias(c) for c in NUMS]), path)


@register("s5_s6_prediction_sources", REGISTRY["l16_rank_power_average"][1])
def q_s5(spark, sf):
    from churnforge.operators.ensemble import rank_power_average
    from churnforge.sources import tables
    s = frames.score_tables(spark, sf)
    base = _scratch(spark, "predictions")
    for m in ("a", "b", "c"):
        tables.write_predictions(s.filter(F.col("model") == m).select("id", "score"), f"{base}/{m}")  # S8
    paths = tables.existing_sources(spark, [f"{base}/{m}" for m in ("a", "b", "missing", "c")])  # S6
    long = tables.union_sources([tables.read_predictions(spark, p).withColumn("model", F.lit(p.rsplit("/", 1)[1]))
                                 for p in paths])  # S5
    out = rank_power_average(long, power=2.5)
    return _reread(out.select("id", r6("score").alias("score"), "n_tables"), base)


# =============================================================== remaining inventory items (rows-only)
D1_NUMS = NUMS + ["acctbal"]


@register("d1_preprocessor_features", with_orders(
    "st AS (SELECT " + ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in D1_NUMS)
    + " FROM order_frame WHERE split = 'train')",
    "filled AS (" + _filled_sql(where="true") + ")",
    *[f"o_{c} AS (SELECT {c} AS k, CAST(row_number() OVER (ORDER BY {c}) - 1 AS INTEGER) AS code FROM "
      f"(SELECT DISTINCT {c} FROM filled WHERE split = 'train') t)" for c in CATS]) + "SELECT f.id, f.split, " + ", ".join(
    [f"round(coalesce((f.{c} - {c}_m) / nullif({c}_s, 0), 0), 6) AS {c}" for c in D1_NUMS]
    + [f"coalesce(o_{c}.code, -1) AS {c}_ord" for c in CATS]) + " FROM filled f, st "
    + " ".join(f"LEFT JOIN o_{c} ON o_{c}.k = f.{c}" for c in CATS))
def q_d1(spark, sf):
    from churnforge.sources import tables
    f = clean.clean_frame(_orders(spark, sf), categorical=CATS)
    fitted = encode.fit_preprocessor(f.filter(F.col("split") == "train"), D1_NUMS, CATS)
    base = _scratch(spark, "preprocessor")
    for name, state in zip(("scaler", "ordinal"), fitted, strict=True):     # S10
        tables.save_fitted(state, f"{base}/{name}")
    loaded = tuple(tables.load_fitted(spark, f"{base}/{name}") for name in ("scaler", "ordinal"))
    out = encode.apply_preprocessor(f, loaded, D1_NUMS, CATS)
    return _reread(out.select("id", "split", *[r6(c).alias(c) for c in D1_NUMS], *[f"{c}_ord" for c in CATS]), base)


@register("s2_p8_p7_d1_flow", with_orders(
    "raw2 AS (SELECT id, split, CAST(CASE WHEN churn_text = 'Yes' THEN 1 WHEN churn_text = 'No' THEN 0 END AS INTEGER) AS label, "
    + num("monthly_txt") + " AS monthly, " + num("total_txt") + " AS total, priority, segment FROM raw_orders)",
    "kept AS (SELECT * FROM raw2 WHERE label IS NOT NULL AND monthly IS NOT NULL AND total IS NOT NULL AND priority IS NOT NULL)",
    "st AS (SELECT avg(monthly) AS mm, stddev_pop(monthly) AS ms, avg(total) AS tm, stddev_pop(total) AS ts FROM kept WHERE split = 'train')",
    *[f"o_{c} AS (SELECT {c} AS k, CAST(row_number() OVER (ORDER BY {c}) - 1 AS INTEGER) AS code FROM "
      f"(SELECT DISTINCT {c} FROM kept WHERE split = 'train') t)" for c in ("priority", "segment")]) + """
SELECT id, split, label, round((monthly - mm) / ms, 6) AS monthly, round((total - tm) / ts, 6) AS total,
       coalesce(o_priority.code, -1) AS priority_ord, coalesce(o_segment.code, -1) AS segment_ord
FROM kept CROSS JOIN st LEFT JOIN o_priority ON o_priority.k = priority LEFT JOIN o_segment ON o_segment.k = segment""")
def q_s2(spark, sf):
    """The older schema's load: raw CSV (S2) -> rows without a label (P8) or with nulls (P7) go -> preprocessor (D1),
    fitted on train and applied to both splits."""
    from churnforge.sources import tables
    raw = frames.raw_order_frame(spark, sf).select("id", "split", "churn_text", "monthly_txt", "total_txt", "priority", "segment")
    path = _scratch(spark, "subscription-csv")
    tables.write_table(raw, path, fmt="csv")
    back = tables.read_csv_typed(spark, path, raw.schema)
    typed = back.select("id", "split", clean.label_strict("churn_text").alias("label"), clean.to_number("monthly_txt").alias("monthly"),
                        clean.to_number("total_txt").alias("total"), "priority", "segment")
    kept = clean.drop_null_rows(clean.drop_null_label(typed, "label"), ["monthly", "total", "priority"])
    nums, cats = ["monthly", "total"], ["priority", "segment"]
    out = encode.apply_preprocessor(kept, encode.fit_preprocessor(kept.filter(F.col("split") == "train"), nums, cats), nums, cats)
    return _reread(out.select("id", "split", "label", r6("monthly").alias("monthly"), r6("total").alias("total"), "priority_ord",
                              "segment_ord"), path)


def _hash_normal_sql(column):
    digest = f"md5(CAST(id AS VARCHAR) || '|42|{column}')"
    u = lambda at: f"CAST('0x' || substr({digest}, {at}, 12) AS BIGINT) / 281474976710656.0"
    return f"sqrt(-2.0 * ln(1.0 - {u(1)})) * cos({2 * math.pi!r} * ({u(13)}))"


D8_TE = [
    "tr AS (" + _filled_sql() + ")",
    "fa AS (" + _filled_sql(where="true") + ")",
    "lf AS (" + _long_sql("tr", "label") + ")",
    "pr AS (SELECT avg(CAST(label AS DOUBLE)) AS prior FROM tr)",
    "st AS (SELECT feature, key, count(*) AS n, sum(CAST(label AS DOUBLE)) AS s FROM lf GROUP BY feature, key)",
    "te AS (SELECT feature, key, prior * (1.0 - w) + (s / n) * w AS enc FROM "
    "(SELECT st.*, pr.prior, 1.0 / (1.0 + exp(-(n - 20.0) / 20.0)) AS w FROM st, pr) z)"]


@register("d8_noisy_target_encoding", with_orders(*D8_TE) + "SELECT id, split, " + ", ".join(
    f"round(coalesce((SELECT enc FROM te WHERE feature = '{c}' AND key = fa.{c}), (SELECT prior FROM pr)) "
    f"+ CASE WHEN split = 'train' THEN 0.01 * {_hash_normal_sql(c + '_te')} ELSE 0 END, 6) AS {c}_te" for c in CATS) + " FROM fa")
def q_d8(spark, sf):
    f = clean.clean_frame(_orders(spark, sf), categorical=CATS)
    fitted = encode.fit_target_encoder(f.filter(F.col("split") == "train"), CATS, "label", smoothing=20.0)
    enc = encode.apply_target_encoding(f, fitted, CATS)
    noisy = encode.add_noise(enc, [f"{c}_te" for c in CATS], sigma=0.01, seed=42,
                             only_when=F.col("split") == "train")
    return noisy.select("id", "split", *[r6(f"{c}_te").alias(f"{c}_te") for c in CATS])


@register("d9_ordered_te_apply_score", with_orders(
    "tr AS (" + _filled_sql() + ")",
    "sc AS (" + _filled_sql(where="split = 'score'") + ")",
    "lf AS (" + _long_sql("tr", "label") + ")",
    "pr AS (SELECT avg(CAST(label AS DOUBLE)) AS prior FROM tr)",
    "te AS (SELECT feature, key, (sum(CAST(label AS DOUBLE)) + any_value(prior)) / (count(*) + 1.0) AS enc "
    "FROM lf, pr GROUP BY feature, key)") + "SELECT sc.id, " + ", ".join(
    f"round(coalesce((SELECT enc FROM te WHERE feature = '{c}' AND key = sc.{c}), (SELECT prior FROM pr)), 6) AS {c}_cbe"
    for c in CATS) + " FROM sc")
def q_d9_apply(spark, sf):
    f = clean.clean_frame(_orders(spark, sf), categorical=CATS)
    fitted = encode.fit_ordered_encoder(f.filter(F.col("split") == "train"), CATS, "label", a=1.0)
    out = encode.apply_target_encoding(f.filter(F.col("split") == "score"), fitted, CATS, suffix="_cbe")
    return out.select("id", *[r6(f"{c}_cbe").alias(f"{c}_cbe") for c in CATS])


@register("d7_te_fold_map_null_keys", with_orders(
    folds_cte(k=5), "lf AS (SELECT fold, label, 'priority' AS feature, priority AS key FROM folded)",
    "tr AS (SELECT * FROM folded)", *[c.replace("pf.key = t.key", "pf.key IS NOT DISTINCT FROM t.key") for c in te_map_sql()[3:]]) + """
SELECT fold, feature, key, n, round(enc, 6) AS enc FROM te""")
def q_d7_nulls(spark, sf):
    """Unfilled priority: the null key is a category whose rows a fold's map leaves out like any other."""
    tr = folds.stratified_folds(_orders(spark, sf).filter(F.col("split") == "train"), "id", "label", k=5)
    m = encode.fit_fold_target_encoder(tr, ["priority"], "label", "fold", 5, smoothing=20.0, min_samples_leaf=20.0)
    return m.select(F.col("fold").cast("int"), "feature", "key", F.col("n").cast("long"), r6("enc").alias("enc"))


@register("d10_count_encoding_many_keys", """
WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT o_orderkey AS id, n AS customer_freq FROM orders JOIN c USING (o_custkey)""")
def q_d10_many(spark, sf):
    """A column with far more keys than a literal map holds: same values, same type."""
    from churnforge.sources import tables
    o = tables.read_table(spark, sf, "orders", ["o_orderkey", "o_custkey"]).select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"))
    return encode.apply_count_encoding(o, encode.fit_count_encoder(o, ["customer"]), ["customer"]).select("id", "customer_freq")


UNEVEN = "SELECT * FROM score_tables WHERE NOT (model = 'b' AND id % 7 = 0) AND NOT (model = 'a' AND id % 11 = 0)"


@register("l13_uneven_weighted_blend", with_orders(f"un AS ({UNEVEN})") + """
SELECT id, round(CASE WHEN count(*) = 3 THEN sum(score * CASE model WHEN 'a' THEN 0.5 WHEN 'b' THEN 0.3 ELSE 0.2 END) END, 6)
  AS score, count(*) AS n_models FROM un GROUP BY id""")
def q_l13_uneven(spark, sf):
    """Prediction tables with missing ids: every id stays, and only ids with all tables have a score."""
    from churnforge.operators.ensemble import weighted_blend
    s = frames.score_tables(spark, sf).filter("NOT (model = 'b' AND id % 7 = 0) AND NOT (model = 'a' AND id % 11 = 0)")
    return weighted_blend(s, {"a": 0.5, "b": 0.3, "c": 0.2}, uneven="report").select("id", r6("score").alias("score"), "n_models")


@register("l14_uneven_fixed_blends", with_orders(
    f"un AS ({UNEVEN})",
    "p AS (SELECT coalesce(a.id, b.id) AS id, a.score AS sa, b.score AS sb FROM (SELECT * FROM un WHERE model = 'a') a "
    "FULL JOIN (SELECT * FROM un WHERE model = 'b') b ON a.id = b.id)",
    "v(variant, wa, wb) AS (VALUES " + ", ".join(
        f"('{int(round(a * 100)):02d}_{int(round(b * 100)):02d}', CAST({a!r} AS DOUBLE), CAST({b!r} AS DOUBLE))"
        for a, b in VARIANTS) + ")") + """
SELECT variant, id, round(sa * wa + sb * wb, 6) AS score FROM p CROSS JOIN v""")
def q_l14_uneven(spark, sf):
    from churnforge.operators.ensemble import fixed_blends
    s = frames.score_tables(spark, sf).filter("NOT (model = 'b' AND id % 7 = 0) AND NOT (model = 'a' AND id % 11 = 0)")
    out = fixed_blends(s.filter(F.col("model") == "a"), s.filter(F.col("model") == "b"), VARIANTS, uneven="report")
    return out.select("variant", "id", r6("score").alias("score"))


def _search_sql():
    auc_expr = "sum(pos * (neg_before + neg / 2.0)) / (sum(pos) * sum(neg))"
    return with_orders(
        "tr AS (SELECT id, label, max(CASE WHEN model = 'a' THEN score END) AS s_a, max(CASE WHEN model = 'b' THEN score END) AS s_b, "
        "max(CASE WHEN model = 'c' THEN score END) AS s_c FROM score_tables WHERE split = 'train' GROUP BY id, label)",
        _grid_sql(),
        "bl AS (SELECT wid, w_a, w_b, w_c, label, 0.0 + w_a * s_a + w_b * s_b + w_c * s_c AS score FROM tr CROSS JOIN g)",
        auc_sql("bl", "wid").strip(),
        f"coarse AS (SELECT wid, {auc_expr} AS auc FROM run GROUP BY wid)",
        "best AS (SELECT g.* FROM g JOIN (SELECT wid FROM coarse ORDER BY auc DESC, wid LIMIT 1) b ON g.wid = b.wid)",
        "fg AS (SELECT a / 50.0::DOUBLE AS w_a, b / 50.0::DOUBLE AS w_b, (50 - a - b) / 50.0::DOUBLE AS w_c, a * 51 + b AS pos_in_grid "
        "FROM range(51) t(a), range(51) u(b) WHERE a + b <= 50)",
        "fsel AS (SELECT fg.w_a, fg.w_b, fg.w_c, CAST(row_number() OVER (ORDER BY pos_in_grid) - 1 AS INTEGER) AS wid "
        "FROM fg, best WHERE abs(fg.w_a - best.w_a) <= 0.1 + 1e-9 AND abs(fg.w_b - best.w_b) <= 0.1 + 1e-9 "
        "AND abs(fg.w_c - best.w_c) <= 0.1 + 1e-9)",
        "bl2 AS (SELECT wid, label, 0.0 + w_a * s_a + w_b * s_b + w_c * s_c AS score FROM tr CROSS JOIN fsel)",
        auc_sql("bl2", "wid").strip().replace("dist AS", "dist2 AS").replace("FROM dist", "FROM dist2")
        .replace("run AS", "run2 AS"),
        f"fine AS (SELECT wid, {auc_expr} AS auc FROM run2 GROUP BY wid)",
        "win AS (SELECT f.w_a, f.w_b, f.w_c, fine.auc FROM fine JOIN fsel f ON f.wid = fine.wid ORDER BY fine.auc DESC, fine.wid LIMIT 1)",
    ) + """
SELECT 'a' AS model, w_a AS weight, round(auc, 6) AS auc FROM win
UNION ALL SELECT 'b', w_b, round(auc, 6) FROM win
UNION ALL SELECT 'c', w_c, round(auc, 6) FROM win"""


@register("l12_search_blend_weights", _search_sql())
def q_l12_search(spark, sf):
    from churnforge.operators.ensemble import search_blend_weights
    s = frames.score_tables(spark, sf).filter(F.col("split") == "train")
    weights, best = search_blend_weights(s, ["a", "b", "c"], step=0.1, refine_step=0.02)
    return spark.createDataFrame([(m, float(w), round(float(best), 6)) for m, w in weights.items()],
                                 "model string, weight double, auc double")


@register("l19_prune_drifting_features")
def q_l19(spark, sf):
    from churnforge.operators.models import adversarial_validation
    from churnforge.operators.shift import prune_features
    from churnforge.plans.presets import BASE_NUMS, RESIDUALS, model_frame
    mf = model_frame(spark, sf)
    _auc, _drift, _imps, flagged = adversarial_validation(mf, BASE_NUMS + RESIDUALS, k=3, maxIter=10)
    return prune_features(mf, flagged)


@register("l19_drift_flags_fixed_importances", """
SELECT feature, importance_pct FROM (
  SELECT l_returnflag AS feature, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS importance_pct
  FROM lineitem GROUP BY l_returnflag) t WHERE importance_pct > 30""")
def q_l19_flags(spark, sf):
    """The threshold step on an importance table that SQL can state (shares of the return flags)."""
    from churnforge.operators.shift import drift_flags
    from churnforge.sources import tables
    counts = tables.read_table(spark, sf, "lineitem", ["l_returnflag"]).groupBy(F.col("l_returnflag").alias("feature")).count()
    total = counts.select(F.sum("count")).scalar()
    return drift_flags(counts.select("feature", r6(F.lit(100.0) * F.col("count") / total).alias("importance_pct")), 30.0)


@register("l23_s10_s12_saved_model_scoring")
def q_l23(spark, sf):
    """The leaderboard's best single family, refitted on all training rows, saved, reloaded and used for scoring."""
    from churnforge.operators.models import best_model, fit_final, score_with
    from churnforge.plans.presets import BASE_NUMS, RESIDUALS
    from churnforge.sources import tables
    board, tr, sc = _automl(spark, sf)
    family = best_model(board, among=list(AUTOML_PARAMS) + ["logreg", "nb"])          # L22
    model = fit_final(tr, BASE_NUMS + RESIDUALS, "label", family, **AUTOML_PARAMS.get(family, {}))
    path = _scratch(spark, "best-model")
    tables.save_model(model, path)                                 # S10
    reloaded = tables.load_model(path)                             # S11
    return _reread(score_with(reloaded, sc, labels=["0", "1"]), path)      # S12: positive-class probability


@register("s9_run_metrics", with_orders(auc_sql("(SELECT * FROM score_tables WHERE split = 'train')", "model")) + """
SELECT 'bench-run' AS run_id, 'auc_' || model AS key,
       round(sum(pos * (neg_before + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS value FROM run GROUP BY model""")
def q_s9(spark, sf):
    from churnforge.sources import tables
    s = frames.score_tables(spark, sf).filter(F.col("split") == "train")
    aucs = {f"auc_{r['model']}": r["auc"] for r in metrics.auc(s, "label", "score", ["model"]).collect()}
    path = _scratch(spark, "run-metrics")
    back = tables.append_run_metrics(spark, path, "bench-run", aucs)
    return _reread(back.select("run_id", "key", r6(F.col("value").cast("double")).alias("value")), path)


def _mlp_oof(spark, sf):
    from churnforge.operators.models import crossfit
    from churnforge.plans.presets import BASE_NUMS, CATS, RESIDUALS
    from churnforge.session import cut_lineage
    f = clean.clean_frame(frames.order_frame(spark, sf), categorical=CATS)
    f = f.withColumns(fe.residual_features("total", "monthly", "tenure"))
    f = cut_lineage(f.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in RESIDUALS}).filter(F.col("split") == "train"))
    tr = folds.stratified_folds(f, "id", "label", k=3)
    return crossfit(tr, BASE_NUMS + RESIDUALS, "label", "id", "fold", 3, "mlp", onehot=CATS, scale=True, maxIter=20)[0]


@register("l7_mlp_crossfit_oof")
def q_l7(spark, sf):
    """L7 inputs as the reference's network has them: D2-scaled numbers and D4 one-hot categories, per fold."""
    return _mlp_oof(spark, sf)


@register("l7_mlp_oof_invariants", _oof_checks_sql(["mlp"], 3))
def q_l7_checks(spark, sf):
    return _checked(_mlp_oof(spark, sf))


# =============================================================== v19 / v20 pattern: bins -> all pair crosses -> fold TE
PAIR_SRC = CATS + [f"{c}_bin" for c in BINS]


def _bin_sql(c):
    return (f"CASE WHEN len({c}_e) >= 2 AND {c} >= {c}_e[1] AND {c} <= {c}_e[len({c}_e)] "
            f"THEN CAST(greatest(len(list_filter({c}_e, lambda x: x < {c})) - 1, 0) AS INTEGER) END")


def _pair_te_sql(k=5, smoothing=20.0, msl=20.0):
    from churnforge.functions.features import pair_names
    pairs = pair_names(PAIR_SRC)
    edges = "e AS (SELECT " + ", ".join(f"list_sort(list_distinct(quantile_cont({c}, {_plist(q)}))) AS {c}_e"
                                        for c, q in BINS.items()) + " FROM order_frame)"
    fb = ("fb AS (SELECT id, label, split, " + ", ".join(f"coalesce({c}, 'Missing') AS {c}" for c in CATS) + ", "
          + ", ".join(f"coalesce(CAST({_bin_sql(c)} AS VARCHAR), 'Missing') AS {c}_bin" for c in BINS)
          + " FROM order_frame, e)")
    pr = ("pr AS (SELECT id, label, split, " + ", ".join(f"{a} || '_X_' || {b} AS {n}" for n, a, b in pairs)
          + " FROM fb)")
    lf = "lf AS (" + "\n  UNION ALL ".join(f"SELECT fold, label, '{n}' AS feature, {n} AS key FROM tr"
                                           for n, _a, _b in pairs) + ")"
    rest = te_map_sql(k, smoothing, msl)[3:]  # per_fold .. te, reading lf and tr
    return with_orders(edges, fb, pr, folds_cte(k=k, source="pr"), "tr AS (SELECT * FROM folded)", lf, *rest)


@register("e11_d6_d7_pair_te_fold_map", _pair_te_sql() + """
SELECT fold, feature, key, n, round(enc, 6) AS enc FROM te""")
def q_pair_te(spark, sf):
    f = _orders(spark, sf)
    binned = encode.apply_quantile_bins_multi(f, encode.fit_quantile_bins_multi(f, BINS), list(BINS))
    filled = clean.clean_frame(binned.select("id", "label", "split", *PAIR_SRC), categorical=PAIR_SRC)
    pairs = fe.all_pair_crosses(PAIR_SRC, sep="_X_", null_rule="fill")
    wide = filled.select("id", "label", "split", *[v.alias(n) for n, v in pairs.items()])
    tr = folds.stratified_folds(wide.filter(F.col("split") == "train"), "id", "label", k=5)
    m = encode.fit_fold_target_encoder(tr, list(pairs), "label", "fold", 5, smoothing=20.0, min_samples_leaf=20.0)
    return m.select(F.col("fold").cast("int"), "feature", "key", F.col("n").cast("long"), r6("enc").alias("enc"))


def _pair171_sql(k=5, smoothing=20.0, msl=20.0):
    from churnforge.functions.features import pair_names
    src = [*frames.PAIR_CATEGORIES, *(f"{c}_bin" for c in frames.PAIR_BINS)]
    pairs = pair_names(src)
    ctes = [
        "places AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)",
        "fl AS (SELECT l_orderkey, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey "
        "ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) t WHERE rn = 1)",
        "cf AS (SELECT f.*, CAST(year(o.o_orderdate) AS VARCHAR) AS year, CAST(month(o.o_orderdate) AS VARCHAR) AS month, "
        "CAST(dayofweek(o.o_orderdate) + 1 AS VARCHAR) AS weekday, h.r_name AS region, p_brand AS brand, p_type AS type, "
        "CAST(p_size AS VARCHAR) AS size, sp.n_name AS supp_nation, sp.r_name AS supp_region, s_acctbal AS supp_acctbal, "
        "p_retailprice AS retail FROM order_frame f JOIN orders o ON f.id = o.o_orderkey LEFT JOIN places h ON h.n_name = f.nation "
        "LEFT JOIN fl ON fl.l_orderkey = f.id LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey "
        "LEFT JOIN places sp ON sp.n_nationkey = s_nationkey)",
        "e AS (SELECT " + ", ".join(f"list_sort(list_distinct(quantile_cont({c}, {_plist(q)}))) AS {c}_e"
                                    for c, q in frames.PAIR_BINS.items()) + " FROM cf)",
        "fb AS (SELECT id, label, split, " + ", ".join(f"coalesce({c}, 'Missing') AS {c}" for c in frames.PAIR_CATEGORIES) + ", "
        + ", ".join(f"coalesce(CAST({_bin_sql(c)} AS VARCHAR), 'Missing') AS {c}_bin" for c in frames.PAIR_BINS) + " FROM cf, e)",
        "pr AS (SELECT id, label, split, " + ", ".join(f"{a} || '_X_' || {b} AS {n}" for n, a, b in pairs) + " FROM fb)",
        folds_cte(k=k, source="pr"), "tr AS (SELECT * FROM folded)",
        "lf AS (SELECT fold, label, feature, key FROM (UNPIVOT (SELECT fold, label, " + ", ".join(n for n, _a, _b in pairs)
        + " FROM tr) ON " + ", ".join(n for n, _a, _b in pairs) + " INTO NAME feature VALUE key))"]
    return with_orders(*ctes, *te_map_sql(k, smoothing, msl)[3:])


def _pair171_train(spark, sf, k=5):
    from churnforge.session import cut_lineage
    f = cut_lineage(frames.category_frame(spark, sf))                       # bins, folds and rows read one evaluation
    bins = frames.PAIR_BINS
    src = [*frames.PAIR_CATEGORIES, *(f"{c}_bin" for c in bins)]
    binned = encode.apply_quantile_bins_multi(f, encode.fit_quantile_bins_multi(f, bins), list(bins))
    filled = clean.clean_frame(binned.select("id", "label", "split", *src), categorical=src)
    tr = cut_lineage(folds.stratified_folds(filled.filter(F.col("split") == "train"), "id", "label", k=k))
    pairs = fe.all_pair_crosses(src, sep="_X_", null_rule="fill")           # crosses are built after the folds
    return tr.select("id", "label", "fold", *[v.alias(n) for n, v in pairs.items()]), list(pairs)


@register("e11_d7_pair171_te_fold_map", _pair171_sql() + """
SELECT fold, feature, key, n, round(enc, 6) AS enc FROM te""")
def q_pair171(spark, sf):
    """The reference's full width: 19 sources, 171 pairs, leave-fold-out maps of all of them in one pass."""
    tr, pairs = _pair171_train(spark, sf)
    m = encode.fit_fold_target_encoder(tr, pairs, "label", "fold", 5, smoothing=20.0, min_samples_leaf=20.0)
    return m.select(F.col("fold").cast("int"), "feature", "key", F.col("n").cast("long"), r6("enc").alias("enc"))


@register("d7_pair171_apply_fold0", _pair171_sql() + """
SELECT tr.id, round(sum(coalesce(te.enc, p.prior)), 6) AS enc_sum FROM (UNPIVOT tr ON COLUMNS('PAIR_.*') INTO NAME feature VALUE key) tr
CROSS JOIN (SELECT max(prior) AS prior FROM te WHERE fold = 0) p
LEFT JOIN te ON te.fold = 0 AND te.feature = tr.feature AND te.key = tr.key GROUP BY tr.id""")
def q_pair171_apply(spark, sf):
    """All 171 encodings of a row by one pass over the rows, checked by their sum."""
    tr, pairs = _pair171_train(spark, sf)
    m = encode.fit_fold_target_encoder(tr, pairs, "label", "fold", 5, smoothing=20.0, min_samples_leaf=20.0)
    out = encode.apply_target_encoding(tr, m, pairs, fold=0, keep=["id"])
    return out.select("id", r6(sum((F.col(f"{n}_te") for n in pairs), F.lit(0.0))).alias("enc_sum"))


@register("l6_pair_te_logreg_oof")
def q_l6(spark, sf):
    from churnforge.plans.presets import pair_logreg_oof
    oof, _ = pair_logreg_oof(spark, sf, k=3, C=0.1)
    return oof


@register("ref_distribution_booster_calibrated")
def q_refdist_booster(spark, sf):
    from churnforge.plans.presets import reference_distribution_booster
    _oof, calibrated = reference_distribution_booster(spark, sf, k=3, max_iter=10)
    return calibrated


# K2/K3 apply against fixed centroids (per-segment means of the training rows, in segment order),
# so the distance and argmin expressions get an exact SQL check; the k-means fit itself is rows-only.
KCOLS = ["tenure", "monthly", "total"]


def _kcentroid_sql():
    dist = " + ".join(f"pow({c} - c_{c}, 2)" for c in KCOLS)
    return [
        "cen AS (SELECT CAST(row_number() OVER (ORDER BY segment) - 1 AS INTEGER) AS j, "
        + ", ".join(f"avg({c}) AS c_{c}" for c in KCOLS) + " FROM order_frame WHERE split = 'train' GROUP BY segment)",
        f"dl AS (SELECT o.id, cen.j, sqrt(0.0 + {dist}) AS d FROM order_frame o CROSS JOIN cen)",
        "am AS (SELECT id, j FROM (SELECT id, j, row_number() OVER (PARTITION BY id ORDER BY d, j) AS rn FROM dl) t WHERE rn = 1)",
    ]


@register("k2_k3_fixed_centroid_distances", with_orders(*_kcentroid_sql()) + "SELECT dl.id, " + ", ".join(
    f"round(max(CASE WHEN dl.j = {j} THEN dl.d END), 6) AS kmeans_dist_{j}" for j in range(5))
    + ", CAST(any_value(am.j) AS VARCHAR) AS kmeans_cluster_id FROM dl JOIN am ON dl.id = am.id GROUP BY dl.id")
def q_k2_fixed(spark, sf):
    from churnforge.operators.cluster import centroid_distances, nearest_cluster
    f = _orders(spark, sf)
    # k x d centroids (here 5 x 3): bounded, read once
    cen = f.filter(F.col("split") == "train").groupBy("segment").agg(*[F.avg(c).alias(c) for c in KCOLS]) \
        .orderBy("segment").collect()
    centers = [[r[c] for c in KCOLS] for r in cen]
    out = centroid_distances(f.select("id", *KCOLS), centers, cols=KCOLS)
    out = out.withColumn("kmeans_cluster_id", nearest_cluster(len(centers)))
    return out.select("id", *[r6(f"kmeans_dist_{j}").alias(f"kmeans_dist_{j}") for j in range(len(centers))],
                      "kmeans_cluster_id")


from churnforge.plans import model_queries  # noqa: E402, F401 (registers its queries)
