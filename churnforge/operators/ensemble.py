"""Combining prediction tables (L11-L17, A8, A11). Prediction tables are long
(model, id, score); every combination is an aggregation keyed by id."""

from __future__ import annotations

import functools
import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnforge.functions.clean import clip
from churnforge.operators.metrics import auc, average_rank
from churnforge.session import cut_lineage


def fold_average(fold_preds: DataFrame, id_col: str = "id", score: str = "score") -> DataFrame:
    """Mean of the K fold models' scores per id."""
    return fold_preds.groupBy(id_col).agg(F.avg(score).alias(score))


def wide_scores(long: DataFrame, models, id_col: str = "id", score: str = "score", keep=()) -> DataFrame:
    """(id, keep..., s_<model>...) from the long table; one shuffle keyed by id."""
    return long.groupBy(id_col, *keep).agg(*[F.max(F.when(F.col("model") == m, F.col(score))).alias(f"s_{m}")
                                              for m in models])


def require_models(long: DataFrame, models, id_col: str = "id") -> None:
    """J3 for a long table: stop if any id lacks one of the models or has one of them twice."""
    n = len(set(models))
    per_id = long.filter(F.col("model").isin(*models)).groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("model").alias("n_models"))
    bad = per_id.filter((F.col("n") != n) | (F.col("n_models") != n))
    if not bad.isEmpty():
        raise ValueError(f"prediction tables have different ids, for example {bad.select(id_col).first()[0]}")


def _check_uneven(uneven: str) -> None:
    if uneven not in ("error", "report"):
        raise ValueError("uneven is 'error' or 'report'")


def weighted_blend(long: DataFrame, weights: dict, id_col: str = "id", score: str = "score",
                   normalise: bool = True, uneven: str = "error") -> DataFrame:
    """Per-id weighted sum (weights normalised to sum 1). Ids that lack a weighted model stop
    the blend, or with ``uneven='report'`` stay with a null score; n_models counts what an id has."""
    _check_uneven(uneven)
    if uneven == "error":
        require_models(long, list(weights), id_col)
    total = float(sum(weights.values())) if normalise else 1.0
    w = F.create_map(*[x for m, v in weights.items() for x in (F.lit(m), F.lit(float(v) / total))])
    needed = sum(1 for v in weights.values() if v)
    part = long.filter(F.col("model").isin(*weights.keys()))
    weight = F.try_element_at(w, F.col("model"))
    out = part.groupBy(id_col).agg(
        F.sum(F.when(weight != 0, F.col(score) * weight)).alias("_sum"),
        F.count(F.when((weight != 0) & F.col(score).isNotNull(), F.lit(1))).alias("n_models"))
    whole = F.when(F.col("n_models") == needed, F.col("_sum")).alias(score)
    return out.select(id_col, whole) if uneven == "error" else out.select(id_col, whole, "n_models")


def equal_blend(long: DataFrame, id_col: str = "id", score: str = "score") -> DataFrame:
    """Plain mean over models."""
    return long.groupBy(id_col).agg(F.avg(score).alias(score))


def fixed_blends(first: DataFrame, second: DataFrame, variants, id_col: str = "id", score: str = "score",
                 uneven: str = "error") -> DataFrame:
    """Several two-table blends at once, tagged by a variant name such as '95_05'. Tables with
    different ids stop the blend (J3); with ``uneven='report'`` every id of either table stays and one
    that lacks a table has a null score. The variants are a fixed small list expanded per row."""
    from churnforge.operators.joins import require_same_ids
    _check_uneven(uneven)
    if uneven == "error":
        require_same_ids(first, second, id_col)
    pair = first.select(id_col, F.col(score).alias("_a")).join(second.select(id_col, F.col(score).alias("_b")), id_col, "full")
    arr = F.array(*[F.struct(F.lit(f"{int(round(a * 100)):02d}_{int(round(b * 100)):02d}").alias("variant"),
                             F.lit(float(a)).alias("wa"), F.lit(float(b)).alias("wb")) for a, b in variants])
    ex = pair.select(id_col, "_a", "_b", F.explode(arr).alias("_v"))
    return ex.select("_v.variant", id_col, (F.col("_a") * F.col("_v.wa") + F.col("_b") * F.col("_v.wb")).alias(score))


def rank_power_average(long: DataFrame, power: float = 2.5, id_col: str = "id", score: str = "score",
                       table_col: str = "model") -> DataFrame:
    """L16 (W1 + W2 + A11): per table, average-tie rank / n raised to ``power``; mean over tables."""
    ranked = average_rank(long, score, [table_col], out="_rp", power=power)
    return ranked.groupBy(id_col).agg(F.avg("_rp").alias(score), F.count(F.lit(1)).alias("n_tables"))


def calibrate(preds: DataFrame, base_rate, score: str = "score", lo: float = 0.0001, hi: float = 0.9999) -> DataFrame:
    """Scale scores so their mean equals the training base rate, then clip. Null and NaN scores do
    not count in the mean and stay without a score (null).
    ``base_rate`` is a number or a one-value Column (scalar subquery). The predictions are evaluated once:
    the mean and the rows read one checkpoint."""
    preds = cut_lineage(preds)
    mean = preds.select(F.avg(F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double")))).scalar()
    rate = base_rate if not isinstance(base_rate, (int, float)) else F.lit(float(base_rate))
    return preds.withColumn(score, clip(F.try_divide(F.col(score) * rate, mean), lo, hi))


def simplex_grid(n_models: int, step: float, centre=None, reach: float = 1.0):
    """Weight vectors on the simplex with the given step (step 0.1, 3 models -> 66 points), in
    lexicographic order; with ``centre``, only those within ``reach`` of it in every weight. Only the
    points asked for are made: each weight's range leaves room for the ranges of those after it."""
    k = int(round(1 / step))
    bounds = [(0, k)] * n_models
    if centre is not None:
        bounds = [(max(0, math.ceil((c - reach) * k - 1e-6)), min(k, math.floor((c + reach) * k + 1e-6))) for c in centre]
    least = [sum(lo for lo, _ in bounds[i:]) for i in range(n_models + 1)]
    most = [sum(hi for _, hi in bounds[i:]) for i in range(n_models + 1)]

    def rest(i: int, left: int):
        if i == n_models:
            yield ()
            return
        for first in range(max(bounds[i][0], left - most[i + 1]), min(bounds[i][1], left - least[i + 1]) + 1):
            for tail in rest(i + 1, left - first):
                yield (first, *tail)

    return [tuple(round(x / k, 10) for x in p) for p in rest(0, k)]


def blend_grid_auc(oof_long: DataFrame, models, grid, label: str = "label", id_col: str = "id",
                   score: str = "score", num_bins: int | None = None, chunk: int = 16, parallelism: int = 4) -> DataFrame:
    """L12 core: AUC of every weight vector in ``grid``. Every id must have every model once. Rows are
    first reduced to distinct score combinations with positive / negative counts; the grid is taken in
    chunks of fixed size, expanded per combination, and the AUC is grouped by weight id (skew-safe
    running sums per group), so at most ``chunk`` x ``parallelism`` copies of the combinations exist at a time.
    ``num_bins`` bins the blends first (metrics.auc): then a chunk shuffles chunk x num_bins rows at
    most, whatever the data size."""
    return _grid_auc(_score_cells(cut_lineage(oof_long), models, label, id_col, score), models, grid, num_bins, chunk, parallelism)


def _score_cells(oof_long: DataFrame, models, label: str, id_col: str, score: str) -> DataFrame:
    """Distinct score combinations with positive / negative counts: rows sharing all model scores blend identically."""
    require_models(oof_long, models, id_col)
    wide = wide_scores(oof_long, models, id_col, score, keep=[label])
    y = F.col(label).cast("long")
    return cut_lineage(wide.filter(F.col(label).isNotNull()).groupBy(*[f"s_{m}" for m in models]).agg(
        F.sum(y).alias("_pos"), F.sum(F.lit(1) - y).alias("_neg")))


def _grid_auc(cells: DataFrame, models, grid, num_bins: int | None = None, chunk: int = 16, parallelism: int = 4) -> DataFrame:
    """AUC of every weight vector over the counted score combinations."""
    blend = sum((F.col(f"_g.w_{m}") * F.col(f"s_{m}") for m in models), F.lit(0.0))

    def one_chunk(at: int) -> DataFrame:
        arr = F.array(*[F.struct(F.lit(at + i).alias("wid"), *[F.lit(float(w)).alias(f"w_{m}") for w, m in zip(ws, models)])
                        for i, ws in enumerate(grid[at:at + chunk])])
        ex = cells.select("_pos", "_neg", *[f"s_{m}" for m in models], F.explode(arr).alias("_g"))
        scored = ex.select("_g.*", "_pos", "_neg", blend.alias("_blend"))
        res = auc(scored, "_pos", "_blend", ["wid"] + [f"w_{m}" for m in models], counts=("_pos", "_neg"), num_bins=num_bins)
        return cut_lineage(res.select("wid", *[f"w_{m}" for m in models], "auc"))      # chunk rows

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, -(-len(grid) // chunk)))) as pool:
        results = list(pool.map(one_chunk, range(0, len(grid), chunk)))
    return functools.reduce(DataFrame.unionByName, results)


def search_blend_weights(oof_long: DataFrame, models, label: str = "label", step: float = 0.1,
                         refine_step: float = 0.02, id_col: str = "id", score: str = "score"):
    """Coarse simplex grid, then a finer grid around the best point, both over one table of counted score
    combinations. Returns (weights dict, auc)."""
    cells = _score_cells(cut_lineage(oof_long), models, label, id_col, score)
    coarse = _grid_auc(cells, models, simplex_grid(len(models), step))
    best = coarse.orderBy(F.desc("auc"), "wid").first()
    centre = [best[f"w_{m}"] for m in models]
    fine = simplex_grid(len(models), refine_step, centre, step)
    res = _grid_auc(cells, models, fine).orderBy(F.desc("auc"), "wid").first()
    return {m: res[f"w_{m}"] for m in models}, res["auc"]


def select_models(oof_long: DataFrame, models, label: str = "label", rounds: int = 20, num_bins: int = 1000, id_col: str = "id",
                  score: str = "score"):
    """L12 / L22 for any number of models: greedy forward selection with repetition. Starting from nothing, each
    round adds the model whose score, averaged in, gives the highest AUC (of equal ones the first listed); the
    weights are the shares of the picks up to the round with the highest AUC.

    A round is one pass: a row gives one bin of 1 / num_bins per candidate, and only counts per (candidate, bin)
    are shuffled, so memory follows candidates x bins and not the rows. Scores are in 0..1; every id must have
    every model once. Returns (picks DataFrame(round, model, auc), weights dict)."""
    models = list(models)
    require_models(oof_long, models, id_col)
    y = F.col(label).cast("long")
    wide = wide_scores(oof_long, models, id_col, score, keep=[label]).filter(F.col(label).isNotNull())
    # rows sharing all scores blend alike: count them once
    cells = cut_lineage(wide.groupBy(*[f"s_{m}" for m in models]).agg(F.sum(y).alias("_pos"), F.sum(F.lit(1) - y).alias("_neg")))
    spark, picks, aucs = oof_long.sparkSession, [], []
    for r in range(1, rounds + 1):
        held = sum((F.col(f"s_{m}") * picks.count(m) for m in dict.fromkeys(picks)), F.lit(0.0))
        tries = F.array(*[F.struct(F.lit(i).alias("at"), F.floor((held + F.col(f"s_{m}")) / F.lit(float(r)) * num_bins).alias("bin"))
                          for i, m in enumerate(models)])
        binned = cells.select("_pos", "_neg", F.explode(tries).alias("t")).select("t.at", F.col("t.bin").cast("double").alias("bin"), "_pos", "_neg")
        table = auc(binned, label, "bin", ["at"], counts=("_pos", "_neg"))
        best = max(table.select("at", "auc").collect(), key=lambda x: (x["auc"] if x["auc"] is not None else -1.0, -x["at"]))
        picks.append(models[best["at"]])
        aucs.append(best["auc"])
    last = max(range(rounds), key=lambda i: (aucs[i] if aucs[i] is not None else -1.0, -i))
    chosen = picks[:last + 1]
    rows = [(i + 1, m, a) for i, (m, a) in enumerate(zip(picks, aucs, strict=True))]
    return (spark.createDataFrame(rows, "round int, model string, auc double"),
            {m: chosen.count(m) / len(chosen) for m in models if m in chosen})
