"""Quantile sketches as saved, mergeable fitted state (A4, D6, E15 by batches).

One KLL sketch per feature (and group): built batch by batch with map-side combine, kept as a small table, merged
without looking at the rows again. An edge at p has a true rank within ``rank_error(k)`` of p with 99 % confidence,
whatever the number of rows and batches; the exact form is quantiles.exact_quantiles."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_K = 800


def rank_error(k: int = DEFAULT_K) -> float:
    """Normalised rank error of one quantile of a KLL sketch (fixed values: the published fit for 99 %)."""
    return 2.296 / k ** 0.9723


def fit_sketches(df: DataFrame, cols, group_cols=(), k: int = DEFAULT_K) -> DataFrame:
    """(group..., feature, n, sketch): numbers that are null or NaN do not count; a feature without any number
    has no row."""
    group_cols = list(group_cols)
    x = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    long = df.select(*group_cols, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), x(c).alias("x")) for c in cols])).alias("_kv")) \
        .select(*group_cols, "_kv.feature", "_kv.x").filter(F.col("x").isNotNull())
    return long.groupBy(*group_cols, "feature").agg(F.count("x").alias("n"), F.kll_sketch_agg_double("x", F.lit(k)).alias("sketch"))


def merge_sketches(parts, group_cols=(), k: int = DEFAULT_K) -> DataFrame:
    """One table of the same form from those of several batches."""
    whole = functools.reduce(DataFrame.unionByName, parts)
    return whole.groupBy(*group_cols, "feature").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def sketch_quantiles(fitted: DataFrame, probs, group_cols=()) -> DataFrame:
    """(group..., feature, n, p, q): values of the sketched numbers, not interpolated."""
    each = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("q")) for p in probs])
    return fitted.select(*group_cols, "feature", "n", F.explode(each).alias("_pq")).select(*group_cols, "feature", "n", "_pq.p", "_pq.q")


def sketch_bins(fitted: DataFrame, bins: dict) -> DataFrame:
    """(feature, edges) for encode.apply_quantile_bins_multi: the form of encode.fit_quantile_bins_multi."""
    rows = [sketch_quantiles(fitted.filter(F.col("feature") == c), [i / q for i in range(q + 1)]) for c, q in bins.items()]
    return functools.reduce(DataFrame.unionByName, rows).groupBy("feature").agg(
        F.array_sort(F.array_distinct(F.collect_list("q"))).alias("edges"))


def true_ranks(df: DataFrame, quantiles: DataFrame, cols) -> DataFrame:
    """(feature, p, below, upto): the shares of a feature's numbers under its edge, and up to it. The edges are
    few; every row is counted against the edges of its feature in one pass."""
    edges = {}
    for r in quantiles.select("feature", "p", "q").collect():           # features x probabilities
        edges.setdefault(r["feature"], []).append((r["p"], r["q"]))
    wanted = [(c, p, q) for c in cols for p, q in edges.get(c, [])]
    x = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols}
    counts = df.agg(*[F.count(x[c]).alias(f"n{i}") for i, (c, _, _) in enumerate(wanted)],
                    *[F.count_if(x[c] < F.lit(q)).alias(f"b{i}") for i, (c, _, q) in enumerate(wanted)],
                    *[F.count_if(x[c] <= F.lit(q)).alias(f"u{i}") for i, (c, _, q) in enumerate(wanted)])
    return counts.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("feature"), F.lit(p).alias("p"), (F.col(f"b{i}") / F.col(f"n{i}")).alias("below"),
        (F.col(f"u{i}") / F.col(f"n{i}")).alias("upto")) for i, (c, p, _) in enumerate(wanted)])).alias("r")).select("r.*")
