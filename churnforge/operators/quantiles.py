"""Exact quantiles with linear interpolation (pandas / numpy 'linear', SQL quantile_cont),
computed without funnelling a column through one task.

Rows are reduced to (group, value, count); a skew-safe running count gives each distinct value
the row positions it covers; each probability p needs the values at positions floor(p(n-1)) and
ceil(p(n-1)), which only a handful of rows cover. Spark's exact ``percentile`` would instead
gather every distinct value of a group into one aggregation buffer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnforge.operators.running import prefix_sums


def exact_quantiles(df: DataFrame, col: str, probs, group_cols=(), counts: str | None = None) -> DataFrame:
    """Rows (group..., p, q) with q the linear-interpolated quantile of ``col`` at p (nulls ignored);
    with ``counts``, a row stands for that many."""
    group_cols = list(group_cols)
    probs = [float(p) for p in probs]
    dist = (df.filter(F.col(col).isNotNull())
              .groupBy(*group_cols, F.col(col).cast("double").alias("_v"))
              .agg((F.sum(counts) if counts else F.count(F.lit(1))).alias("_c")))
    run = prefix_sums(dist, ["_v"], ["_c"], group_cols, total_suffix="_total").withColumnRenamed("_c_total", "_n")
    lo_of = lambda p: F.floor(p * (F.col("_n") - 1))
    hi_of = lambda p: F.ceil(p * (F.col("_n") - 1))
    first, last = F.col("_c_before"), F.col("_c_before") + F.col("_c") - 1
    covers = lambda pos: (pos >= first) & (pos <= last)
    hits = run.select(*group_cols, "_v", "_n", F.explode(F.filter(
        F.array(*[F.lit(p) for p in probs]),
        lambda p: covers(lo_of(p)) | covers(hi_of(p)))).alias("p"), first.alias("_first"), last.alias("_last"))
    lo, hi = lo_of(F.col("p")), hi_of(F.col("p"))
    agg = hits.groupBy(*group_cols, "p").agg(
        F.max(F.when((lo >= F.col("_first")) & (lo <= F.col("_last")), F.col("_v"))).alias("_vlo"),
        F.max(F.when((hi >= F.col("_first")) & (hi <= F.col("_last")), F.col("_v"))).alias("_vhi"),
        F.first("_n").alias("_n"))
    frac = F.col("p") * (F.col("_n") - 1) - F.floor(F.col("p") * (F.col("_n") - 1))
    return agg.select(*group_cols, "p", (F.col("_vlo") + frac * (F.col("_vhi") - F.col("_vlo"))).alias("q"))

