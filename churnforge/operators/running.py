"""Skew-safe running sums over a global order.

A window ``orderBy`` with no partition (or a partition that may hold a third of
all rows) funnels every row through one task. Instead:

1. range-partition the rows on (group, order) into N partitions;
2. sum each partition per group (a table of at most N rows per group);
3. turn those into per-partition offsets with a window over that small table;
4. run the window inside each (partition, group) slice and add the offset.

Every slice is bounded by the range-partition size, so no task sees more than
about 1/N of the rows, whatever the key distribution of the group columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnforge.session import cut_lineage, shuffle_partitions

PID = "_range_pid"


def prefix_sums(df: DataFrame, order_cols, sum_cols, group_cols=(), num_partitions: int | None = None,
                inclusive: bool = False, suffix: str = "_before", total_suffix: str | None = None) -> DataFrame:
    """Add ``<c><suffix>`` = sum of ``c`` over rows strictly before (or up to, if inclusive)
    each row in ``order_cols`` order, restarting per ``group_cols``; with ``total_suffix`` also the
    group's sum. Order keys should be unique within a group (reduce to distinct values first, or add
    a tie-breaker). Hand over narrow rows: every column of ``df`` is shuffled and checkpointed.

    The range-partitioned rows and their partition number are written to a reliable checkpoint: the
    totals and the windows then read one assignment of rows to partitions (two range exchanges would
    sample their own bounds), nothing stays cached, and the files go with the frame."""
    spark = df.sparkSession
    order_cols, sum_cols, group_cols = list(order_cols), list(sum_cols), list(group_cols)
    n = num_partitions or shuffle_partitions(spark)
    ranged = cut_lineage(df.repartitionByRange(n, *[F.col(c) for c in group_cols + order_cols])
                         .withColumn(PID, F.spark_partition_id()))
    totals = ranged.groupBy(PID, *group_cols).agg(*[F.sum(c).alias(f"{c}__pt") for c in sum_cols])
    w_all = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy(F.lit(0))
    w_off = w_all.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(PID).alias("_off_pid"), *[F.col(c).alias(f"{c}__g") for c in group_cols],
                            *[F.coalesce(F.sum(f"{c}__pt").over(w_off), F.lit(0)).alias(f"{c}__off") for c in sum_cols],
                            *([F.sum(f"{c}__pt").over(w_all).alias(f"{c}__all") for c in sum_cols] if total_suffix else []))
    if not group_cols:
        offsets = F.broadcast(offsets)  # at most N rows: one per range partition
    cond = F.col(PID) == F.col("_off_pid")
    for c in group_cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"{c}__g"))
    joined = ranged.join(offsets, cond, "inner")
    frame = (Window.unboundedPreceding, 0) if inclusive else (Window.unboundedPreceding, -1)
    w_in = Window.partitionBy(PID, *group_cols).orderBy(*order_cols).rowsBetween(*frame)
    return joined.select(*df.columns,
                         *[(F.coalesce(F.sum(c).over(w_in), F.lit(0)) + F.col(f"{c}__off")).alias(c + suffix) for c in sum_cols],
                         *([F.col(f"{c}__all").alias(c + total_suffix) for c in sum_cols] if total_suffix else []))


def row_numbers(df: DataFrame, order_cols, group_cols=(), out: str = "row_idx",
                num_partitions: int | None = None) -> DataFrame:
    """0-based row number in ``order_cols`` order per group, without a single-task window."""
    tmp = "_one_for_rownum"
    res = prefix_sums(df.withColumn(tmp, F.lit(1).cast("long")), order_cols, [tmp], group_cols,
                      num_partitions=num_partitions)
    return res.withColumnRenamed(tmp + "_before", out).drop(tmp)
