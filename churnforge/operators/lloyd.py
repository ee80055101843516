"""Lloyd's iterations of many k-means fits by shared passes (K1, K6).

Spark's KMeans draws the starts (k-means||); a fit of its own then costs one job for each iteration, and a scan over k
with restarts some thousand jobs over the same rows. Here the rows are packed once into blocks of columns, and one
pass over the blocks moves the centres of every fit that still moves. A fit takes the same steps as Spark's: nearest
centre, mean of its rows (a centre without rows stays), the end when no centre moved by more than ``tol``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from churnforge.session import cut_lineage

#: Rows of a block (its distances to some tens of centres stay in a core's cache), and bytes of all tasks' sums that are
#: added on the driver; more are added by tasks before.
BLOCK_ROWS = 2048
MAX_SUMS_BYTES = 64 << 20


def pack(vectors: DataFrame, features: str = "features"):
    """An RDD of (block, its rows): up to BLOCK_ROWS vectors as one block of doubles, a line for each component and a last line of
    ones. The blocks are spread evenly over the cores and held by a checkpoint. ``vectors`` must be cheap to read twice."""
    from pyspark.ml.functions import vector_to_array
    most = BLOCK_ROWS

    def blocks(batches):
        for batch in batches:
            column = batch.column(0)
            for at in range(0, len(column), most):
                part = column.slice(at, most)
                lines = np.concatenate([part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1).T, np.ones((1, len(part)))])
                yield pa.RecordBatch.from_arrays([pa.array([lines.tobytes()], pa.binary()), pa.array([lines.shape[1]], pa.int32())],
                                                 names=["block", "width"])

    packed = vectors.select(vector_to_array(features).alias("x")).mapInArrow(blocks, "block binary, width int")
    tasks = max(vectors.rdd.getNumPartitions(), 2 * vectors.sparkSession.sparkContext.defaultParallelism)
    return cut_lineage(packed.repartition(max(1, min(tasks, vectors.count() // most)))).rdd


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a line of 0 and 1 for each centre: the rows nearest to it; the squared distances less the rows' own squares)."""
    d = np.concatenate([-2.0 * centers, (centers * centers).sum(axis=1, keepdims=True)], axis=1) @ x
    least = d.min(axis=0)
    own = (d == least).astype(np.float64)
    if own.sum() != x.shape[1]:                                # the first of equal centres
        first = own.argmax(axis=0)
        own[:] = 0.0
        own[first, np.arange(x.shape[1])] = 1.0
    return own, least


def summed(blocks, job, size: int) -> np.ndarray | None:
    """The sum of ``job(block)``, an array of doubles of ``size`` bytes, over all (block, width); None without rows."""
    def added(arrays):
        total = None
        for a in arrays:
            total = a.copy() if total is None else np.add(total, a, out=total)
        return [] if total is None else [total]

    def step(rows):
        return added(job(np.frombuffer(r[0], np.float64).reshape(-1, r[1])) for r in rows)

    sums = blocks.mapPartitions(step)
    tasks = blocks.getNumPartitions()
    if tasks * size > MAX_SUMS_BYTES:
        sums = sums.repartition(max(1, MAX_SUMS_BYTES // (2 * size), int(tasks ** 0.5))).mapPartitions(added)
    return next(iter(added(sums.collect())), None)


def _summed(blocks, job, given) -> np.ndarray | None:
    size = 8 * sum(len(c) * (c.shape[1] + 1) + 1 for c in given[0])
    return summed(blocks, lambda block: job(block, given), size)


def _moved(x: np.ndarray, given) -> np.ndarray:
    """For each fit: the sums and counts of its centres' rows, then its cost."""
    squares, out = float((x[:-1] * x[:-1]).sum()), []
    for centers in given[0]:
        own, least = _nearest(x, centers)
        out += [(own @ x.T).ravel(), [squares + least.sum()]]
    return np.concatenate(out)


def _parts(total: np.ndarray, centers):
    """The arrays of each fit of a summed pass: (k x (components + 1), one number)."""
    at = 0
    for c in centers:
        size = len(c) * (c.shape[1] + 1)
        yield total[at:at + size].reshape(len(c), -1), total[at + size]
        at += size + 1


def lloyd(blocks, starts, max_iter: int = 300, tol: float = 1e-4) -> list[tuple[float, np.ndarray]]:
    """(cost, centres) of each fit; the cost is that of the last iteration's assignment, as Spark reports it."""
    centers, costs = [np.array(s, dtype=np.float64) for s in starts], [0.0] * len(starts)
    live = list(range(len(centers)))
    for _ in range(max_iter):
        if not live:
            break
        total = _summed(blocks, _moved, ([centers[i] for i in live],))
        if total is None:
            break
        still = []
        for i, (sums, cost) in zip(live, list(_parts(total, [centers[i] for i in live])), strict=True):
            count = sums[:, -1:]
            new = np.where(count > 0, sums[:, :-1] / np.maximum(count, 1.0), centers[i])
            if (((new - centers[i]) ** 2).sum(axis=1) > tol * tol).any():
                still.append(i)
            centers[i], costs[i] = new, float(cost)
        live = still
    return list(zip(costs, centers, strict=True))


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((x[:-1] * x[:-1]).sum(axis=0))
    return np.concatenate([x[:-1] / np.where(norm > 0, norm, 1.0), x[-1:]]), norm


def _unit_sums(x: np.ndarray, given) -> np.ndarray:
    """For each fit: the sums of its clusters' unit vectors and their sizes (and a number of no use)."""
    unit, out = _units(x)[0], []
    for centers in given[0]:
        out += [(_nearest(x, centers)[0] @ unit.T).ravel(), [0.0]]
    return np.concatenate(out)


def _silhouette_sums(x: np.ndarray, given) -> np.ndarray:
    """For each fit: the sum of its rows' silhouettes; at the end the number of rows."""
    (unit, norm), out = _units(x), []
    for centers, sums in zip(*given, strict=True):
        used = sums[:, -1] > 0
        own, size = _nearest(x, centers)[0][used] > 0, sums[used, -1:]
        away = 1.0 - (sums[used, :-1] @ unit[:-1]) / size
        n = (own * size).sum(axis=0)
        a = ((away * own).sum(axis=0) * n - (norm <= 0)) / np.maximum(n - 1.0, 1.0)
        b = np.where(own, np.inf, away).min(axis=0)
        most = np.maximum(a, b)
        known = (n > 1) & np.isfinite(b) & (most != 0)
        out.append(float(np.divide(b - a, most, out=np.zeros(len(n)), where=known).sum()))
    return np.array([*out, float(x.shape[1])])


def mean_silhouettes(blocks, fits) -> list[float]:
    """R4 for several fits by two passes: the mean cosine silhouette of all rows (cluster.silhouettes), every row in the
    cluster of its nearest centre."""
    centers = [np.array(c, dtype=np.float64) for c in fits]
    total = _summed(blocks, _unit_sums, (centers,))
    if total is None:
        return [float("nan")] * len(centers)
    sums = [s for s, _ in _parts(total, centers)]
    out = _summed(blocks, _silhouette_sums, (centers, sums))
    return [float(s / out[-1]) for s in out[:-1]]
