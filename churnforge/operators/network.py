"""The network (L7): Spark's MultilayerPerceptronClassifier with its gradients by matrix products over packed rows.

Spark gives the first weights, the loss and the model; here the rows are packed once, and each evaluation of the loss is
one pass over the packed rows, a matrix product for each layer and block. The optimiser is the same limited-memory BFGS
with a strong Wolfe line search, the loss the same mean over blocks of ``blockSize`` rows of a partition."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from churnforge.operators import lloyd
from churnforge.session import cut_lineage

#: Blocks of the loss that are worked on at once.
BLOCKS_AT_ONCE = 4


def pack(ready: DataFrame, features: str, label: str, block: int, layers):
    """An RDD of (rows, width): a line for each row with its features, its label and one over the size of its block."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F
    most, classes = block * BLOCKS_AT_ONCE, layers[-1]

    def packed(batches):
        held, n = [], 0
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else None
            if x is None:
                continue
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(x).all() or not np.isin(y, np.arange(classes)).all():
                raise ValueError("features must be numbers, labels whole numbers below the number of classes")
            held.append(np.column_stack([x, y, np.full(len(x), 1.0 / block)]))
            n += len(x)
            if n >= most:
                rows = np.concatenate(held)
                full = n - n % most
                for at in range(0, full, most):
                    yield out(rows[at:at + most])
                held, n = [rows[full:]], n - full
        if n:
            rows = np.concatenate(held)
            if n % block:
                rows[n - n % block:, -1] = 1.0 / (n % block)
            yield out(rows)

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([rows.tobytes()], pa.binary()), pa.array([rows.shape[1]], pa.int32())], names=["rows", "width"])

    rows = ready.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y")) \
        .mapInArrow(packed, "rows binary, width int")
    return cut_lineage(rows.repartition(2 * ready.sparkSession.sparkContext.defaultParallelism)).rdd


def gradient(rows: np.ndarray, weights: np.ndarray, layers) -> np.ndarray:
    """(sum of losses, sum of row weights, gradient...) of packed rows; a layer's weights are its matrix, then its offsets."""
    x, y, w = rows[:, :-2], rows[:, -2].astype(np.int64), rows[:, -1]
    at, parts, outputs = 0, [], [x]
    for i, o in zip(layers, layers[1:]):
        parts.append((weights[at:at + i * o].reshape(i, o), weights[at + i * o:at + (i + 1) * o]))
        at += (i + 1) * o
    for j, (matrix, offset) in enumerate(parts):
        z = outputs[-1] @ matrix
        z += offset
        if j < len(parts) - 1:
            np.negative(z, out=z)
            with np.errstate(over="ignore"):
                np.exp(z, out=z)
            z += 1.0
            np.reciprocal(z, out=z)
            outputs.append(z)
    z -= z.max(axis=1, keepdims=True)
    own = z[np.arange(len(z)), y]
    np.exp(z, out=z)
    total = z.sum(axis=1)
    loss = float((w * (np.log(total) - own)).sum())
    delta = z / total[:, None]
    delta[np.arange(len(z)), y] -= 1.0
    delta *= w[:, None]
    found = []
    for j in range(len(parts) - 1, -1, -1):
        found += [delta.sum(axis=0), (outputs[j].T @ delta).ravel()]
        if j:
            delta = delta @ parts[j][0].T
            delta *= outputs[j]
            delta *= 1.0 - outputs[j]
    return np.concatenate([[loss, float(w.sum())], *found[::-1]])


class _Failed(Exception):
    """The line search or the history is of no use."""


def _wolfe(phi, value: float, slope: float, t: float) -> float:
    """The step of a strong Wolfe line search as Breeze's: at most ten trials, each bracket narrowed ten times at most."""
    def zoom(low, high):
        for _ in range(10):
            left, right = (high, low) if low[0] > high[0] else (low, high)
            d1 = left[2] + right[2] - 3 * (left[1] - right[1]) / (left[0] - right[0])
            d2 = math.sqrt(d1 * d1 - left[2] * right[2]) if d1 * d1 >= left[2] * right[2] else math.nan
            width = right[0] - left[0]
            at = right[0] - width * (right[2] + d2 - d1) / (right[2] - left[2] + 2 * d2)
            at = left[0] + 0.1 * width if at < left[0] + 0.1 * width else left[0] + 0.9 * width if at > left[0] + 0.9 * width else at
            c = (at, *phi(at))
            if c[1] > value + 1e-4 * at * slope or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= 0.9 * abs(slope):
                    return at
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise _Failed

    if slope > 0:
        raise _Failed
    low = (0.0, value, slope)
    for i in range(10):
        c = (t, *phi(t))
        if not math.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + 1e-4 * t * slope or (c[1] >= low[1] and i > 0):
            return zoom(low, c)
        if abs(c[2]) <= 0.9 * abs(slope):
            return t
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    raise _Failed


def lbfgs(objective, x: np.ndarray, max_iter: int, tol: float, memory: int = 10) -> np.ndarray:
    """The minimum of ``objective`` (x -> value, gradient) as Spark's optimiser seeks it."""
    cached: list = [None, None]

    def at(point):
        if cached[0] is None or not np.array_equal(cached[0], point):
            cached[:] = [point.copy(), objective(point)]
        return cached[1]

    value, grad = at(x)
    first, values, steps, failed, i = value, [math.inf], [], False, 0
    while i < max_iter:
        if (len(values) > 1 and abs(value - max(values)) <= tol * first) or np.linalg.norm(grad) <= max(tol * value, 1e-8):
            break
        try:
            direction = grad.copy()
            kept = []
            for s, y in steps:
                rho = s @ y
                a = s @ direction / rho
                if math.isnan(a):
                    raise _Failed
                kept.append((s, y, rho, a))
                direction -= a * y
            if steps:
                s, y = steps[0]
                if not s @ y >= 0:
                    raise _Failed
                direction *= (s @ y) / (y @ y)
            for s, y, rho, a in reversed(kept):
                direction += (a - y @ direction / rho) * s
            direction *= -1.0

            def phi(t):
                v, g = at(x + t * direction)
                return v, float(g @ direction)

            step = _wolfe(phi, value, float(grad @ direction), 1.0 / np.linalg.norm(direction) if i == 0 else 1.0)
            if step * np.linalg.norm(grad) < 1e-10:
                raise _Failed
        except _Failed:
            if failed:
                break
            failed, steps = True, []
            continue
        point = x + step * direction
        new, slope = at(point)
        steps = [(point - x, slope - grad), *steps][:memory]
        x, value, grad, failed, i = point, new, slope, False, i + 1
        values = [*values, new][-20:]
    return x


def fit_network(classifier, ready: DataFrame):
    """The fitted model of a MultilayerPerceptronClassifier. Solvers other than L-BFGS are left to Spark."""
    if classifier.getSolver() != "l-bfgs" or classifier.isSet("initialWeights"):
        return classifier.fit(ready)
    layers = list(classifier.getLayers())
    one = cut_lineage(ready.limit(1))
    start = classifier.copy({classifier.maxIter: 0}).fit(one).weights.toArray()
    blocks = pack(ready, classifier.getFeaturesCol(), classifier.getLabelCol(), classifier.getBlockSize(), layers)
    sc = ready.sparkSession.sparkContext

    def objective(weights):
        shared = sc.broadcast(weights)
        total = lloyd.summed(blocks, lambda rows: gradient(rows, shared.value, layers), 8 * (len(weights) + 2))
        shared.destroy()
        return float(total[0] / total[1]), total[2:] / total[1]

    weights = lbfgs(objective, start, classifier.getMaxIter(), classifier.getTol())
    from pyspark.ml.linalg import Vectors
    fitted = classifier.copy({classifier.maxIter: 0, classifier.initialWeights: Vectors.dense(weights)}).fit(one)
    return fitted
