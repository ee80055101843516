"""Hard-negative mining by bounds along a spanning tree of anchors.

Anchors and rows are dealt to blocks, and every block of anchors meets every block of rows in one task. The anchors of a
block form a minimum spanning tree. A row's scores at the root are computed; at a child its score differs from that at the
parent by at most the length of the edge times the row's norm. Only rows whose interval meets a window that is asked for
are scored again, which makes their interval a point for the anchors further down the tree.

Two passes: the first finds the best rows of an anchor's own label (the window is everything above the weakest of them),
the second the best rows of other labels inside the window that each of these sets.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from churnforge.llm.textbatch import materialise

_LARGE = np.iinfo(np.int64).max


@dataclass(frozen=True)
class NegativeConfig:
    positives: int = 5
    negatives: int = 3
    low: int = 50                       #: a negative's score is at least this share of the positive's, in hundredths
    high: int = 95                      #: and at most this one
    scale: int = 256                    #: a component x becomes floor(scale * x)
    rows_a_block: int = 2_048
    anchors_a_block: int = 1_024


_BLOCK = "dim int, block long, n long, row binary, id binary, no_id binary, label binary, q binary"


def _pack(rows: pa.Table) -> pa.Table:
    """A block's rows as one row of arrays, in the order of their numbers."""
    rows = rows.sort_by("row")
    q = rows.column("q").combine_chunks().flatten().to_numpy()
    plain = {"row": rows.column("row").to_numpy(), "id": rows.column("id").fill_null(_LARGE).to_numpy(),
             "no_id": rows.column("id").is_null().to_numpy(), "label": rows.column("label").to_numpy(), "q": q}
    return pa.table({"dim": rows.column("dim")[:1], "block": rows.column("block")[:1], "n": pa.array([rows.num_rows], pa.int64()),
                     **{c: pa.array([v.tobytes()], pa.binary()) for c, v in plain.items()}})


class _Block:
    def __init__(self, rows: pa.Table):
        self.dim, self.n = rows.column("dim")[0].as_py(), rows.column("n")[0].as_py()
        of = lambda c, kind: np.frombuffer(rows.column(c)[0].as_py(), kind)
        self.row, self.id, self.label = of("row", np.int64), of("id", np.int64), of("label", np.int64)
        self.no_id, self.q = of("no_id", np.bool_), of("q", np.int64).reshape(self.n, self.dim)
        self.ids = [None if no else i for i, no in zip(self.id.tolist(), self.no_id.tolist(), strict=True)]
        self.norm = np.sqrt((self.q.astype(np.float64) ** 2).sum(1)) * (1 + 1e-12)


def _scorer(anchors: _Block, rows: _Block) -> Callable[[int, np.ndarray], np.ndarray]:
    """(anchor, places of rows) -> exact scores: doubles where all partial sums are below 2^53, else longs, else whole
    numbers of any size, cut off at the largest long."""
    top = anchors.norm.max(initial=0) * rows.norm.max(initial=0)
    kind = np.float64 if top < 2 ** 52 else np.int64 if top < 2 ** 62 else object
    a, b = anchors.q.astype(kind), rows.q.astype(kind)

    def score(k: int, at: np.ndarray) -> np.ndarray:
        s = b[at] @ a[k] if rows.dim else np.zeros(len(at))
        return (np.clip(s, -_LARGE, _LARGE) if kind is object else s).astype(np.int64)

    return score


def spanning_tree(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, length): anchors so that parents come first, each one's parent (-1 for the root) and its distance
    from it; a minimum spanning tree by Prim's method, rooted at the vector nearest to the mean."""
    x = q.astype(np.float64)
    n = len(x)
    order, parent, length = np.empty(n, np.int64), np.full(n, -1), np.zeros(n)
    middle = ((x - x.mean(0)) ** 2).sum(1)
    square = (x ** 2).sum(1)
    best, via, free = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool)
    at = int(middle.argmin())
    for k in range(n):
        order[k], free[at], parent[at] = at, False, via[at]
        if via[at] >= 0:
            length[at] = np.sqrt(((x[at] - x[via[at]]) ** 2).sum())
        near = square + square[at] - 2 * (x @ x[at])
        closer = free & (near < best)
        best[closer], via[closer] = near[closer], at
        if k + 1 < n:
            at = int(np.where(free, best, np.inf).argmin())
            if not free[at]:                                # distances beyond the range of doubles
                at = int(free.argmax())
                via[at] = order[0] if via[at] < 0 else via[at]
    return order, parent, length


def _walk(anchors: _Block, rows: _Block, wanted: Callable, found: Callable) -> None:
    """Visit the anchors from the root on. wanted(k, low, high) gives the places of rows that must be scored;
    found(k, places, scores) takes the scores of these."""
    score, (order, parent, length) = _scorer(anchors, rows), spanning_tree(anchors.q)
    low, high = np.empty((anchors.n, rows.n)), np.empty((anchors.n, rows.n))
    every = np.arange(rows.n)
    for k in order:
        up = parent[k]
        if up < 0:
            exact = score(k, every)
            low[k] = high[k] = exact
            at = wanted(k, low[k], high[k])
            found(k, at, exact[at])
            continue
        reach = length[k] * rows.norm
        reach = reach + (reach + np.maximum(np.abs(low[up]), np.abs(high[up]))) * 1e-9 + 1      # rounding of the bounds
        low[k], high[k] = low[up] - reach, high[up] + reach
        at = wanted(k, low[k], high[k])
        exact = score(k, at)
        low[k, at] = high[k, at] = exact
        found(k, at, exact)


def _weakest(values: np.ndarray, k: int) -> float:
    """The k-th largest value, or minus infinity if there are fewer."""
    return -np.inf if len(values) < k else float(np.partition(values, len(values) - k)[len(values) - k])


def _best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((rows, ids, -scores))[:k]


_POSITIVE = "a_row long, a_id long, a_dim int, p_row long, p_id long, p_score long"


def _positives(config: NegativeConfig):
    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if a.num_rows and b.num_rows:
            anchors, rows = _Block(a), _Block(b)

            def wanted(k, low, high):
                same = np.flatnonzero((rows.label == anchors.label[k]) & (rows.row != anchors.row[k]))
                return same[high[same] >= _weakest(low[same], config.positives)]

            def found(k, at, s):
                for j in _best(s, rows.id[at], rows.row[at], config.positives):
                    i = at[j]
                    out.append((anchors.row[k], anchors.ids[k], anchors.dim, rows.row[i], rows.ids[i], s[j]))

            _walk(anchors, rows, wanted, found)
        return _table(out, _POSITIVE)

    return run


_NEGATIVE = "a_row long, a_id long, place int, p_id long, p_score long, n_row long, n_id long, n_score long"


def _negatives(config: NegativeConfig):
    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if a.num_rows and b.num_rows:
            anchors, rows = _Block(a), _Block(b)
            asked = {x["a_row"]: x["asked"] for x in a.column("windows")[0].as_py()}
            windows = [[(-((-config.low * x["p_score"]) // 100), config.high * x["p_score"] // 100, x)
                        for x in asked.get(r, ())] for r in anchors.row.tolist()]

            def wanted(k, low, high):
                other = np.flatnonzero(rows.label != anchors.label[k])
                lo, hi, take = low[other], high[other], np.zeros(len(other), bool)
                for first, last, _ in windows[k]:
                    if first > last:
                        continue
                    f, t = float(first) - abs(float(first)) * 1e-9, float(last) + abs(float(last)) * 1e-9
                    inside = lo[(lo >= float(first) + abs(float(first)) * 1e-9) & (hi <= float(last) - abs(float(last)) * 1e-9)]
                    take |= (hi >= max(f, _weakest(inside, config.negatives))) & (lo <= t)
                return other[take]

            def found(k, at, s):
                for first, last, x in windows[k]:
                    held = np.flatnonzero((s >= first) & (s <= last))
                    for j in held[_best(s[held], rows.id[at[held]], rows.row[at[held]], config.negatives)]:
                        i = at[j]
                        out.append((anchors.row[k], anchors.ids[k], x["place"], x["p_id"], x["p_score"], rows.row[i], rows.ids[i],
                                    s[j]))

            _walk(anchors, rows, wanted, found)
        return _table(out, _NEGATIVE)

    return run


def _table(rows: list[tuple], schema: str) -> pa.Table:
    names = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table({n: pa.array(c, pa.int32() if t == "int" else pa.int64()) for (n, t), c in zip(names, columns, strict=True)})


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows of equal length in blocks of about `size`, each packed into one row."""
    blocks = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / size).alias("blocks"))
    dealt = rows.join(F.broadcast(blocks) if blocks.count() <= 100_000 else blocks, "dim").withColumn(
        "block", F.pmod(F.xxhash64("row"), F.col("blocks")))
    return dealt.select("dim", "block", "row", "id", "label", "q").groupBy("dim", "block").applyInArrow(_pack, _BLOCK)


def _every_pair(anchors: DataFrame, rows: DataFrame, run, schema: str) -> DataFrame:
    """Every block of anchors with every block of rows of the same length: both are sent to the pair's own key."""
    count = lambda df, name: df.groupBy("dim").agg((F.max("block") + 1).alias(name))
    keys = ("dim", "a_block", "b_block")
    a = (anchors.join(F.broadcast(count(rows, "n_rows")), "dim")
         .withColumn("a_block", F.col("block")).withColumn("b_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1))))
    b = (rows.join(F.broadcast(count(anchors, "n_anchors")), "dim")
         .withColumn("b_block", F.col("block")).withColumn("a_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_anchors") - 1))))
    # a missing block number (blocks are dealt by hash) has no partner, and its group gives nothing
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(run, schema)


def mine_negatives(df: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                   config: NegativeConfig = NegativeConfig()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for the rows where `anchor` holds.

    Scores are inner products of vectors whose components x are floor(scale * x); higher scores come first, of equal ones
    the smaller id (null ids last, then the row's number). An anchor's positives are its best other rows of the same
    label, a positive's negatives the best rows of other labels with low * p <= 100 * n <= high * p. Rows with a null label, a
    null vector, or a null or non-finite component take no part, and vectors of different lengths never meet. Ids and
    labels are whole numbers. Repeated rows are rows of their own, as anchors too; an empty table gives an empty result.
    Scores beyond 64 bits are cut off at the largest long."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                     F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(F.coalesce(F.col("label").isNotNull() & finite, F.lit(False)))
    q = F.transform("vec", lambda v: F.floor(v * config.scale).cast("long"))
    numbered = materialise(rows.select("id", "label", "anchor", F.size("vec").alias("dim"), q.alias("q"),
                                       F.monotonically_increasing_id().alias("row")))
    blocks = materialise(_blocks(numbered, config.rows_a_block))
    anchors = materialise(_blocks(numbered.where("anchor"), config.anchors_a_block))
    near = _every_pair(anchors, blocks, _positives(config), _POSITIVE)
    order = Window.partitionBy("a_row").orderBy(F.desc("p_score"), F.asc_nulls_last("p_id"), "p_row")
    positives = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= config.positives)
    # a block's windows travel with it
    asked = F.sort_array(F.collect_list(F.struct("place", "p_id", "p_score"))).alias("asked")
    sizes = numbered.where("anchor").groupBy(F.col("dim").alias("a_dim")).agg(
        F.ceil(F.count(F.lit(1)) / config.anchors_a_block).alias("blocks"))
    windows = (positives.groupBy("a_row", "a_dim").agg(asked).join(F.broadcast(sizes), "a_dim")
               .withColumn("block", F.pmod(F.xxhash64("a_row"), F.col("blocks")))
               .groupBy(F.col("a_dim").alias("dim"), "block").agg(F.collect_list(F.struct("a_row", "asked")).alias("windows")))
    far = _every_pair(materialise(anchors.join(windows, ["dim", "block"])), blocks, _negatives(config), _NEGATIVE)
    order = Window.partitionBy("a_row", "place").orderBy(F.desc("n_score"), F.asc_nulls_last("n_id"), "n_row")
    return (far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.negatives)
            .select(F.col("a_id").alias("anchor_id"), F.col("p_id").alias("positive_id"), "rank", F.col("n_id").alias("negative_id"),
                    F.col("p_score").alias("positive_score"), F.col("n_score").alias("negative_score")))
