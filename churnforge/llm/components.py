"""Connected components by alternating large-star and small-star steps, as joins and aggregates.

Each round moves every edge towards the smallest node that its ends know of; the rounds end when the edges form stars.
Minima are partial aggregates and hubs meet their edges in a join that adaptive execution may split, so no node's
neighbours are ever gathered in one place. Rounds are cut by reliable checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from churnforge.llm.textbatch import materialise


def _down(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger node u to the smaller node v."""
    return (edges.where(F.col("u") != F.col("v"))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


#: Edges of a checkpoint file: small graphs are not spread over as many files as a shuffle has partitions.
EDGES_A_FILE = 50_000


def _written(edges: DataFrame, at_most: int) -> DataFrame:
    """A checkpoint of edges that are known to be no more than `at_most`, in few files; the step that makes them keeps its
    own tasks."""
    return materialise(edges.repartition(-(-max(1, at_most) // EDGES_A_FILE), F.xxhash64("u", "v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node reachable from it.

    Self-edges, repeated edges and nulls are allowed (edges with a null end are left out); no edges give no rows. The
    edges are counted and then read: hand over a table that is cheap to read twice."""
    given = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()
    now = _written(_down(given), given.count())
    state = _state(now)
    while state[0]:
        # large-star: every node hands its larger neighbours to the smallest node around it
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _down(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        # small-star: every node hands itself and its smaller neighbours to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        now = _written(_down(small.select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")), 2 * state[0])
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(roots)
