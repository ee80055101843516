"""Embedding near-duplicates: int8 tile products with error bounds, full precision where they cannot decide.

Vectors of one label are dealt to blocks; every two blocks meet in a tile. A unit vector x is held as s * q with whole
numbers q in -127..127 and the norm e of what is lost; then x.y differs from s_x s_y (q_x . q_y) by at most
e_x + e_y + e_x e_y. Pairs that could reach the threshold within that bound are computed again in double precision. A tile
returns each vector's number of links and its root among the tile's linked vectors, never the pairs. Equal vectors
travel as one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from churnforge.llm.components import connected_components
from churnforge.llm.textbatch import materialise


@dataclass(frozen=True)
class EmbeddingConfig:
    threshold: float = 0.93
    block: int = 2_048                  #: vectors of a block; a tile has two blocks
    strip: int = 256                    #: rows of a tile that are multiplied at a time


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, scale, error) of unit vectors; error bounds the norm of x - scale * q, rounding of this step included."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None])
    lost = x - q * scale[:, None]
    return q.astype(np.int8), scale, np.sqrt(np.einsum("ij,ij->i", lost, lost)) + 1e-12


def _union(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the trees of the linked places a and b; roots are the smallest places."""
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def _tile(config: EmbeddingConfig):
    def run(rows: pa.Table) -> pa.Table:
        node, copies, block = (rows.column(c).to_numpy() for c in ("node", "copies", "block"))
        order = np.argsort(block, kind="stable")
        node, copies, block = node[order], copies[order], block[order]
        flat = pa.concat_arrays(rows.column("vec").chunks).flatten().to_numpy(zero_copy_only=False)
        x = unit(flat.reshape(len(node), -1)[order].astype(np.float64))
        q, scale, error = quantise(x)
        # products of int8 values are whole numbers; float32 adds up to 1,000 of them without rounding
        wide = q.astype(np.float32 if x.shape[1] <= 1_000 else np.float64)
        own = int(np.searchsorted(block, block[-1]))            # the second block, or 0 if both are one
        links, root = np.zeros(len(node), np.int64), np.arange(len(node))
        for a in range(0, own or len(node), config.strip):
            z = min(a + config.strip, own or len(node))
            from_ = own or a                                    # within one block only pairs above the diagonal
            near = (wide[a:z] @ wide[from_:].T) * (scale[a:z, None] * scale[None, from_:])
            slack = error[a:z, None] + error[None, from_:] + error[a:z, None] * error[None, from_:] + 1e-9
            i, j = np.nonzero(near + slack >= config.threshold)
            i, j = i + a, j + from_
            if not own:
                i, j = i[j > i], j[j > i]
            exact = np.concatenate([np.einsum("ij,ij->i", x[i[k:k + 65_536]], x[j[k:k + 65_536]])
                                    for k in range(0, len(i), 65_536)] or [np.zeros(0)])
            i, j = i[exact >= config.threshold], j[exact >= config.threshold]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            _union(root, i, j)
        hit = np.flatnonzero(links)
        return pa.table({"node": pa.array(node[hit], pa.int64()), "links": pa.array(links[hit], pa.int64()),
                         "root": pa.array(node[root[hit]], pa.int64())})

    return run


def embedding_links(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    config: EmbeddingConfig = EmbeddingConfig()) -> DataFrame:
    """id, n_links, component_id and kept per row of df.

    Two rows are linked if their labels are equal and not null, their vectors have the same length and a cosine of
    `config.threshold` or more. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing. Repeated rows and equal vectors are linked copies. component_id is the smallest id reachable, the row's own
    included (null only if the whole component has no id); kept: the row's id is that id. An empty table gives an empty
    result."""
    # floats travel as they are (a double holds each of them), other numbers as doubles
    kind = "array<float>" if dict(df.dtypes)[vec_col] == "array<float>" else "array<double>"
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast(kind).alias("vec"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("vec", lambda v: v != 0), F.lit(False))
    good = rows.where(usable)
    # one node for each distinct vector of a label; numbered once, as a written table
    nodes = materialise(good.groupBy("label", "vec").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
                        .withColumn("node", F.monotonically_increasing_id()))
    sizes = nodes.groupBy("label", F.size("vec").alias("dim")).agg(
        F.ceil(F.count(F.lit(1)) / config.block).cast("int").alias("blocks"))
    dealt = (nodes.withColumn("dim", F.size("vec")).join(sizes, ["label", "dim"])
             .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    met = (dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .select("label", "dim", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                   "block", "node", "copies", "vec"))
    tiles = materialise(met.groupBy("label", "dim", "low", "high").applyInArrow(_tile(config), "node long, links long, root long"))
    links = tiles.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(tiles.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = (nodes.select("label", "vec", "node", "copies", "least").join(links, "node", "left").join(roots, "node", "left")
             .withColumn("root", F.coalesce("root", "node")))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = named.join(smallest, "root").select("label", "vec", "component_id",
                                                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = good.join(known, ["label", "vec"]).select("id", "n_links", "component_id")
    alone = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id",
                                            F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
