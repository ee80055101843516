"""SimHash near-duplicate detection through a segment-popcount embedding.

A 64-bit fingerprint is embedded as the bit counts of its 2-bit segments (32 coordinates of 0, 1 or 2). The Manhattan
distance of two embeddings never exceeds the Hamming distance of the fingerprints, so it may rule pairs out. The
embedding space is gridded by bands of coordinates: if at most d bits differ, at most d bands differ, so two linked
fingerprints agree in all coordinates of some `bands - d` bands. Each choice of that many bands is one grid; within a
grid cell the Manhattan bound is applied first and the exact bit distance decides.

Only distinct fingerprints are joined. A cell's links are reported as the links found (few rows) or as a spanning forest
(many rows). Cells above a fixed size take another exact way whose groups are bounded: every fingerprint is listed under
all values within half the bit distance, and two fingerprints are linked if and only if they share such a value.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from churnforge.llm.components import connected_components
from churnforge.llm.textbatch import materialise, slices, texts
from churnforge.session import shuffle_partitions

BITS = 64
SEGMENT_LOW_BITS = 0x5555555555555555
#: Runs up to this length are compared row against row, longer ones as a matrix.
SHORT_RUN = 32


@dataclass(frozen=True)
class SimHashConfig:
    shingle: int = 4            #: words of a shingle
    max_bits: int = 4           #: fingerprints with at most so many differing bits are linked
    seed: int = 42              #: of XXH64
    bands: int = 8              #: bands of the embedding, 64 / bands bits each; more than max_bits
    cell_rows: int = 2_048      #: cells with more fingerprints are split by exact neighbour listing


def fingerprint(text: str, config: SimHashConfig = SimHashConfig()) -> int:
    """The 64-bit SimHash of a text; 0 for a text without words."""
    words = text.encode().lower().split()       # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    n, line = config.shingle, b" ".join(words)
    if len(words) <= n:
        return xxhash.xxh64_intdigest(line, config.seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, seed = xxhash.xxh64_intdigest, config.seed
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts[:len(words) - n + 1].tolist(),
                                                               ends[n - 1:].tolist(), strict=True)], "<u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """(id, fp) per row, fp as a signed long; a null or empty text has fingerprint 0."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                fps = np.array([fingerprint(t, config) for t in texts(part.column(text_col))], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, fp long")


def embedding(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, packed two bits each into a long."""
    low = F.lit(SEGMENT_LOW_BITS)
    a, b = F.shiftrightunsigned(fp, 1).bitwiseAND(low), fp.bitwiseAND(low)
    return F.shiftleft(a.bitwiseAND(b), 1).bitwiseOR(a.bitwiseXOR(b))


def _embed(fp: np.ndarray) -> np.ndarray:
    return fp - ((fp >> np.uint64(1)) & np.uint64(SEGMENT_LOW_BITS))


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed embeddings: coordinates 1 and 2 differ in both bits but by one."""
    low = np.uint64(SEGMENT_LOW_BITS)
    x = a ^ b
    odd, even = x & low, (x >> np.uint64(1)) & low
    return np.bitwise_count(odd) + 2 * np.bitwise_count(even & ~odd)


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def grid_masks(config: SimHashConfig) -> list[int]:
    """The embedding's bits that each grid keys on: every choice of bands - max_bits bands."""
    if not config.max_bits < config.bands <= BITS // 2:
        raise ValueError("more bands than differing bits are needed, and two bits a band at least")
    edges = [2 * (k * (BITS // 2) // config.bands) for k in range(config.bands + 1)]
    bands = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [_signed(sum(pick)) for pick in combinations(bands, config.bands - config.max_bits)]


def _near(a: np.ndarray, b: np.ndarray, d: int) -> np.ndarray:
    """Linked? The bound on the embedding first, the exact distance for what it leaves."""
    ok = _manhattan(_embed(a), _embed(b)) <= d
    at = np.flatnonzero(ok)
    ok[at] = np.bitwise_count(a[at] ^ b[at]) <= d
    return ok


def _forest(fps: np.ndarray, d: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges of a spanning forest of the links among a cell's fingerprints, breadth first."""
    left, right = [], []
    rest = np.arange(len(fps))
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            parent = np.full(len(rest), -1)
            for f in front:
                todo = np.flatnonzero(parent < 0)
                others = fps[rest[todo]]
                parent[todo[_near(others, np.broadcast_to(fps[f], others.shape), d)]] = f
            hit = parent >= 0
            left.append(fps[parent[hit]])
            right.append(fps[rest[hit]])
            front, rest = rest[hit], rest[~hit]
    return left, right


def _short_runs(run: np.ndarray, fps: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """All links inside runs of at most SHORT_RUN equal values of `run`."""
    left, right = [], []
    for step in range(1, SHORT_RUN):
        at = np.flatnonzero(run[:-step] == run[step:]) if len(run) > step else np.zeros(0, np.int64)
        if not len(at):
            break
        at = at[_near(fps[at], fps[at + step], d)]
        left.append(fps[at])
        right.append(fps[at + step])
    return (np.concatenate(left), np.concatenate(right)) if left else (fps[:0], fps[:0])


def _links(config: SimHashConfig):
    """Partition of rows (grid, cell, fp) sorted by cell -> rows (a, b): links, or (a, null): fp of an over-full cell."""

    def out(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        right = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), right], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        full = None                                     # the over-full cell that is passing by

        def whole(grid, cell, fps):
            nonlocal full
            run_id = np.cumsum(np.concatenate([[False], (grid[1:] != grid[:-1]) | (cell[1:] != cell[:-1])]))
            sizes = np.bincount(run_id)
            small = (sizes <= SHORT_RUN)[run_id]
            yield out(*_short_runs(run_id[small], fps[small], config.max_bits))
            ends = np.cumsum(sizes)
            for k in np.flatnonzero(sizes > SHORT_RUN):
                a, b = ends[k] - sizes[k], ends[k]
                if full == (grid[a], cell[a]) or sizes[k] > config.cell_rows:
                    yield out(fps[a:b], None)
                else:
                    left, right = _forest(fps[a:b], config.max_bits)
                    if left:
                        yield out(np.concatenate(left), np.concatenate(right))

        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]
            grid, cell = np.concatenate([keep[0], now[0]]), np.concatenate([keep[1], now[1]])
            fps = np.concatenate([keep[2], now[2].view(np.uint64)])
            if not len(grid):
                continue
            if full and full != (grid[0], cell[0]):
                full = None
            same = (grid == grid[-1]) & (cell == cell[-1])
            tail = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if full and tail == 0:                      # still the same over-full cell
                yield out(fps, None)
                keep = (grid[:0], cell[:0], fps[:0])
                continue
            if full:                                    # its end
                head = int(np.argmin((grid == full[0]) & (cell == full[1])))
                yield out(fps[:head], None)
                grid, cell, fps, tail, full = grid[head:], cell[head:], fps[head:], tail - head, None
            if tail:
                yield from whole(grid[:tail], cell[:tail], fps[:tail])
            if len(fps) - tail > config.cell_rows:
                full = (grid[-1], cell[-1])
                yield out(fps[tail:], None)
                keep = (grid[:0], cell[:0], fps[:0])
            else:
                keep = (grid[tail:], cell[tail:], fps[tail:])
        if len(keep[0]):
            if full and full == (keep[0][0], keep[1][0]):
                yield out(keep[2], None)
            else:
                yield from whole(*keep)

    return run


def _neighbours(d: int):
    """fp -> (value, fp) for every value within d bits."""
    flips = np.array([sum(1 << i for i in pick) for r in range(d + 1) for pick in combinations(range(BITS), r)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 64):
                part = fps[at:at + 64]
                values = (part[:, None] ^ flips[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)),
                                                  pa.array(np.repeat(part, len(flips)).view(np.int64))], names=["v", "fp"])

    return run


def fingerprint_links(fps: DataFrame, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """Edges (a, b) with at most max_bits differing bits that connect exactly the linked fingerprints of `fps` (one
    distinct long column fp); inside over-full cells an end may be a common neighbour value instead of a fingerprint."""
    at = embedding(F.col("fp"))
    # narrow rows become 70 times as many: deal them out first (by another key than they may come by, else Spark leaves the
    # step out), as adaptive execution would gather them in a few tasks
    spread = fps.repartition(shuffle_partitions(fps.sparkSession), at)
    cells = spread.select(F.explode(F.array(*[
        F.struct(F.lit(g).alias("grid"), at.bitwiseAND(F.lit(m)).alias("cell"), F.col("fp")) for g, m in
        enumerate(grid_masks(config))])).alias("c")).select("c.*")
    found = materialise(cells.repartition("grid", "cell").sortWithinPartitions("grid", "cell")
                        .mapInArrow(_links(config), "a long, b long"))
    links = found.where("b IS NOT NULL").distinct()
    full = found.where("b IS NULL").select("a").distinct()
    if full.isEmpty():
        return links
    # any two linked ones have a value within d // 2 bits of one and d - d // 2 of the other; all that come near such a value
    # are linked with the first of those within d // 2. Groups here are bounded: a value has at most as many neighbours
    # as there are flips
    d = config.max_bits
    near = full.mapInArrow(_neighbours(d // 2), "v long, fp long")
    wide = near if d % 2 == 0 else full.mapInArrow(_neighbours(d - d // 2), "v long, fp long")
    hubs = near.groupBy("v").agg(F.min("fp").alias("b"))
    return links.unionByName(wide.join(hubs, "v").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct())


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """id, fp (long), component_fp (long, names the group) and component_id per row of df.

    component_id is the smallest id in the row's group of fingerprints reachable by links of at most
    `config.max_bits` differing bits, itself included; null only if no row of the group has an id. Null and empty
    texts share fingerprint 0, which links like any other. Repeated rows stay repeated; an empty table gives an empty
    result."""
    rows = materialise(fingerprints(df, id_col, text_col, config))
    nodes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(fingerprint_links(nodes.select("fp"), config)).withColumnRenamed("node", "fp")
    named = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("component_fp"))
    ids = named.groupBy("component_fp").agg(F.min("least").alias("component_id"))
    groups = named.select("fp", "component_fp").join(ids, "component_fp")
    return rows.join(groups, "fp").select(F.col("id").alias(id_col), "fp", "component_fp", "component_id")


def simhash_keep(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """The columns of df, one row of each group: the one with the smallest id (of rows that repeat that id, one; of a
    group without ids, one). Null and empty texts are one group; an empty table gives an empty result."""
    groups = simhash_groups(df, id_col, text_col, config)
    kept = groups.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(
        F.col(id_col).alias("_kept_id"), F.col("component_fp").alias("_kept_group")).distinct()
    # most ids name one group; only rows whose id is repeated need their fingerprint to tell them apart
    once = kept.groupBy("_kept_id").agg(F.count(F.lit(1)).alias("_groups"))
    picked = df.join(once, F.col(id_col).eqNullSafe(F.col("_kept_id")), "left_semi")
    return picked if _unique(picked, id_col) else _one_each(picked, id_col, text_col, groups, config)


def _unique(df: DataFrame, id_col: str) -> bool:
    return df.groupBy(id_col).count().where("count > 1").isEmpty()


def _one_each(df: DataFrame, id_col: str, text_col: str, groups: DataFrame, config: SimHashConfig) -> DataFrame:
    """One row of each group where ids repeat: rows get their group by fingerprint and a repeated row loses."""
    names = df.columns
    kind = df.schema
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_col}`").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body"):
                fps = np.array([fingerprint(t, config) for t in texts(part.column("body"))], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(fps.view(np.int64))], names=["row", "fp"])

    marked = held.mapInArrow(run, f"row {kind.simpleString()}, fp long")
    group = groups.select("fp", "component_fp", "component_id").distinct()
    best = (marked.join(group, "fp").where(F.col(f"row.`{id_col}`").eqNullSafe(F.col("component_id")))
            .groupBy("component_fp").agg(F.min(F.struct(*[F.col(f"row.`{c}`") for c in names])).alias("row")))
    return best.select(*[F.col(f"row.`{c}`") for c in names])
