"""Substring deduplication with prefix-partitioned suffix trees.

A suffix starts at a word that has at least `words` words of its text before it. Suffixes are dealt to trees by a prefix
of variable length: prefixes are lengthened (1, 2, 4, ... `words` words) until the suffixes below them fit a
memory-sized group, and small prefixes share a group. Each group builds the part of the tree below its prefixes: its
leaves are sorted by the fingerprint of their path down to depth `words`, and neighbouring leaves with one path meet in
an internal node at least that deep, a repeat. The tree is cut at that depth, because deeper nodes cover no other words.
Runs of repeated suffixes are the maximal repeats, which the operator returns as spans.

Suffixes travel as packed arrays, 8 bytes each: a block of texts sends each group its sorted distinct paths (copies
inside a block are combined before the shuffle) and gets back one bit a path. Two different sequences are taken for one
only if their 64-bit fingerprints agree and their prefixes, by independent fingerprints, lead to the same group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from churnforge.llm.textbatch import give_back, slices, utf8
from churnforge.llm.wordcodes import Sequences, word_bounds, word_codes
from churnforge.session import shuffle_partitions


@dataclass(frozen=True)
class SubstringConfig:
    words: int = 35                     #: length of a repeat, in words
    block_bytes: int = 8 << 20          #: texts whose suffixes are packed together
    group_suffixes: int = 500_000       #: suffixes of a tree group
    cell_bits: int = 16                 #: of a prefix's cell at most; the plan has 2^cell_bits entries a prefix length


@dataclass(frozen=True)
class PrefixPlan:
    """Which group a prefix leads to: for each prefix length, by the prefix's cell; -1: take a longer prefix. A cell that is
    too large even at full length is split by its paths' hash into `splits` groups that end with its number. The tables
    have a few entries a group, up to a bound."""
    words: int
    cell_bits: int
    lengths: list[int]
    groups: list[np.ndarray]
    splits: np.ndarray

    def route(self, seq: Sequences, at: np.ndarray) -> np.ndarray:
        out = np.full(len(at), -1, np.int32)
        todo = np.arange(len(at))
        for length, table in zip(self.lengths, self.groups, strict=True):
            cells = prefix_cells(seq, at[todo], length, self.cell_bits)
            out[todo] = table[cells]
            if length == self.lengths[-1]:
                many = np.flatnonzero(self.splits[cells] > 1)
                path = seq.fingerprint(at[todo[many]], length, salt=length + 1)
                out[todo[many]] -= (path % self.splits[cells[many]].astype(np.uint64)).astype(np.int32)
            todo = todo[out[todo] < 0]
        return out


def prefix_lengths(words: int) -> list[int]:
    return [*(1 << k for k in range((words - 1).bit_length()) if 1 << k < words), words]


def prefix_cells(seq: Sequences, at: np.ndarray, length: int, bits: int) -> np.ndarray:
    return (seq.fingerprint(at, length, salt=length) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass(frozen=True)
class Block:
    """Words of consecutive texts and the places where suffixes start."""
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray                 # in words, one more than texts
    seq: Sequences
    at: np.ndarray

    @classmethod
    def of(cls, column: pa.Array, words: int) -> Block:
        data, byte_offsets = utf8(column)
        starts, ends, offsets = word_bounds(data, byte_offsets)
        lasts = np.repeat(offsets[1:], np.diff(offsets))
        at = np.flatnonzero(np.arange(len(starts)) + words <= lasts)
        return cls(data, starts, ends, offsets, Sequences(word_codes(data, starts, ends)), at)


def plan_prefixes(df: DataFrame, text_col: str, config: SubstringConfig, min_groups: int) -> tuple[PrefixPlan, int]:
    """(plan, number of blocks) from the text bytes and the counts of all suffixes' prefixes."""
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n_groups = max(min_groups, -(-(size // 5) // config.group_suffixes))
    bits = min(config.cell_bits, max(10, (4 * n_groups - 1).bit_length()))
    lengths = prefix_lengths(config.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(lengths), 1 << bits), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                block = Block.of(part.column("text"), config.words)
                for k, length in enumerate(lengths):
                    sums[k] += np.bincount(prefix_cells(block.seq, block.at, length, bits), minlength=1 << bits)
        full = np.flatnonzero(sums.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(sums.ravel()[full])], names=["cell", "n"])

    cells = (df.select(F.col(text_col).alias("text")).mapInArrow(count, "cell long, n long")
             .groupBy("cell").agg(F.sum("n").alias("n")).toPandas())     # lengths x cells rows
    counts = np.zeros(len(lengths) << bits, np.int64)
    counts[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(np.int64)
    counts = counts.reshape(len(lengths), 1 << bits)
    limit = max(1, min(config.group_suffixes, -(-int(counts[-1].sum()) // n_groups)))
    tables, base = [], 0
    for k in range(len(lengths)):
        fits = counts[k] <= limit if k < len(lengths) - 1 else np.full(1 << bits, True)
        packed = np.cumsum(np.where(fits, counts[k], 0)) // limit       # small prefixes in a row share a group
        tables.append(np.where(fits, base + packed, -1).astype(np.int32))
        base += int(packed[-1]) + 1
    blocks = max(min_groups, -(-size // config.block_bytes))
    splits = np.maximum(1, counts[-1] // limit)              # a cell's own count moves its group's number on by so many
    return PrefixPlan(config.words, bits, lengths, tables, splits), blocks


def _paths(block: Block, plan: PrefixPlan) -> tuple[np.ndarray, ...]:
    """Suffixes sorted by (group, path): their order, and the groups and paths with the first place of each distinct one."""
    group = plan.route(block.seq, block.at)
    path = block.seq.fingerprint(block.at, plan.words)
    order = np.lexsort((path, group))
    group, path = group[order], path[order]
    new = np.ones(len(order), bool)
    new[1:] = (group[1:] != group[:-1]) | (path[1:] != path[:-1])
    return order, group, path, np.flatnonzero(new)


def _in_order(rows: pa.Table) -> pa.Table:
    """The block's texts in an order that does not depend on how they arrived."""
    return rows.take(pc.sort_indices(rows, sort_keys=[("id", "ascending"), ("text", "ascending")])).combine_chunks()


def _column(rows: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(rows.column(name).chunks) if rows.num_rows else pa.array([], rows.schema.field(name).type)


def _send(plan: PrefixPlan):
    """Block of texts -> its distinct paths for each group."""

    def run(rows: pa.Table) -> pa.Table:
        give_back()                                         # of the block before
        block = Block.of(_column(_in_order(rows), "text"), plan.words)
        _, group, path, first = _paths(block, plan)
        group, path = group[first], path[first]
        cuts = np.flatnonzero(np.diff(group, prepend=-1))
        ends = np.append(cuts, len(group))[1:]
        return pa.table({
            "grp": pa.array(group[cuts], pa.int32()),
            "block": pa.array(np.full(len(cuts), rows.column("block")[0].as_py(), np.int64)),
            "paths": pa.array([path[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())})

    return run


def _grow(rows: pa.Table) -> pa.Table:
    """A group's subtree: which of each block's paths end below an internal node of full depth."""
    leaves = [np.frombuffer(x, np.uint64) for x in rows.column("paths").to_pylist()]
    merged = np.sort(np.concatenate(leaves))
    nodes = np.unique(merged[1:][merged[1:] == merged[:-1]])
    out = []
    if len(nodes):
        for block, paths in zip(rows.column("block").to_pylist(), leaves, strict=True):
            hit = nodes[np.minimum(np.searchsorted(nodes, paths), len(nodes) - 1)] == paths
            if hit.any():
                out.append((rows.column("grp")[0].as_py(), block, np.packbits(hit).tobytes()))
    return pa.table({"grp": pa.array([x[0] for x in out], pa.int32()), "block": pa.array([x[1] for x in out], pa.int64()),
                     "shared": pa.array([x[2] for x in out], pa.binary())})


def _strip(plan: PrefixPlan, carry: bool):
    """Block of texts and its groups' answers -> texts without repeats."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        give_back()                                         # of the block before
        rows = _in_order(rows)
        text = _column(rows, "text")
        block = Block.of(text, plan.words)
        order, group, _, first = _paths(block, plan)
        shared = np.diff(np.append(first, len(order))) > 1              # copies inside the block
        cuts = np.searchsorted(group[first], np.arange(int(group[-1]) + 2)) if len(group) else None
        for g, bits in zip(answers.column("grp").to_pylist(), answers.column("shared").to_pylist(), strict=True):
            a, b = cuts[g], cuts[g + 1]
            shared[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        repeated = np.zeros(len(order), bool)
        repeated[order] = np.repeat(shared, np.diff(np.append(first, len(order))))
        edges = np.zeros(len(block.starts) + 1, np.int64)
        hits = block.at[repeated]
        np.add.at(edges, hits, 1)
        np.add.at(edges, hits + plan.words, -1)
        covered = np.cumsum(edges)[:-1] > 0
        removed = np.add.reduceat(np.append(covered, False).astype(np.int64), block.offsets[:-1]) if len(text) else []
        n_words = np.diff(block.offsets)
        removed = np.where(n_words > 0, removed, 0)
        kept, spans = [], []
        for k, raw in enumerate(t.as_py() for t in text.cast(pa.large_binary())):
            words = (raw or b"").split()
            span = []
            if removed[k]:
                c = covered[block.offsets[k]:block.offsets[k + 1]]
                words = [w for w, gone in zip(words, c.tolist(), strict=True) if not gone]
                turn = np.flatnonzero(np.diff(np.concatenate([[False], c, [False]]).astype(np.int8)))
                span = [{"first_word": int(a), "last_word": int(b) - 1} for a, b in zip(turn[::2], turn[1::2], strict=True)]
            kept.append(b" ".join(words))
            spans.append(span)
        return pa.table({
            "id": rows.column("id"), **({c: rows.column(c) for c in ("text", "carried")} if carry else {}), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
            "spans": pa.array(spans, pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64())])))})

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   config: SubstringConfig = SubstringConfig(), carry: bool = False) -> DataFrame:
    """id, n_words, n_removed, kept_text and spans (first and last word of each removed run) per row of df; with `carry`
    also the text as it was, as `text`, and all other columns of df, as the struct `carried`.

    Every word covered by `config.words` consecutive words of its text that also start anywhere else, in the same text or
    another, is removed, all copies alike; kept words are joined by one space. Words are separated by ASCII white space
    and compared byte by byte. A null or empty text has no words. Repeated rows are copies of each other and stay rows of
    the result; ids may be null; an empty table gives an empty result."""
    others = [F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text_col]).alias("carried")] if carry else []
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *others)
    plan, n_blocks = plan_prefixes(docs, "text", config, shuffle_partitions(df.sparkSession))
    key = F.xxhash64(F.col("id"), F.octet_length("text"), F.substring("text", 1, 64))
    blocks = docs.withColumn("block", F.pmod(key, F.lit(n_blocks)))
    # both uses of `blocks` read one shuffle of the texts
    paths = blocks.groupBy("block").applyInArrow(_send(plan), "grp int, block long, paths binary")
    answers = paths.groupBy("grp").applyInArrow(_grow, "grp int, block long, shared binary")
    spans = T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType())]))
    schema = T.StructType([
        T.StructField("id", df.schema[id_col].dataType), *(docs.select("text", "carried").schema.fields if carry else []),
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("kept_text", T.StringType()), T.StructField("spans", spans)])
    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_strip(plan, carry), schema)
    return out.withColumnRenamed("id", id_col)
