"""URL filters by a Bloom filter cascade.

A rule is a host with a path; it fits the host and its subdomains where the path begins with the rule's. Every url yields
the keys that could fit it (suffixes of its host, each with the path prefixes of the lengths that rules have). The
complete key universe of the corpus is known, so membership can be exact without joining urls to rules: level 0 of the
cascade is a Bloom filter of the listed keys, level 1 one of the universe's keys that level 0 passes wrongly, level 2 one of
the listed keys that level 1 passes wrongly, and so on until a level passes nothing wrongly. A level's size follows the
number of listed keys, or of the urls' keys that the level before passes wrongly; it is held to a bound, and beyond it keys
are dealt to several cascades by their hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from churnforge.llm.asciiwords import ascii_lower
from churnforge.llm.textbatch import materialise, mix64

# The rules of the registered query, as (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@dataclass(frozen=True)
class CascadeConfig:
    bits_per_key: int = 10
    hashes: int = 5
    max_bits: int = 1 << 28             #: of one level; more keys than fit are dealt to several cascades, by their hash
    max_levels: int = 64


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])))


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path from there up to `?`,
    `#` or the end. Both empty if the url is null or has no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _hashed(key: Column) -> list[Column]:
    """Two independent hashes: no two keys of the universe stay together through all levels."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def url_keys(host: Column, path: Column, lengths: list[int], labels_a_rule: int) -> Column:
    """array<struct<key, h1, h2>>: keys that a rule for this url could have (rules have hosts of at most `labels_a_rule`
    labels), the longest first, of equally long ones that with the longer host."""
    labels = F.slice(F.reverse(F.split(host, r"\.")), 1, labels_a_rule)
    labels = F.reverse(labels)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    ends = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(ends, lambda n: F.struct(
        (-F.length(h) - n).alias("order"), (-F.length(h)).alias("host_order"),
        F.concat(h, F.substring(path, 1, n)).alias("key")))))
    return F.transform(F.array_sort(F.when(host == "", F.slice(keys, 1, 0)).otherwise(keys)),
                       lambda k: F.struct(k["key"].alias("key"), *_hashed(k["key"])))


class LevelTooLarge(ValueError):
    """More keys than a level has bits for."""


@dataclass(frozen=True)
class Cascade:
    """Levels of bits (64-bit words); listed keys are in level 0, and a key is listed if it leaves after an even one."""
    levels: list[np.ndarray]
    hashes: int

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        inside = np.zeros(len(h1), bool)
        rest = np.arange(len(h1))
        for depth, bits in enumerate(self.levels):
            passed = np.ones(len(rest), bool)
            for at in _places(h1[rest], h2[rest], depth, len(bits) * 64, self.hashes):
                passed &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
            rest = rest[passed]
            inside[rest] = depth % 2 == 0
        return inside


def _places(h1: np.ndarray, h2: np.ndarray, depth: int, size: int, hashes: int) -> Iterator[np.ndarray]:
    salt = np.uint64((depth + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    first, step = mix64(h1.view(np.uint64) + salt), mix64(h2.view(np.uint64) ^ salt) | np.uint64(1)
    for k in range(hashes):
        yield mix64(first + np.uint64(k) * step) % np.uint64(size)


def _level(keys: DataFrame, depth: int, config: CascadeConfig) -> np.ndarray:
    """A Bloom filter of the keys (h1, h2): bits are set on the executors and combined as 64-bit words."""
    size = -(-max(1, keys.count()) * config.bits_per_key // 64) * 64
    if size > config.max_bits:
        raise LevelTooLarge(f"a level of {size} bits is above the bound")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
            at = np.concatenate(list(_places(h1, h2, depth, size, config.hashes)) or [np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([
                pa.array((at >> np.uint64(6)).astype(np.int64)),
                pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "mask"])

    words = (keys.select("h1", "h2").mapInArrow(run, "word long, mask long")
             .groupBy("word").agg(F.expr("bit_or(mask)").alias("mask")).toPandas())     # size / 64 rows at most
    bits = np.zeros(size // 64, np.uint64)
    bits[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64).view(np.uint64)
    return bits


def _passing(keys: DataFrame, cascade: Cascade) -> DataFrame:
    """Keys (key, h1, h2) that the last level of the cascade passes."""
    shared = keys.sparkSession.sparkContext.broadcast((cascade.levels[-1], len(cascade.levels) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, depth = shared.value
        for batch in batches:
            h1, h2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
            passed = np.ones(batch.num_rows, bool)
            for at in _places(h1, h2, depth, len(bits) * 64, cascade.hashes):
                passed &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
            yield batch.filter(pa.array(passed))

    return keys.mapInArrow(run, "key string, h1 long, h2 long")


def build_cascade(listed: DataFrame, universe: DataFrame, config: CascadeConfig = CascadeConfig()) -> Cascade:
    """A cascade that is exact for every key of `listed` and `universe` (distinct, columns key, h1, h2)."""
    inside = materialise(listed.select("key", "h1", "h2"))
    if inside.isEmpty():
        return Cascade([], config.hashes)
    cascade = Cascade([_level(inside, 0, config)], config.hashes)
    outside = materialise(_passing(universe.select("key", "h1", "h2"), cascade).join(inside.select("key"), "key", "left_anti")
                          .select("key", "h1", "h2"))
    while not outside.isEmpty():
        if len(cascade.levels) >= config.max_levels:
            raise ValueError("two keys share both hashes")
        cascade = Cascade([*cascade.levels, _level(outside, len(cascade.levels), config)], config.hashes)
        inside, outside = outside, materialise(_passing(inside, cascade))
    return cascade


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                default: str = "allow", config: CascadeConfig = CascadeConfig()) -> DataFrame:
    """id, host, path, rule (host and path of the longest rule that fits, of equally long ones that with the longer host;
    else null) and verdict (the rule's, else `default`) per row of pages.

    rules: host, path, verdict (`allow` or `block`), any number of rows; repeated rules count once, and one listed with both
    verdicts blocks. A null url or one without `://` has an empty host and path and no rule. Repeated rows and null ids
    stay; no rules leave every url to `default`, no pages give an empty result.

    What is broadcast at a time is two cascades with levels of at most `config.max_bits`. Where the keys, or those of the
    urls that a level passes wrongly, need more, keys are dealt to twice as many cascades by their hash until they fit;
    the urls then go through one step for each."""
    host, path = url_parts(F.col(url_col))
    listed = materialise(rules.select(F.concat(ascii_lower(F.col("host")), "path").alias("key"), F.length("path").alias("n"),
                                      F.size(F.split("host", r"\.")).alias("labels"), (F.col("verdict") == "block").alias("block"))
                         .groupBy("key").agg(F.max("block").alias("block"), F.collect_set("n").alias("n"), F.max("labels").alias("labels")))
    lengths = sorted(r["n"] for r in listed.select(F.explode("n").alias("n")).distinct().collect())     # as many as rule paths have lengths
    most = listed.agg(F.max("labels")).first()[0] or 1
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).select(
        "id", "host", "path", (url_keys(F.col("host"), F.col("path"), lengths, most) if lengths else
                               F.expr("array()").cast("array<struct<key:string,h1:bigint,h2:bigint>>")).alias("keys"))
    universe = urls.select(F.explode("keys").alias("k")).select("k.*").distinct()
    known = listed.select("key", *_hashed(F.col("key")), "block")
    segments = max(1, -(-known.count() * config.bits_per_key // config.max_bits))
    while True:
        keys = universe if segments == 1 else materialise(universe)
        try:
            cascades = [_pair(known, keys, s, segments, config) for s in range(segments)]
            break
        except LevelTooLarge:
            segments *= 2
    schema, out = urls.schema, urls
    state = T.StructType([*schema.fields, T.StructField("at", T.LongType()), T.StructField("blocked", T.BooleanType())])
    for s, pair in enumerate(cascades):
        out = out.mapInArrow(_judge(pages.sparkSession.sparkContext.broadcast(pair), s, segments), state)
    rule = F.when(F.col("at") >= 0, F.get(F.col("keys.key"), F.col("at").cast("int")))
    verdict = F.when(F.col("at") < 0, F.lit(default)).when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def _pair(known: DataFrame, universe: DataFrame, segment: int, segments: int, config: CascadeConfig) -> tuple[Cascade, Cascade]:
    """(cascade of the listed keys, of the blocking ones among them) for one segment of the keys."""
    mine = lambda df: df if segments == 1 else df.where(F.pmod(F.col("h1"), F.lit(segments)) == segment)
    listed = mine(known)
    return build_cascade(listed, mine(universe), config), build_cascade(listed.where("block"), listed.where("NOT block"), config)


def _judge(shared, segment: int, segments: int):
    """Rows of urls -> with `at`, the place of the longest listed key so far (-1: none), and `blocked`, whether it blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule_keys, block_keys = shared.value
        for batch in batches:
            keys = batch.column("keys")
            flat, sizes = keys.flatten(), keys.value_lengths().to_numpy(zero_copy_only=False)
            h1, h2 = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h1", "h2"))
            mine = np.flatnonzero(np.mod(h1, segments) == segment)
            hits = mine[rule_keys.contains(h1[mine], h2[mine])]
            starts = np.cumsum(sizes) - sizes
            rows, first = np.unique(np.repeat(np.arange(batch.num_rows), sizes)[hits], return_index=True)   # the longest comes first
            found = hits[first]
            at, blocked = np.full(batch.num_rows, -1), np.zeros(batch.num_rows, bool)
            at[rows] = found - starts[rows]
            blocked[rows] = block_keys.contains(h1[found], h2[found])
            if segment:
                old, was = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "blocked"))
                keep = (old >= 0) & ((at < 0) | (old < at))
                at, blocked = np.where(keep, old, at), np.where(keep, was.astype(bool), blocked)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "host", "path", "keys")), pa.array(at, pa.int64()), pa.array(blocked)],
                                             names=["id", "host", "path", "keys", "at", "blocked"])

    return run
