"""Main text of HTML pages by wrappers inferred from all pages of a host.

Every page's token stream is folded into its own expression; equal expressions of a host are counted once, their slots'
statistics summed by Spark. The expressions of a host are then aligned in rounds, each task taking a bounded number of
them, until one wrapper is left (`wrappers`). A wrapper's slots are judged by the parts of the page that they stand in, by
what stays the same on all pages, and by the share of text in links; a page's text is what its tokens put into the
wrapper's slots of main text. Pages never meet in one task: only expressions do, and they are dealt by their hash.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from churnforge.llm.pagetree import page_tree, runs
from churnforge.llm.textbatch import materialise, slices, texts
from churnforge.llm.urlfilter import url_parts
from churnforge.llm.wrappers import OTHER, align, dump, label_page, load, page_items, slots


@dataclass(frozen=True)
class ExtractConfig:
    fan_in: int = 64                        #: expressions that one task aligns
    held: int = 2_000                       #: expressions that a task counts before it hands them on
    broadcast_bytes: int = 16 << 20         #: of all wrappers; more are joined by a shuffle
    pages_a_share: int = 5_000              #: pages of a host that one share of that shuffle takes


_SLOTS = "host string, expr string, slot int, n long, chars long, links long, low long, high long"


def _expressions(config: ExtractConfig):
    schema = pa.schema([("host", pa.string()), ("expr", pa.string()), ("slot", pa.int32()), *[
        (c, pa.int64()) for c in ("n", "chars", "links", "low", "high")]])

    def table(held: dict) -> pa.RecordBatch:
        rows = [(host, expr, k, *stat) for (host, expr), stats in held.items() for k, stat in enumerate(stats or [[1, 0, 0, 0, 0]])]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list[list[int]]] = {}
        for batch in batches:
            for part in slices(batch, "html"):
                for host, page in zip(part.column("host").to_pylist(), texts(part.column("html")), strict=True):
                    items = page_items(page_tree(page))
                    key, stats = (host, dump(items)), [x.stat for x in slots(items)]
                    known = held.get(key)
                    held[key] = stats if known is None else [
                        [s[0] + t[0], s[1] + t[1], s[2] + t[2], min(s[3], t[3]), max(s[4], t[4])]
                        for s, t in zip(known, stats, strict=True)]
                    if len(held) >= config.held:
                        yield table(held)
                        held = {}
        if held:
            yield table(held)

    return run


def _aligned(rows: pa.Table) -> pa.Table:
    """The wrapper of the expressions of one group, taken in the order of their text."""
    host, group = rows.column("host")[0].as_py(), rows.column("group")[0].as_py()
    made, pages = None, 0
    for expr, stats in sorted(zip(rows.column("expr").to_pylist(), rows.column("stats").to_pylist(), strict=True)):
        items = load(expr, json.loads(stats))
        made = items if made is None else align(made, items, True)
    return pa.table({"host": pa.array([host], pa.string()), "part": pa.array([group], pa.int64()),
                     "expr": pa.array([dump(made)], pa.string()),
                     "stats": pa.array([json.dumps([x.stat for x in slots(made)], separators=(",", ":"))], pa.string())})


def infer_wrappers(pages: DataFrame, config: ExtractConfig = ExtractConfig()) -> DataFrame:
    """One row per host of `pages` (host, html): host, expr (the wrapper) and stats (of its slots, as JSON).

    A null html counts as an empty page. The result does not depend on how the pages are dealt to partitions."""
    found = pages.select("host", "html").mapInArrow(_expressions(config), _SLOTS)
    # sums first: one very common expression never gathers in one task
    summed = found.groupBy("host", "expr", "slot").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"),
                                                       F.sum("links").alias("links"), F.min("low").alias("low"), F.max("high").alias("high"))
    stat = F.array("n", "chars", "links", "low", "high")
    whole = summed.groupBy("host", "expr").agg(F.sort_array(F.collect_list(F.struct("slot", stat.alias("stat")))).alias("s"))
    rows = materialise(whole.select("host", F.xxhash64("expr").alias("part"), "expr",
                                    F.to_json(F.transform("s", lambda x: x.stat)).alias("stats")))
    most = rows.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    while most > 1:
        groups = -(-most // config.fan_in)
        dealt = rows.withColumn("group", F.pmod(F.xxhash64("part"), F.lit(groups)))
        rows = materialise(dealt.groupBy("host", "group").applyInArrow(_aligned, "host string, part long, expr string, stats string"))
        most = 1 if groups == 1 else rows.groupBy("host").count().agg(F.max("count")).first()[0]
    return rows.select("host", "expr", "stats")


def _texts(carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                found = []
                for page, expr, stats in zip(texts(part.column("html")), part.column("expr").to_pylist(),
                                             part.column("stats").to_pylist(), strict=True):
                    root = page_tree(page)
                    every = runs(root)
                    if every:
                        label_page(page_items(root), expr, stats)
                    tier = min((r.tier for r in every if 0 < r.tier < OTHER), default=OTHER)
                    found.append(" ".join(r.text for r in every if r.tier == tier < OTHER))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in carried), pa.array(found, pa.string()),
                     pa.array([len(f) for f in found], pa.int64())], names=[*carried, "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 config: ExtractConfig = ExtractConfig()) -> DataFrame:
    """id, url, text and n_chars (code points of text) per row of `pages`.

    The text holds the blocks of the article in page order, joined by one space; within a block white space is one space
    and character references are decoded. Null and empty html, and pages without main text, give the empty text. Pages
    without a host (no url, or none with `://`) share a wrapper. Repeated rows are kept and count again; an empty table
    gives an empty result; other columns of `pages` do not matter."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumn("host", url_parts(F.coalesce("url", F.lit("")))[0])
    wrappers = infer_wrappers(rows, config)
    size = wrappers.agg(F.sum(F.length("expr") + F.length("stats") + F.length("host"))).first()[0] or 0
    if size <= config.broadcast_bytes:
        met = rows.join(F.broadcast(wrappers), "host", "left")
    else:
        # a host's pages are dealt to shares, each of which gets the host's wrapper
        shares = rows.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / config.pages_a_share).alias("shares"))
        spread = wrappers.join(shares, "host").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
        dealt = rows.join(F.broadcast(shares) if shares.count() <= 100_000 else shares, "host")
        met = (dealt.withColumn("share", F.pmod(F.xxhash64("id", "html"), F.col("shares")))
               .join(spread.select("host", "share", "expr", "stats").hint("shuffle_hash"), ["host", "share"], "left"))
    kind = dict(rows.dtypes)["id"]
    out = met.select("id", "url", "html", "expr", "stats").mapInArrow(
        _texts(["id", "url"]), f"id {kind}, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
