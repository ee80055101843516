"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Every item is cut into windows; a window is the set of its shingles. Shingles are ordered by how often they occur in all
documents. An occurrence must contain the whole window, so its rarest shingle is a sufficient prefix: documents are
joined on that one shingle, the place of the window follows from the shingle's place in it, places that would run over
either end of the document are ruled out, and the words are compared. A window with a shingle that no document has cannot
occur and is left out before the join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from churnforge.llm.asciiwords import ascii_lower, count_words, folded, lead, only_words, split_words
from churnforge.llm.textbatch import materialise

#: Gaps in a text whose capital letters are still there: boundaries fall in the same places.
GAP_KEEPING_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class DecontaminationConfig:
    window: int = 10                        #: words of a window; a shorter item is one window
    shingle: int = 3                        #: words of a shingle; shorter windows are one shingle
    broadcast_rows: int = 300_000           #: shingle tables up to this many rows are broadcast, larger ones shuffled


def _shingle(words: Column, at: Column, n: int) -> Column:
    """Join key of the n words from index `at`; the words decide later."""
    return F.xxhash64(F.lit(n), *[F.get(words, at + k) for k in range(n)])


def item_windows(items: DataFrame, item_col: str, text_col: str, config: DecontaminationConfig) -> DataFrame:
    """(item, exact, folded): every window's words, exactly lower-cased and joined, and folded for the candidate search."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = items.select(F.col(item_col).cast("string").alias("item"),
                         only_words(ascii_lower(text)).alias("exact"),
                         only_words(folded(text)).alias("folded")).where(F.size("exact") > 0)
    last = F.greatest(F.size("exact") - config.window, F.lit(0))
    return words.select("item", "exact", "folded", F.explode(F.sequence(F.lit(1), last + 1)).alias("at")).select(
        "item", F.array_join(F.slice("exact", F.col("at"), config.window), " ").alias("exact"),
        F.slice("folded", F.col("at"), config.window).alias("folded")).distinct()


#: Items whose windows share a checkpoint file.
ITEMS_A_FILE = 10_000


def _small(df: DataFrame, config: DecontaminationConfig) -> DataFrame:
    """Broadcast hint for a table that was counted and is under the bound."""
    return F.broadcast(df) if df.count() <= config.broadcast_rows else df


def window_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                item_col: str = "item_id", item_text_col: str = "text",
                config: DecontaminationConfig = DecontaminationConfig()) -> tuple[DataFrame, DataFrame]:
    """(rows, hits). rows: id, body (hash of the text, tells rows with one id apart), copies, n_words. hits: id, body,
    start (word from 0), len, exact (the window's words)."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    files = -(-max(1, items.count()) // ITEMS_A_FILE)        # tables of windows and shingles follow the items
    windows = materialise(item_windows(items, item_col, item_text_col, config).coalesce(files))
    unique = windows.select("exact", "folded").distinct()
    n = F.least(F.size("folded"), F.lit(config.shingle))
    pieces = texts.select("id", "text", split_words(folded(F.col("text"))).alias("pieces"))

    # the shingles of all windows and how often each occurs in the documents
    parts = unique.select("exact", "folded", n.alias("n"), F.explode(F.sequence(F.lit(0), F.size("folded") - n)).alias("at"))
    lengths = [r["n"] for r in parts.select("n").distinct().collect()]      # at most `shingle` values
    key = F.lit(None).cast("long")
    for k in lengths:
        key = F.when(F.col("n") == k, _shingle(F.col("folded"), F.col("at"), k)).otherwise(key)
    parts = materialise(parts.select("exact", "folded", "at", key.alias("key")).coalesce(files))
    wanted = _small(parts.select("key").distinct(), config)

    def keyed(source: DataFrame, k: int, *columns: str) -> DataFrame:
        """A row for each piece, with the key of the k words from there."""
        places = source.select(*columns, "pieces", F.explode(F.sequence(F.lit(0), F.size("pieces") - 1)).alias("i"))
        return places.select(*columns, "pieces", "i", _shingle(F.col("pieces"), F.col("i"), k).alias("key"))

    counts = None
    for k in lengths:
        found = keyed(pieces, k).select("key").join(wanted, "key").groupBy("key").count()
        counts = found if counts is None else counts.unionByName(found)
    rows = pieces.select("id", F.xxhash64("text").alias("body"), count_words(F.col("pieces")).alias("n_words"))
    empty = rows.limit(0).select("id", "body", F.lit(0).alias("start"), F.lit(0).alias("len"), F.lit("").alias("exact"))
    if counts is None:
        return _copies(rows), empty
    counts = materialise(counts.coalesce(files))

    # the rarest shingle of each window that occurs at all
    scored = parts.join(F.broadcast(counts) if counts.count() <= config.broadcast_rows else counts, "key", "left")
    rarest = materialise(
        scored.groupBy("exact", "folded").agg(
            F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "at", "key")).alias("p"))
        .where("p.count > 0").select("exact", "folded", F.size("folded").alias("len"), F.col("p.at").alias("at"),
                                     F.col("p.key").alias("key"), F.least(F.size("folded"), F.lit(config.shingle)).alias("n"))
        .coalesce(files))
    small = rarest.count() <= config.broadcast_rows
    # kept: the pieces with their capital letters, so that places can be decided without cutting the text again
    both = texts.select("id", F.xxhash64("text").alias("body"), split_words(folded(F.col("text"))).alias("pieces"),
                        F.split("text", GAP_KEEPING_CASE).alias("kept"))
    out = None
    for k in lengths:
        needles = rarest.where(F.col("n") == k).drop("n")
        found = _places(keyed, both, needles, k) if small else _places_by_shuffle(keyed, both, needles, k)
        out = found if out is None else out.unionByName(found)
    return _copies(rows), out.distinct()


def _start() -> Column:
    """The window's first piece, from the place of its shingle."""
    return F.col("i") - F.col("at")


def _inside(start: Column, first: Column, n_words: Column) -> Column:
    return (start >= first) & (start + F.col("len") <= first + n_words)


def _stands(kept: Column, start: Column, length: Column, exact: Column) -> Column:
    """Do the window's words stand there? Capital letters beyond ASCII count."""
    return ascii_lower(F.array_join(F.slice(kept, start + 1, length), " ")) == exact


def _places(keyed, both: DataFrame, needles: DataFrame, k: int) -> DataFrame:
    """Places of windows, with a broadcast of their rarest shingles: positions never leave the scan's tasks."""
    start, first = _start(), lead(F.col("pieces"))
    inside = _inside(start, first, count_words(F.col("pieces")))
    exact = _stands(F.col("kept"), start, F.col("len"), F.col("exact"))
    return (keyed(both, k, "id", "body", "kept").join(F.broadcast(needles), "key")
            .where(F.when(inside, exact))
            .select("id", "body", (start - first).alias("start"), "len", "exact"))


def _places_by_shuffle(keyed, both: DataFrame, needles: DataFrame, k: int) -> DataFrame:
    """Places of windows for a benchmark that is too large to broadcast: narrow rows meet by shingle, and what is left
    meets its text once."""
    marked = both.withColumn("first", lead(F.col("pieces"))).withColumn("n_words", count_words(F.col("pieces")))
    narrow = keyed(marked, k, "id", "body", "first", "n_words").select("id", "body", "first", "n_words", "i", "key")
    start = _start()
    near = (narrow.join(needles.drop("folded"), "key").where(_inside(start, F.col("first"), F.col("n_words")))
            .select("id", "body", start.alias("at"), "first", "len", "exact").distinct()
            .groupBy("id", "body", "first").agg(F.collect_list(F.struct("at", "len", "exact")).alias("near")))
    texts = both.select("id", "body", "kept").dropDuplicates(["id", "body"]).alias("t")
    met = near.alias("n").join(texts, F.expr("n.id <=> t.id AND n.body = t.body"))
    good = F.filter("n.near", lambda c: _stands(F.col("t.kept"), c["at"], c["len"], c["exact"]))
    return (met.select("n.id", "n.body", "n.first", F.explode(good).alias("c"))
            .select("id", "body", (F.col("c.at") - F.col("first")).alias("start"), "c.len", "c.exact"))


def _copies(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id", "body").agg(F.count(F.lit(1)).alias("copies"), F.first("n_words").alias("n_words"))


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text",
                       config: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """id, n_words, n_hit (words inside any occurrence of a window), items (sorted ids, as strings, of the items whose
    windows occur) and body (xxhash64 of the text) per row of docs (no rows for an empty table).

    Null and empty texts have no words; repeated rows stay repeated; an item without words has no window; items with one
    id count once, items without an id hit words but are not listed. No items: nothing is hit."""
    rows, hits = window_hits(docs, items, id_col, text_col, item_col, item_text_col, config)
    hits = materialise(hits)
    windows = item_windows(items, item_col, item_text_col, config).where("item IS NOT NULL").select("exact", "item").distinct()
    words = (hits.select("id", "body", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("w"))
             .distinct().groupBy("id", "body").agg(F.count(F.lit(1)).alias("n_hit")))
    listed = (hits.select("id", "body", "exact").distinct().join(windows, "exact").groupBy("id", "body")
              .agg(F.array_sort(F.collect_set("item")).alias("items")))       # at most the benchmark's items
    r, w, i = rows.alias("r"), words.alias("w"), listed.alias("i")
    same = "r.id <=> {0}.id AND r.body = {0}.body"
    out = r.join(w, F.expr(same.format("w")), "left").join(i, F.expr(same.format("i")), "left").select(
        F.col("r.id").alias(id_col), "r.n_words", F.coalesce("w.n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("i.items", F.array().cast("array<string>")).alias("items"), "r.body", "r.copies")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies", "copy")
