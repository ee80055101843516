"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A template is the set of words of a license notice. A block is a window of consecutive words, line breaks or not, taken as
a set; its length is that up to which a template's words can make up the threshold's share of a block: the notice's words
divided by the threshold (a shorter text is one block). A block meets a template if it holds at least `threshold` of the
template's words. Words of all templates are ordered by how often they occur in all documents, rarest first. A template of
n words of which k are needed shares one of its n - k + 1 rarest words with every block that meets it (prefix filter), so
that blocks are looked at around these words only; the block needs k template words at least (length filter); and the words
that follow the shared one in either order must suffice for what is still missing (positional filter). What is left is
decided by the overlap itself. DataFrame operations only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from churnforge.llm.asciiwords import ascii_lower, count_words, only_words, split_words
from churnforge.llm.textbatch import materialise

# Phrases and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
# Notices and the labels that the set join adds.
TEMPLATES = {
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "apache-notice": "licensed under the apache license version 2 0",
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "mit-notice": "released under the mit license",
    "permission-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "redistribution-notice": "redistribution and use in source and binary forms with or without modification are permitted",
}


#: Words of a stretch of a text.
STRETCH_WORDS = 1_024


@dataclass(frozen=True)
class LicenseConfig:
    threshold: float = 0.8                  #: share of a template's words that a block must hold
    phrases: dict[str, str] = field(default_factory=lambda: dict(PHRASES))
    templates: dict[str, str] = field(default_factory=lambda: dict(TEMPLATES))


def _local(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A table of the configuration's own rows (as many as it names templates, phrases or their words)."""
    return spark.range(1).select(F.inline(F.array(*[
        F.struct(*[F.lit(v).alias(k) for k, v in row.items()]) for row in rows])))


def ranked_templates(docs: DataFrame, config: LicenseConfig) -> tuple[dict[str, int], list[dict]]:
    """(rank of each template word by its count in all documents, rarest first; one entry for each template)."""
    words = sorted({w for t in config.templates.values() for w in t.split()})
    if not words:
        return {}, []
    known = F.broadcast(_local(docs.sparkSession, [{"word": w} for w in words]))        # the templates' words
    counts = {r["word"]: r["count"] for r in docs.select(F.explode(split_words(F.lower("text"))).alias("word"))
              .join(known, "word").groupBy("word").count().collect()}
    rank = {w: k for k, w in enumerate(sorted(words, key=lambda w: (counts.get(w, 0), w)))}
    entries = []
    for label, text in sorted(config.templates.items()):
        ranks = sorted({rank[w] for w in text.split()})
        need = max(1, math.ceil(config.threshold * len(ranks) - 1e-9))
        width = max(1, math.ceil(len(text.split()) / config.threshold - 1e-9))
        entries.append({"label": label, "ranks": ranks, "need": need, "width": width})
    return rank, entries


def _phrase_places(found: DataFrame, config: LicenseConfig) -> DataFrame:
    """(id, body, start, label) of every place where a phrase's words stand consecutively."""
    phrases = F.broadcast(_local(found.sparkSession, [
        {"first": p.split()[0], "phrase": p, "len": len(p.split()), "label": v} for p, v in config.phrases.items()]))
    places = found.select("id", "body", only_words(F.col("text")).alias("words")).select("id", "body", "words", F.posexplode("words").alias("start", "first"))
    stands = F.array_join(F.slice("words", F.col("start") + 1, F.col("len")), " ") == F.col("phrase")
    return places.join(phrases, "first").where(stands).select("id", "body", F.col("start").cast("long").alias("start"), "label")


def _template_blocks(found: DataFrame, rank: dict[str, int], entries: list[dict]) -> DataFrame:
    """(id, body, start, label, containment) of blocks that meet a template: all blocks around a prefix word that begin at a
    template word. Any other block that meets it holds no more of the template than one of these."""
    spark = found.sparkSession
    ranks = F.broadcast(_local(spark, [{"word": w, "rank": r} for w, r in rank.items()]))
    prefix = F.broadcast(_local(spark, [
        {"rank": r, "label": e["label"], "place": k, "need": e["need"], "size": len(e["ranks"]), "width": e["width"]}
        for e in entries for k, r in enumerate(e["ranks"][:len(e["ranks"]) - e["need"] + 1])]))
    sets = F.broadcast(_local(spark, [{"label": e["label"], "ranks": e["ranks"]} for e in entries]))
    words = found.select("id", "body", F.posexplode(only_words(F.col("text"))).alias("at", "word"))
    hits = words.join(ranks, "word").select("id", "body", "at", "rank")
    # the template words around each one: a frame of bounded width, so no text is gathered. A text is cut into stretches
    # that overlap by that width, so that a very long one is not one group either
    reach = max(e["width"] for e in entries) - 1
    stretch = max(STRETCH_WORDS, 2 * reach + 1)
    of = lambda at: F.floor(at / stretch)
    dealt = hits.withColumn("part", F.explode(F.array_distinct(F.array(of(F.col("at") - reach), of(F.col("at") + reach)))))
    around = Window.partitionBy("id", "body", "part").orderBy("at").rangeBetween(-reach, reach)
    near = dealt.withColumn("near", F.collect_list(F.struct("at", "rank")).over(around)).where(F.col("part") == of(F.col("at")))
    shared = near.drop("part").join(prefix, "rank")
    starts = F.transform(F.filter("near", lambda x: (x["at"] > F.col("at") - F.col("width")) & (x["at"] <= F.col("at"))), lambda x: x["at"])
    block = shared.select("id", "body", "rank", "near", "label", "place", "need", "size", "width", F.explode(starts).alias("start"))
    inside = F.filter("near", lambda x: (x["at"] >= F.col("start")) & (x["at"] < F.col("start") + F.col("width")))
    block = block.withColumn("have", F.array_sort(F.array_distinct(F.transform(inside, lambda x: x["rank"])))).drop("near")
    before = F.array_position("have", F.col("rank")) - 1
    rest = F.least(F.size("have") - before, F.col("size") - F.col("place"))
    passed = block.where((F.size("have") >= F.col("need")) & (before + rest >= F.col("need")))
    both = F.size(F.array_intersect("have", "ranks"))
    return (passed.select("id", "body", "start", "have", "label", "need", "size").distinct().join(sets, "label")
            .where(both >= F.col("need")).select("id", "body", "start", "label", (both / F.col("size")).alias("containment")))


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  config: LicenseConfig = LicenseConfig()) -> DataFrame:
    """id, n_words, n_base (places of phrases), first_word and last_word (smallest and largest start of a place, words
    from 0; else null), base_labels, labels (of phrases and templates; sorted arrays), score per row of df.

    score is 1 if a phrase stands in the text, else the largest containment of a template that a block meets, else 0.
    Null and empty texts have no words; repeated rows stay repeated; ids may be null; an empty table gives an empty
    result."""
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rank, entries = ranked_templates(docs, config)
    prefixes = {r for e in entries for r in e["ranks"][:len(e["ranks"]) - e["need"] + 1]}
    anchors = {p.split()[-1] for p in config.phrases} | {w for w, r in rank.items() if r in prefixes}
    pieces = split_words(F.lower("text"))
    # a document without a phrase's last word and without a prefix word of a template has nothing
    may = F.arrays_overlap("pieces", F.array(*[F.lit(w) for w in sorted(anchors)])) if anchors else F.lit(False)
    rows = materialise(docs.select("id", "text", pieces.alias("pieces")).select(
        "id", F.xxhash64("text").alias("body"), count_words(F.col("pieces")).alias("n_words"),
        F.when(may, ascii_lower(F.col("text"))).alias("text")))
    found = rows.where("text IS NOT NULL").select("id", "body", "text").distinct()
    texts = rows.groupBy("id", "body").agg(F.count(F.lit(1)).alias("copies"), F.first("n_words").alias("n_words"))
    parts = []
    if config.phrases:
        parts.append(_phrase_places(found, config).select(
            "id", "body", "start", F.col("label").alias("base"), "label", F.lit(1.0).alias("score")))
    if entries:
        parts.append(_template_blocks(found, rank, entries).select(
            "id", "body", F.lit(None).cast("long").alias("start"), F.lit(None).cast("string").alias("base"), "label",
            F.col("containment").alias("score")))
    none = found.limit(0).select("id", "body", F.lit(None).cast("long").alias("start"), F.lit("").alias("base"),
                                 F.lit("").alias("label"), F.lit(0.0).alias("score"))
    all_parts = none
    for part in parts:
        all_parts = all_parts.unionByName(part)
    marks = all_parts.groupBy("id", "body").agg(
        F.count("start").alias("n_base"), F.min("start").alias("first_word"), F.max("start").alias("last_word"),
        F.array_sort(F.collect_set("base")).alias("base_labels"), F.array_sort(F.collect_set("label")).alias("labels"),
        F.max("score").alias("score"))
    t, m = texts.alias("t"), marks.alias("m")
    no_labels = F.array().cast("array<string>")
    out = t.join(m, F.expr("t.id <=> m.id AND t.body = m.body"), "left").select(
        F.col("t.id").alias(id_col), "t.n_words", F.coalesce("m.n_base", F.lit(0).cast("long")).alias("n_base"),
        "m.first_word", "m.last_word", F.coalesce("m.base_labels", no_labels).alias("base_labels"),
        F.coalesce("m.labels", no_labels).alias("labels"), F.coalesce("m.score", F.lit(0.0)).alias("score"), "t.copies")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies", "copy")
