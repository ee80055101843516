"""Ranked lexical search by two trees: one over items, one over documents.

A node holds the largest value of every coordinate (term) below it: of items the weight of a term, of documents its
saturated frequency. The products of two nodes' maxima add up to a bound for every pair below them. A pair of nodes whose
bound is under the weakest k-th score among its items is dropped whole; all others are opened, down to exact scores. All
values are whole numbers, so bounds and scores are exact. The best scores of a task stay with it from one batch of documents
to the next; a first look at a small share of the documents gives weakest scores to start with (any documents' scores do).

The documents' terms are cut once into a table that holds, per document, the items' terms with their counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from churnforge.llm.asciiwords import ascii_lower, only_words
from churnforge.llm.textbatch import materialise, slices

_LARGE = np.iinfo(np.int64).max


@dataclass(frozen=True)
class RankedConfig:
    k: int = 10
    saturation: int = 8                     #: a term counts tf * 10^9 div (1000 * tf + saturation * m)
    length_share: int = 90                  #: hundredths of m that follow the document's length
    terms_a_block: int = 200_000            #: terms of the items that are searched for at once
    items_a_leaf: int = 4
    docs_a_leaf: int = 32
    docs_a_batch: int = 4_096
    entries_a_batch: int = 2_000_000        #: terms of a batch's documents, all together (one document at least)
    first_look: int = 64                    #: one document in so many gives the weakest scores to start with


@dataclass(frozen=True)
class Items:
    """A bounded block of items: their terms in order, and per item the places of its terms."""
    number: np.ndarray                      #: the items' row numbers
    terms: list[str]
    item: np.ndarray                        #: of every (item, term)
    term: np.ndarray


def _rows(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    terms = F.array_distinct(only_words(ascii_lower(F.coalesce(F.col(text_col), F.lit("")))))
    return materialise(items.select(F.col(item_col).alias("item_id"), terms.alias("terms"),
                                    F.monotonically_increasing_id().alias("number")).where(F.size("terms") > 0))


def _item_blocks(rows: DataFrame, config: RankedConfig) -> list[tuple[int, int]]:
    """Ranges of row numbers whose items have about terms_a_block terms (one item at least)."""
    sizes = rows.select("number", F.shiftright("number", 33).alias("part"), F.size("terms").alias("n"))
    out, start, end, total = [], 0, 0, 0
    for part, terms in sorted(map(tuple, sizes.groupBy("part").agg(F.sum("n")).collect())):
        steps = [(((part + 1) << 33) - 1, terms)]
        if terms > config.terms_a_block:                    # cut inside the partition
            steps = sizes.where(F.col("part") == part).select("number", "n").orderBy("number").toLocalIterator()
        for number, n in steps:
            if total and total + n > config.terms_a_block:
                out.append((start, end))
                start, total = end + 1, 0
            total, end = total + n, number
    return [*out, (start, _LARGE)] if total else out


def _collect(rows: DataFrame, first: int, last: int) -> Items:
    held = rows.where(F.col("number").between(first, last)).orderBy("number").collect()
    terms = sorted({t for r in held for t in r["terms"]})
    place = {t: k for k, t in enumerate(terms)}
    return Items(np.array([r["number"] for r in held], np.int64), terms,
                 np.repeat(np.arange(len(held)), [len(r["terms"]) for r in held]),
                 np.array([place[t] for r in held for t in r["terms"]], np.int64))


_COUNTED = "doc_id long, n long, terms binary, tf binary"


def _counted(terms: list[str]):
    """Per document: its number of terms, and which of `terms` it has how often."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms, pa.string())
        for batch in batches:
            for part in slices(batch, "text"):
                lowered = pc.ascii_lower(pc.fill_null(part.column("text"), ""))
                pieces = pc.split_pattern_regex(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
                doc, word = pc.list_parent_indices(pieces), pc.list_flatten(pieces)
                real = pc.not_equal(word, "")
                doc, word = doc.filter(real).to_numpy().astype(np.int64), word.filter(real)
                n = np.bincount(doc, minlength=part.num_rows)
                at = pc.index_in(word, value_set=known)
                held = pc.is_valid(at).to_numpy(zero_copy_only=False)
                pairs, tf = np.unique(doc[held] * len(terms) + at.drop_null().to_numpy().astype(np.int64), return_counts=True)
                cut = np.searchsorted(pairs, np.arange(part.num_rows + 1) * len(terms))
                term, tf = (pairs % max(len(terms), 1)).astype(np.uint32), tf.astype(np.uint32)
                one = lambda v: pa.array([v[a:z].tobytes() for a, z in zip(cut, cut[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), one(term), one(tf)],
                                                 names=["doc_id", "n", "terms", "tf"])

    return run


def _frequencies(n_terms: int):
    """Number of documents that hold a term, one row per term and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            held = b"".join(batch.column("terms").to_pylist())
            df += np.bincount(np.frombuffer(held, np.uint32), minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["term", "df"])

    return run


def _maxima(node: np.ndarray, term: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, term, largest value) of every node and term, in order."""
    order = np.lexsort((term, node))
    node, term, value = node[order], term[order], value[order]
    first = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (term[1:] != term[:-1])]) if len(node) else np.zeros(0, np.int64)
    return node[first], term[first], np.maximum.reduceat(value, first) if len(first) else value


class _Tree:
    """Levels of nodes over 0 .. n-1, the leaves first; every level halves the number of nodes, or less (`fan`)."""

    def __init__(self, leaf_of: np.ndarray, term: np.ndarray, value: np.ndarray, fan: int):
        self.levels, node = [], leaf_of
        while True:
            node, term, value = _maxima(node, term, value)
            count = int(node[-1]) + 1 if len(node) else 0
            self.levels.append((np.searchsorted(node, np.arange(count + 1)), term, value))
            if count <= 1:
                break
            node = node // fan
        self.fan = fan


def _gather(starts: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, first place of every node) of the entries of some nodes, one after the other."""
    sizes = starts[nodes + 1] - starts[nodes]
    first = np.cumsum(sizes) - sizes
    return np.repeat(starts[nodes] - first, sizes) + np.arange(sizes.sum()), first


def _sums(products: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of products; an empty run gives 0."""
    out = np.zeros(len(first), np.int64)
    full = sizes > 0
    if full.any():
        out[full] = np.add.reduceat(products, first[full])
    return out


class _Search:
    """The best scores of a block of items so far, and the tree over the items."""

    def __init__(self, items: Items, weight: np.ndarray, floor: np.ndarray, config: RankedConfig):
        self.config, self.n_items, self.n_terms = config, len(items.number), len(items.terms)
        # items with the same heaviest term stand together
        heaviest = np.zeros(self.n_items, np.int64)
        for k in np.argsort(weight[items.term], kind="stable"):
            heaviest[items.item[k]] = items.term[k]
        self.order = np.argsort(heaviest, kind="stable")
        place = np.empty(self.n_items, np.int64)
        place[self.order] = np.arange(self.n_items)
        item = place[items.item]
        self.weight, self.number = weight, items.number[self.order]
        self.single = _maxima(item, items.term, weight[items.term])
        self.starts = np.searchsorted(self.single[0], np.arange(self.n_items + 1))
        self.tree = _Tree(item // config.items_a_leaf, items.term, weight[items.term], 2)
        self.floor = floor[self.order]                      # scores that the k-th best has at least
        self.score = np.zeros((self.n_items, config.k), np.int64)
        self.doc = np.full((self.n_items, config.k), _LARGE)
        self.opened = self.scored = 0

    def _weakest(self, first: int, last: int) -> int:
        return int(np.maximum(self.score[first:last, -1], self.floor[first:last]).min())

    def _row(self, starts: np.ndarray, terms: np.ndarray, values: np.ndarray, node: int) -> np.ndarray:
        out = np.zeros(self.n_terms, np.int64)
        out[terms[starts[node]:starts[node + 1]]] = values[starts[node]:starts[node + 1]]
        return out

    def batch(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
        """Take in documents (their ids, and entries of document, term and value)."""
        if not len(ids) or not len(doc) or not self.n_items:
            return
        # documents with the same heaviest term stand together
        heaviest = np.zeros(len(ids), np.int64)
        order = np.argsort(value * self.weight[term], kind="stable")
        heaviest[doc[order]] = term[order]
        by = np.argsort(heaviest, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[by] = np.arange(len(ids))
        ids, doc = ids[by], place[doc]
        node, term, value = _maxima(doc, term, value)
        self.docs = (np.searchsorted(node, np.arange(len(ids) + 1)), term, value, ids)
        self.doc_tree = _Tree(node // self.config.docs_a_leaf, term, value, 4)
        top = len(self.doc_tree.levels) - 1
        self._open(len(self.tree.levels) - 1, 0, top, np.zeros(1, np.int64))

    def _open(self, level: int, node: int, doc_level: int, doc_nodes: np.ndarray) -> None:
        """Bound the node of items against nodes of documents, drop those under the weakest score, open the others."""
        starts, terms, values = self.tree.levels[level]
        weights = self._row(starts, terms, values, node)
        span = self.config.items_a_leaf * 2 ** level
        first, last = node * span, min((node + 1) * span, self.n_items)
        d_starts, d_terms, d_values = self.doc_tree.levels[doc_level]
        at, begin = _gather(d_starts, doc_nodes)
        bound = _sums(weights[d_terms[at]] * d_values[at], begin, d_starts[doc_nodes + 1] - d_starts[doc_nodes])
        doc_nodes = doc_nodes[bound >= max(self._weakest(first, last), 1)]
        self.opened += len(bound)
        if not len(doc_nodes):
            return
        if doc_level > 0:
            # children of the documents' nodes; the items' node is opened along with them
            count = len(self.doc_tree.levels[doc_level - 1][0]) - 1
            below = (doc_nodes[:, None] * self.doc_tree.fan + np.arange(self.doc_tree.fan)).ravel()
            doc_nodes, doc_level = below[below < count], doc_level - 1
        elif level == 0:
            self._exact(first, last, doc_nodes)
            return
        if level > 0:
            count = len(self.tree.levels[level - 1][0]) - 1
            for child in range(2 * node, min(2 * node + 2, count)):
                self._open(level - 1, child, doc_level, doc_nodes)
        else:
            self._open(0, node, doc_level, doc_nodes)

    def _exact(self, first: int, last: int, leaves: np.ndarray) -> None:
        size = self.config.docs_a_leaf
        starts, terms, values, ids = self.docs
        docs = (leaves[:, None] * size + np.arange(size)).ravel()
        docs = docs[docs < len(ids)]
        at, begin = _gather(starts, docs)
        sizes, t, v = starts[docs + 1] - starts[docs], terms[at], values[at]
        for k in range(first, last):
            weights = self._row(self.starts, self.single[1], self.single[2], k)
            score = _sums(weights[t] * v, begin, sizes)
            self.scored += len(docs)
            good = np.flatnonzero(score >= max(int(self.score[k, -1]), int(self.floor[k]), 1))
            if len(good):
                s, d = np.r_[self.score[k], score[good]], np.r_[self.doc[k], ids[docs[good]]]
                best = np.lexsort((d, -s))[:self.config.k]
                self.score[k], self.doc[k] = s[best], d[best]


_FOUND = "number long, doc_id long, score long"


def _parts(batch: pa.RecordBatch, config: RankedConfig) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(pc.binary_length(batch.column("terms")).to_numpy() // 4)
    start = 0
    while start < batch.num_rows:
        full = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + config.entries_a_batch, side="right"))
        end = min(batch.num_rows, start + config.docs_a_batch, max(start + 1, full))
        yield batch.slice(start, end - start)
        start = end


def _best(items: Items, weight: np.ndarray, floor: np.ndarray, n_docs: int, n_words: int, config: RankedConfig):
    schema = pa.schema([("number", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(items, weight, floor, config)
        for batch in batches:
            for part in _parts(batch, config):
                ids = part.column("doc_id").fill_null(_LARGE).to_numpy()
                held = part.column("terms").to_pylist()
                doc = np.repeat(np.arange(len(ids)), [len(t) // 4 for t in held])
                term = np.frombuffer(b"".join(held), np.uint32).astype(np.int64)
                tf = np.frombuffer(b"".join(part.column("tf").to_pylist()), np.uint32).astype(np.int64)
                m = np.array([100 - config.length_share + config.length_share * n * n_docs // n_words
                              for n in part.column("n").to_pylist()], np.int64)
                search.batch(ids, doc, term, 1_000_000_000 * tf // (1_000 * tf + config.saturation * m[doc]))
        k, place = np.nonzero(search.score > 0)
        yield pa.RecordBatch.from_arrays([pa.array(search.number[k]), pa.array(search.doc[k, place], pa.int64(), mask=search.doc[k, place] == _LARGE),
                                          pa.array(search.score[k, place])], schema=schema)

    return run


def rank_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text", config: RankedConfig = RankedConfig()) -> DataFrame:
    """item_id, rank, doc_id and score: the config.k documents with the highest score above 0 for every row of `items`.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased; null texts have none. A term that
    df of N documents (those with a term) hold weighs floor(1000 * ln((2N + 2) / (2df + 1))); a document of n terms, of L in
    all, has m = 100 - length_share + (length_share * n * N div L); its score sums weight * (10^9 tf div (1000 tf +
    saturation * m)) over the item's distinct terms. Equal scores come by ascending id, null ids last. Repeated rows are
    documents and items of their own. Items without terms, and empty tables on either side, give no rows. Ids of documents
    are whole numbers below 2^63 - 1."""
    rows = _rows(items, item_col, item_text_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for first, last in _item_blocks(rows, config):
        block = _block(source, _collect(rows, first, last), config)
        found = block if found is None else found.unionByName(block)
    if found is None:
        found = source.sparkSession.createDataFrame([], _FOUND)
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.k)
    return best.join(rows.select("number", "item_id"), "number").select(F.col("item_id").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")


def _block(source: DataFrame, items: Items, config: RankedConfig) -> DataFrame:
    """The best documents of a block of items, per task."""
    counted = materialise(source.mapInArrow(_counted(items.terms), _COUNTED))
    n_docs, n_words = counted.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(items.terms), np.int64)
    for r in (counted.select("terms").mapInArrow(_frequencies(len(items.terms)), "term long, df long")
              .groupBy("term").agg(F.sum("df").alias("df")).collect()):
        df[r["term"]] = r["df"]
    weight = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)
    floor = np.zeros(len(items.number), np.int64)
    n_words = max(n_words, 1)
    if n_docs >= config.first_look * config.k:
        look = counted.where(F.pmod(F.xxhash64("doc_id", "terms"), F.lit(config.first_look)) == 0)
        order = Window.partitionBy("number").orderBy(F.desc("score"))
        kth = (look.mapInArrow(_best(items, weight, floor, n_docs, n_words, config), _FOUND)
               .withColumn("place", F.row_number().over(order)).where(F.col("place") == config.k).select("number", "score").collect())
        place = {n: k for k, n in enumerate(items.number.tolist())}
        for r in kth:
            floor[place[r["number"]]] = r["score"]
    return counted.mapInArrow(_best(items, weight, floor, n_docs, n_words, config), _FOUND)
