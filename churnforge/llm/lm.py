"""LM scoring by masked pseudo-likelihood.

Every word of a text is predicted from the words on both sides by a small window network: vectors of the neighbours, one
hidden layer, a softmax over word classes; a word's probability is its class's times its share of the class in the
corpus. A document's score is the sum of these conditional log-probabilities.

The vocabulary comes from the counts of all words of all texts. Words beyond it share ids in the network, but not in the
score: their counts stay a Spark table, which grows with the corpus and is joined to the texts' blocks. The network is trained in numpy where the data is: in each
round every partition takes the shared weights through all its texts, a share of whose words is masked, and the new
weights are averaged: a word's vector by the number of masked windows that it stood in, the others by the number of masked
words. All rounds together mask every word. Only sums of weights reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from churnforge.llm.textbatch import materialise, mix64, slices, utf8
from churnforge.llm.wordcodes import word_bounds, word_codes


@dataclass(frozen=True)
class LMConfig:
    vocabulary: int = 2_048         #: words with an id of their own, the most frequent ones
    rest: int = 32                  #: ids that other words are hashed to; each is a class
    classes: int = 96               #: classes of the vocabulary's words, of about equal mass
    window: int = 2                 #: neighbours on either side
    dim: int = 16
    hidden: int = 32
    mask_every: int = 8             #: in a turn, one word in so many is predicted; so many turns at least
    rounds: int = 2                 #: times that weights are averaged; the turns are dealt out to them
    batch: int = 512
    rate: float = 0.01
    seed: int = 5


@dataclass(frozen=True)
class Vocabulary:
    codes: np.ndarray               #: sorted word codes
    class_of: np.ndarray            #: of each id
    log_share: np.ndarray           #: of each id in its class
    rest: int

    def ids(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return (mix64(codes) % np.uint64(self.rest)).astype(np.int64)
        # codes are hashes, so few share their highest bits: quicker than a binary search of each
        of = np.bincount((self.codes >> np.uint64(48)).astype(np.int64), minlength=1 << 16)
        at = (np.cumsum(of) - of).take((codes >> np.uint64(48)).astype(np.int64))
        last = np.append(self.codes, ~np.uint64(0))
        for _ in range(of.max()):
            at += last.take(at) < codes
        other = np.flatnonzero(self.codes.take(np.minimum(at, len(self.codes) - 1)) != codes)
        at[other] = len(self.codes) + (mix64(codes[other]) % np.uint64(self.rest)).astype(np.int64)
        return at

    @property
    def size(self) -> int:
        return len(self.class_of)


@dataclass(frozen=True)
class LanguageScorer:
    vocabulary: Vocabulary
    weights: np.ndarray             #: all weights in a row


@dataclass(frozen=True)
class RestWords:
    """Shares of the words beyond the vocabulary in their rest ids (Witten-Bell: as much mass as there are different words
    is left for unseen ones, in equal parts for all codes that a rest id may still get)."""
    counts: DataFrame               #: (code, n) of all words
    log_mass: np.ndarray            #: of each rest id: log of its words' number and the mass for unseen words
    log_unseen: np.ndarray          #: of each rest id: log share of one unseen word


#: Words beyond the vocabulary whose shares are asked for together (one text at least).
BLOCK_WORDS = 2_000_000


def count_words(df: DataFrame, text_col: str) -> DataFrame:
    """(code, n): how often each word stands in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for part in slices(batch, "text"):
                data, offsets = utf8(part.column("text"))
                starts, ends, _ = word_bounds(data, offsets)
                parts.append(np.unique(word_codes(data, starts, ends), return_counts=True))
            if parts:
                code, back = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                n = np.bincount(back, np.concatenate([k for _, k in parts]), len(code)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n)], names=["code", "n"])

    return (df.select(F.col(text_col).alias("text")).mapInArrow(run, "code long, n long")
            .groupBy("code").agg(F.sum("n").alias("n")))


def fit_vocabulary(df: DataFrame, text_col: str, config: LMConfig, counts: DataFrame | None = None) -> Vocabulary:
    """The most frequent words, in classes of about equal mass by falling frequency. counts: of count_words, if they are
    there already."""
    counts = materialise(count_words(df, text_col)) if counts is None else counts
    # words by the size of their count, eight steps a doubling (512 rows at most): only those in question are ordered,
    # so that the partitions do not each send a whole vocabulary to the driver
    level = F.floor(F.log2("n") * 8).cast("int")
    cut, held = 0, 0
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        cut, held = row["level"], held + row["count"]
        if held >= config.vocabulary:
            break
    top = counts.where(level >= cut).orderBy(F.desc("n"), "code").limit(config.vocabulary).collect()
    n = np.array([r["n"] for r in top], float)
    codes = np.array([r["code"] for r in top], np.int64).view(np.uint64)
    mass = np.cumsum(n) - n
    classes = np.minimum((mass / max(1.0, n.sum()) * config.classes).astype(np.int64), config.classes - 1)
    share = np.log(n / np.bincount(classes, n, config.classes)[classes]) if len(n) else n
    order = np.argsort(codes)
    return Vocabulary(codes[order], np.concatenate([classes[order], config.classes + np.arange(config.rest)]),
                      np.concatenate([share[order], np.zeros(config.rest)]), config.rest)


def rest_words(counts: DataFrame, vocabulary: Vocabulary) -> RestWords:
    """Shares of all counted words beyond the vocabulary."""
    rest = vocabulary.rest
    shared = counts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, words, kinds = len(shared.value.codes), np.zeros(rest, np.int64), np.zeros(rest, np.int64)
        for batch in batches:
            ids = shared.value.ids(batch.column(0).to_numpy().view(np.uint64)) - first
            own = ids >= 0
            n = batch.column(1).to_numpy()[own]
            words += np.bincount(ids[own], n, rest).astype(np.int64)
            kinds += np.bincount(ids[own], minlength=rest)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rest)), pa.array(words), pa.array(kinds)],
                                         names=["id", "words", "kinds"])

    sums = (counts.select("code", "n").mapInArrow(run, "id long, words long, kinds long")
            .groupBy("id").agg(F.sum("words").alias("words"), F.sum("kinds").alias("kinds")).collect())
    words, kinds = np.zeros(rest), np.zeros(rest)
    for row in sums:
        words[row["id"]], kinds[row["id"]] = row["words"], row["kinds"]
    known = np.bincount((mix64(vocabulary.codes) % np.uint64(rest)).astype(np.int64), minlength=rest)
    codes = np.array([((1 << 64) - k + rest - 1) // rest for k in range(rest)], float)     # that are hashed to each id
    unseen = np.maximum(kinds, 1)
    log_mass = np.log(words + unseen)
    return RestWords(counts, log_mass, np.log(unseen) - log_mass - np.log(codes - kinds - known))


class Network:
    """The window network over one row of weights; the id after the last stands beyond a text's ends."""

    def __init__(self, weights: np.ndarray, size: int, config: LMConfig):
        self.config, self.weights = config, weights
        self.parts, at = [], 0
        for shape in self.shapes(size, config):
            n = int(np.prod(shape))
            self.parts.append(weights[at:at + n].reshape(shape))
            at += n

    @staticmethod
    def shapes(size: int, c: LMConfig) -> list[tuple[int, ...]]:
        outputs = c.classes + c.rest
        return [(size + 1, c.dim), (2 * c.window * c.dim, c.hidden), (c.hidden,), (c.hidden, outputs), (outputs,)]

    @classmethod
    def start(cls, size: int, config: LMConfig) -> np.ndarray:
        rng = np.random.default_rng(config.seed)
        return np.concatenate([
            (rng.standard_normal(shape) / np.sqrt(shape[0] if k else config.dim)).ravel() if len(shape) > 1 else np.zeros(shape)
            for k, shape in enumerate(cls.shapes(size, config))]).astype(np.float32)

    def outputs(self, around: np.ndarray) -> tuple[np.ndarray, ...]:
        """(input, hidden layer, outputs less their largest) for rows of neighbour ids."""
        vectors, inner, inner_bias, outer, outer_bias = self.parts
        x = vectors.take(around.ravel(), 0).reshape(len(around), -1)
        h = x @ inner
        h += inner_bias
        np.tanh(h, out=h)
        out = h @ outer
        out += outer_bias
        out -= out.max(1, keepdims=True)
        return x, h, out

    def log_probs(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(input, hidden layer, log-probabilities of the classes) for rows of neighbour ids."""
        x, h, out = self.outputs(around)
        out -= np.log(_raised(out.copy()))
        return x, h, out

    def log_prob_of(self, around: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Log-probability of one class a row."""
        out = self.outputs(around)[2]
        own = out[np.arange(len(classes)), classes]
        return own - np.log(_raised(out)[:, 0])

    def step(self, around: np.ndarray, classes: np.ndarray, rate: float, squares: list[np.ndarray]) -> None:
        """One step of gradient descent with rates that fall by each weight's past gradients (Adagrad)."""
        vectors, inner, _, outer, _ = self.parts
        x, h, error = self.outputs(around)
        error /= _raised(error)
        error[np.arange(len(classes)), classes] -= 1
        error /= len(classes)
        below = (error @ outer.T) * (1 - h * h)
        into = (below @ inner.T).reshape(-1, vectors.shape[1])
        flat = around.ravel()
        order = np.argsort(flat, kind="stable")
        held = flat.take(order)
        last = np.append(np.flatnonzero(held[1:] != held[:-1]), len(held) - 1)
        ids = held.take(last).astype(np.intp)
        # sums of each id's rows; made wide before they are added up, which is quicker than cumsum's own conversion and reduceat
        sums = _running(into.take(order, 0).astype(np.float64)).take(last, 0)
        sums[1:] -= sums[:-1].copy()
        lookup = sums.astype(into.dtype)
        square = squares[0].take(ids, 0)
        square += lookup * lookup
        squares[0][ids] = square
        lookup *= rate
        square += 1e-8
        lookup /= np.sqrt(square, out=square)
        vectors[ids] = vectors.take(ids, 0) - lookup
        each = np.ones(len(classes), error.dtype)                # sums of columns as products: quicker than sum(0)
        for k, grad in ((1, x.T @ below), (2, each @ below), (3, h.T @ error), (4, each @ error)):
            squares[k] += grad * grad
            self.parts[k] -= rate * grad / np.sqrt(squares[k] + 1e-8)


def _running(rows: np.ndarray) -> np.ndarray:
    """Running sums down the columns; two columns are added at a time, as the parts of complex numbers."""
    if rows.shape[1] % 2:
        return np.cumsum(rows, 0)
    return np.cumsum(rows.view(np.complex128), 0).view(np.float64)


def _raised(out: np.ndarray) -> np.ndarray:
    """Sums of the rows' exponentials, as a column; out becomes these."""
    return np.exp(out, out=out) @ np.ones((out.shape[1], 1), out.dtype)


def _kind(vocabulary: Vocabulary) -> type:
    """Type of a stored id; the id after the last is the padding."""
    return np.uint16 if vocabulary.size < 1 << 16 else np.uint32


def _padded(ids: pa.Array, vocabulary: Vocabulary, config: LMConfig) -> tuple[np.ndarray, ...]:
    """(ids of all words, padded; place of each word in them; texts' offsets in words)."""
    raw = np.frombuffer(b"".join(ids.to_pylist()), _kind(vocabulary))
    words = np.concatenate([[0], np.cumsum(pc.binary_length(ids).to_numpy() // _kind(vocabulary)().itemsize)]).astype(np.int64)
    of = np.repeat(np.arange(len(words) - 1), np.diff(words))
    at = np.arange(len(raw)) + config.window * (of + 1)
    padded = np.full(len(raw) + config.window * len(words), vocabulary.size, _kind(vocabulary))
    padded[at] = raw
    return padded, at, words


def _runs(batch: pa.RecordBatch, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of texts of about `limit` bytes of ids (one text at least)."""
    ends = np.cumsum(pc.binary_length(batch.column("ids")).to_numpy())
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, side="right"))
        end = min(batch.num_rows, max(start + 1, end))
        yield batch.slice(start, end - start)
        start = end


def _around(padded: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    return padded.take(at[:, None] + np.array([k for k in range(-window, window + 1) if k]))


def turns_of(turn: int, config: LMConfig) -> list[int]:
    """Turns of a round: each of the first mask_every turns masks other words, and together they mask every word."""
    return list(range(max(config.rounds, config.mask_every)))[turn::config.rounds]


def _train(df: DataFrame, text_col: str, model: LanguageScorer, turn: int, config: LMConfig) -> np.ndarray:
    """A round over texts: see _round."""
    return _round(code_texts(df.withColumn("_lm_id", F.lit(0)), model.vocabulary, "_lm_id", text_col), model, turn, config)


def _round(coded: DataFrame, model: LanguageScorer, turn: int, config: LMConfig) -> np.ndarray:
    """Weights after a round: every partition's own, averaged by what moved them; those that nothing moved stay."""
    shared = coded.sparkSession.sparkContext.broadcast(model)      # vocabulary and weights, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights, n = shared.value.vocabulary, shared.value.weights.copy(), 0
        net = Network(weights, vocabulary.size, config)
        squares = [np.zeros_like(p) for p in net.parts]
        touched = np.zeros(vocabulary.size + 1, np.int64)
        for batch in batches:
            for part in _runs(batch):
                padded, at, _ = _padded(part.column("ids"), vocabulary, config)
                for now in turns_of(turn, config):
                    masked = at[(at + now) % config.mask_every == 0]
                    masked = np.random.default_rng(config.seed + now).permutation(masked)
                    for some in np.split(masked, range(config.batch << 6, len(masked), config.batch << 6)):
                        around, classes = _around(padded, some, config.window), vocabulary.class_of[padded[some]]
                        touched += np.bincount(around.ravel(), minlength=len(touched))
                        for k in range(0, len(some), config.batch):
                            net.step(around[k:k + config.batch], classes[k:k + config.batch], config.rate, squares)
                    n += len(masked)
        if n:
            by = np.full(len(weights), n, np.int64)
            by[:net.parts[0].size] = np.repeat(touched, config.dim)
            moved = np.flatnonzero(by)
            yield pa.RecordBatch.from_arrays([
                pa.array(moved.astype(np.int32)), pa.array(weights[moved].astype(np.float64) * by[moved]),
                pa.array(by[moved])], names=["at", "w", "n"])

    sums = (coded.where("ids IS NOT NULL").select("ids").mapInArrow(run, "at int, w double, n long")
            .groupBy("at").agg((F.sum("w") / F.sum("n")).alias("w")).toPandas())      # one row a weight
    out = model.weights.copy()
    out[sums["at"].to_numpy(np.int64)] = sums["w"].to_numpy(np.float32)
    return out


def fit_language_scorer(df: DataFrame, text_col: str = "text", config: LMConfig = LMConfig(),
                        counts: DataFrame | None = None, vocabulary: Vocabulary | None = None,
                        coded: DataFrame | None = None) -> LanguageScorer:
    """Vocabulary and network from all texts of df (null: empty); texts without words and an empty table leave the
    starting weights. counts, vocabulary, coded: of count_words, fit_vocabulary and code_texts, if they are there."""
    if vocabulary is None:
        vocabulary = fit_vocabulary(df, text_col, config, counts)
    if coded is None:
        coded = materialise(code_texts(df.withColumn("_lm_id", F.lit(0)), vocabulary, "_lm_id", text_col))
    weights = Network.start(vocabulary.size, config)
    unused = np.setdiff1d(np.arange(config.classes + config.rest), vocabulary.class_of)
    Network(weights, vocabulary.size, config).parts[4][unused] = -1e4       # classes without words get no probability
    model = LanguageScorer(vocabulary, weights)
    for turn in range(config.rounds):
        model = LanguageScorer(vocabulary, _round(coded, model, turn, config))
    return model


def _block(kept: list[tuple], number: int) -> Iterator[pa.RecordBatch]:
    """The rows of a block's texts: their ids, and the places of their rest words among the block's; and a row with the
    codes of these."""
    codes, place = np.unique(np.concatenate([k[3] for k in kept]), return_inverse=True)
    at, block = 0, (TaskContext.get().partitionId() << 32) + number
    names = ["block", "id", "ids", "places", "codes"]
    for ids, held, per, own in kept:
        raw = place[at:at + len(own)].astype(np.uint32).tobytes()
        ends = np.concatenate([[0], np.cumsum(per)]) * 4
        places = pa.array([raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
        at += len(own)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), block)), ids, held, places, pa.nulls(len(held), pa.binary())],
                                         names=names)
    yield pa.RecordBatch.from_arrays([
        pa.array([block], pa.int64()), pa.nulls(1, kept[0][0].type), pa.nulls(1, pa.binary()),
        pa.nulls(1, pa.binary()), pa.array([codes.tobytes()], pa.binary())], names=names)


def code_texts(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as word ids, so that training and scoring need not cut them again: rows (block, id, ids, places) of the texts,
    in blocks, and a row (block, codes) for each block with the codes of its words beyond the vocabulary, once each;
    places are a text's rest words among these. Null texts have no words; an empty table gives no rows."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kept, held, number = shared.value, [], 0, 0
        first, width = len(known.codes), _kind(known)().itemsize
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, offsets = utf8(part.column("text"))
                starts, ends, words = word_bounds(data, offsets)
                codes = word_codes(data, starts, ends)
                ids = known.ids(codes)
                other = np.flatnonzero(ids >= first)
                raw, cut = ids.astype(_kind(known)).tobytes(), (words * width).tolist()
                kept.append((part.column("id"), pa.array([raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                             np.diff(np.searchsorted(other, words)), codes[other]))
                held += len(other)
                if held >= BLOCK_WORDS:
                    yield from _block(kept, number)
                    kept, held, number = [], 0, number + 1
        if kept:
            yield from _block(kept, number)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"block long, id {kind}, ids binary, places binary, codes binary")


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, place, code) of every block's different rest words."""
    for batch in batches:
        for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            codes = np.frombuffer(raw, np.int64)
            for k in range(0, len(codes), 1 << 16):
                part = codes[k:k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(part), block)), pa.array(np.arange(k, k + len(part), dtype=np.int32)),
                    pa.array(part)], names=["block", "place", "code"])


def _with_rest(texts: DataFrame, coded: DataFrame, rest: RestWords, vocabulary: Vocabulary, kind: str) -> DataFrame:
    """(id, n_tokens, log_prob) of the blocks' texts, log_prob with the log shares of their rest words."""
    asked = (coded.where("codes IS NOT NULL").select("block", "codes")
             .mapInArrow(_asked, "block long, place int, code long"))
    size = vocabulary.rest
    log_mass, log_unseen = rest.log_mass, rest.log_unseen

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (mix64(batch.column(2).to_numpy().view(np.uint64)) % np.uint64(size)).astype(np.int64)
            n = batch.column(3).fill_null(0).to_numpy()
            share = np.where(n > 0, np.log(np.maximum(n, 1)) - log_mass[at], log_unseen[at])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share)],
                                             names=["block", "place", "share"])

    # a word is asked for once a block, so that frequent words make no hot keys
    shares = (asked.join(rest.counts, "code", "left").select("block", "place", "code", "n")
              .mapInArrow(found, "block long, place int, share double"))

    def add(texts: pa.Table, answers: pa.Table) -> pa.Table:
        share = np.zeros(answers.num_rows)
        share[answers.column("place").to_numpy()] = answers.column("share").to_numpy()
        texts = texts.combine_chunks()
        sums = np.array([share[np.frombuffer(raw.as_py(), np.uint32)].sum() for raw in texts.column("places")])
        n, total = texts.column("n_tokens"), texts.column("log_prob").to_numpy() + sums
        return pa.table({"id": texts.column("id"), "n_tokens": n, "log_prob": pa.array(total, pa.float64())})

    return texts.groupBy("block").cogroup(shares.groupBy("block")).applyInArrow(
        add, f"id {kind}, n_tokens long, log_prob double")


def score_documents(df: DataFrame, model: LanguageScorer, id_col: str = "doc_id", text_col: str = "text",
                    config: LMConfig = LMConfig(), rest: RestWords | None = None, coded: DataFrame | None = None) -> DataFrame:
    """id, n_tokens, log_prob (sum of the words' conditional log-probabilities, natural logarithm) and mean_log_prob per
    row of df; null and empty texts and texts without words have 0 tokens, log_prob 0 and no mean. Repeated rows get equal
    scores; an empty table gives an empty result. With `rest` every word is scored as itself; without it, words beyond
    the vocabulary are scored as their rest ids. coded: of code_texts, if it is there."""
    kind = df.schema[id_col].dataType.simpleString()
    if coded is None:
        coded = code_texts(df, model.vocabulary, id_col, text_col)
        coded = materialise(coded) if rest is not None else coded
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value.vocabulary
        net = Network(shared.value.weights, vocabulary.size, config)
        for batch in batches:
            for part in _runs(batch):
                padded, at, words = _padded(part.column("ids"), vocabulary, config)
                scores = np.empty(len(at))
                for k in range(0, len(at), 1024):
                    some = at[k:k + 1024]
                    ids = padded[some]
                    scores[k:k + 1024] = (net.log_prob_of(_around(padded, some, config.window), vocabulary.class_of[ids])
                                          + vocabulary.log_share[ids])
                n = np.diff(words)
                sums = np.where(n > 0, np.add.reduceat(np.append(scores, 0.0), words[:-1]), 0.0) if len(n) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([part.column("block"), part.column("id"), pa.array(n, pa.int64()), pa.array(sums),
                                                  part.column("places")], names=["block", "id", "n_tokens", "log_prob", "places"])

    texts = coded.where("ids IS NOT NULL").select("block", "id", "ids", "places").mapInArrow(
        run, f"block long, id {kind}, n_tokens long, log_prob double, places binary")
    out = _with_rest(texts, coded, rest, model.vocabulary, kind) if rest is not None else texts.select("id", "n_tokens", "log_prob")
    return out.select(F.col("id").alias(id_col), "n_tokens", "log_prob",
                      F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))
