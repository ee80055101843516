"""Quality classifier: supervised subword embeddings.

A text is the average of learned vectors of its hashed features (words, word pairs, character n-grams inside words with
their edges); a softmax layer turns the average into class probabilities. Vectors and layer are trained in numpy by
stochastic gradient descent on a bounded, documented sample of the labelled texts. As the layer is linear, a feature's
share of the logit is a number of its own, and whole texts are scored by averaging those.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from churnforge.llm.textbatch import bounded_share, mix64, slices, utf8
from churnforge.llm.wordcodes import SPACE, word_bounds, word_codes


@dataclass(frozen=True)
class QualityConfig:
    buckets: int = 1 << 17          #: hash buckets of all features (a power of two)
    orders: tuple[int, ...] = (3, 4)    #: lengths of character n-grams, in bytes
    dim: int = 16
    epochs: int = 8
    rate: float = 1.0
    max_docs: int = 3_000           #: about so many labelled texts are learned from
    seed: int = 29


@dataclass(frozen=True)
class QualityModel:
    share: np.ndarray               #: each bucket's share of the logit, float32
    bias: float


def features(data: np.ndarray, offsets: np.ndarray, config: QualityConfig) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, text of each) of every kind of feature. Words are separated by ASCII white space, case is kept; a word
    that repeats the one before it is one feature whatever the word."""

    def bucket(x: np.ndarray, kind: int) -> np.ndarray:
        salt = np.uint64(kind * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        return (mix64(x + salt) & np.uint64(config.buckets - 1)).astype(np.int64)

    starts, ends, words = word_bounds(data, offsets)
    codes = word_codes(data, starts, ends)
    of_word = np.repeat(np.arange(len(words) - 1), np.diff(words))
    yield bucket(codes, 1), of_word
    pair = of_word[1:] == of_word[:-1]
    both = np.where(codes[1:] == codes[:-1], np.uint64(0), codes[:-1] * np.uint64(3) + codes[1:])
    yield bucket(both[pair], 2), of_word[1:][pair]
    of_byte = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    wide, space = data.astype(np.uint64), SPACE[data]
    for n in config.orders:
        size = max(0, len(data) - n + 1)
        gram = np.zeros(size, np.uint64)
        inner = np.zeros(size, bool)
        for k in range(n):
            gram |= wide[k:k + size] << np.uint64(8 * k)
            if 0 < k < n - 1:
                inner |= space[k:k + size]
        good = ~inner & (of_byte[:size] == of_byte[n - 1:])
        yield bucket(gram[good], 2 + n), of_byte[:size][good]


def _sparse(config: QualityConfig):
    """Rows (id, label, text) -> rows (id, label, buckets, weights): each text's average as a sparse vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                kinds = list(features(*utf8(part.column("text")), config))
                cell, n = np.unique(np.concatenate([of * config.buckets + b for b, of in kinds]), return_counts=True)
                row = cell // config.buckets
                sums = np.bincount(row, n, part.num_rows)
                ends = np.cumsum(np.bincount(row, minlength=part.num_rows))
                at = pa.array(np.concatenate([[0], ends]), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), part.column("label"),
                    pa.ListArray.from_arrays(at, pa.array(cell % config.buckets, pa.int32())),
                    pa.ListArray.from_arrays(at, pa.array((n / sums[row]).astype(np.float32)))],
                    names=["id", "label", "buckets", "weights"])

    return run


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, config: QualityConfig) -> QualityModel:
    """Stochastic gradient descent, one text at a time, with a linearly falling rate."""
    rng = np.random.default_rng(config.seed)
    vectors = rng.uniform(-1 / config.dim, 1 / config.dim, (config.buckets, config.dim)).astype(np.float32)
    layer, bias = np.zeros((config.dim, 2), np.float32), np.zeros(2, np.float32)
    steps, done = config.epochs * len(rows), 0
    for _ in range(config.epochs):
        for k in rng.permutation(len(rows)):
            at, weight = rows[k]
            mean = weight @ vectors[at]
            logits = mean @ layer + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[labels[k]] -= 1
            step = np.float32(config.rate * (1 - done / steps))
            back = layer @ error
            layer -= step * np.outer(mean, error)
            bias -= step * error
            vectors[at] -= step * weight[:, None] * back
            done += 1
    return QualityModel(vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]))


def fit_quality_model(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
                      label_col: str = "quality", config: QualityConfig = QualityConfig()) -> QualityModel:
    """Learn `label_col` (0 or 1, other values are passed over) from rows of `labels` where `learn` holds; about
    `config.max_docs` of them, chosen by a hash of the id. Without labels every text scores 0.5. Of an id with several
    labels the largest counts, of an id with several texts the smallest (null first), however the rows are dealt."""
    known = (labels.where(learn & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
             .select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")))
    share = min(1.0, config.max_docs / max(1, known.count()))
    some = known.where(bounded_share("id", F.lit(share), config.seed)).groupBy("id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    one = (texts.join(F.broadcast(some), "id").groupBy("id", "label")               # about max_docs rows
           .agg(F.min(F.struct("text")).alias("t")).select("id", "label", "t.text"))
    rows = (one.mapInArrow(_sparse(config), f"id {kind}, label int, buckets array<int>, weights array<float>").orderBy("id").select("label", "buckets", "weights").toArrow())
    if not rows.num_rows:
        return QualityModel(np.zeros(config.buckets, np.float32), 0.0)
    cells = [(b.values.to_numpy(), w.values.to_numpy()) for b, w in zip(rows.column("buckets"), rows.column("weights"), strict=True)]
    return train(cells, rows.column("label").to_numpy(), config)


def score_quality(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text",
                  config: QualityConfig = QualityConfig()) -> DataFrame:
    """id and score (probability of label 1) per row of df; a null or empty text scores by the bias alone. Rows keep
    their partitions; repeated rows get equal scores; an empty table gives an empty result."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)          # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20):
                total, seen = np.zeros(part.num_rows), np.zeros(part.num_rows)
                for buckets, of in features(*utf8(part.column(text_col)), config):
                    total += np.bincount(of, known.share[buckets], part.num_rows)
                    seen += np.bincount(of, minlength=part.num_rows)
                logit = total / np.maximum(seen, 1) + known.bias
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(1 / (1 + np.exp(-logit)))], names=[id_col, "score"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")
