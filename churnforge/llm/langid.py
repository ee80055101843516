"""Language identification: multinomial naive Bayes over hashed character n-grams.

Class counts of hashed n-grams are summed on the executors from a bounded, documented sample of the labelled texts;
the log-probability matrix (buckets x languages, fixed size) is broadcast and whole texts are scored in numpy batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from churnforge.llm.textbatch import bounded_share, mix64, slices, texts

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageIdConfig:
    orders: tuple[int, ...] = (1, 2, 3)     #: n-gram lengths in characters
    buckets: int = 1 << 15                  #: hash buckets, all lengths together
    smoothing: float = 0.5                  #: added to every count
    max_docs: int = 20_000                  #: about so many texts of each language are learned from
    languages_a_block: int = 200            #: columns of the matrix that are counted, broadcast and scored at a time
    evidence: int | None = 60               #: n-grams that a long text's score is scaled to; None: plain posterior
    seed: int = 17


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray                    #: buckets x languages, float32
    log_prior: np.ndarray


def _characters(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, a separator after each; offsets of the texts."""
    joined = "\x00".join(values).lower() + "\x00"
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    ends = np.flatnonzero(codes == 0)
    if len(ends) != len(values):            # a text holds the separator itself
        return _characters([v.replace("\x00", " ") for v in values])
    return codes, np.concatenate([[0], ends + 1])


def grams(values: list[str], config: LanguageIdConfig) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length: the bucket of the n-gram at every position, and the texts' first positions. Positions
    whose n-gram would run over the text's end take part with the separator, as an end mark."""
    codes, starts = _characters(values)
    wide = codes.astype(np.uint64) + np.uint64(1)
    rolled = np.zeros(len(wide), np.uint64)
    for n in range(1, max(config.orders) + 1):
        nth = np.zeros(len(wide), np.uint64)
        nth[:len(wide) - n + 1] = wide[n - 1:]
        rolled = rolled * np.uint64(0x100000001B3) + nth
        if n in config.orders:
            salt = np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            yield (mix64(rolled + salt) % np.uint64(config.buckets)).astype(np.int64), starts


def fit_language_model(df: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang",
                       id_col: str = "doc_id", config: LanguageIdConfig = LanguageIdConfig()) -> LanguageModel:
    """Learn from the rows where `learn` holds and text and language are not null; about `config.max_docs` rows of each
    language, chosen by a hash of the id. No such rows give a model without languages (every text is `und`)."""
    rows = df.where(learn & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = rows.groupBy("lang").count().orderBy("lang").collect()          # one row a language, as the model has columns
    if not sizes:
        return LanguageModel([], np.zeros((config.buckets, 0), np.float32), np.zeros(0))
    names = [r["lang"] for r in sizes]
    totals = np.array([r["count"] for r in sizes], float)
    log_prob = np.empty((config.buckets, len(names)), np.float32)
    for a in range(0, len(names), config.languages_a_block):
        z = min(a + config.languages_a_block, len(names))
        counts = _gram_counts(rows, names[a:z], totals[a:z], config) + config.smoothing
        log_prob[:, a:z] = np.log(counts / counts.sum(0))
    return LanguageModel(names, log_prob, np.log(totals / totals.sum()))


def _gram_counts(rows: DataFrame, names: list[str], totals: np.ndarray, config: LanguageIdConfig) -> np.ndarray:
    """buckets x languages: n-grams of the texts that a block of languages is learned from."""
    place = {name: k for k, name in enumerate(names)}
    share = F.lit(0.0)
    for name, total in zip(names, totals, strict=True):
        share = F.when(F.col("lang") == name, F.lit(min(1.0, config.max_docs / total))).otherwise(share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(config.buckets * len(names), np.int64)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                lang = np.array([place[x] for x in part.column("lang").to_pylist()], np.int64)
                for buckets, starts in grams(texts(part.column("text")), config):
                    of = np.repeat(lang, np.diff(starts))
                    sums += np.bincount(buckets * len(names) + of, minlength=len(sums))
        full = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(sums[full])], names=["cell", "n"])

    cells = (rows.where(bounded_share("id", share, config.seed)).mapInArrow(count, "cell long, n long")
             .groupBy("cell").agg(F.sum("n").alias("n")).toPandas())     # buckets x languages of a block at most
    counts = np.zeros(config.buckets * len(names))
    counts[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(float)
    return counts.reshape(config.buckets, len(names))


def score_texts(values: list[str], model: LanguageModel, config: LanguageIdConfig) -> tuple[np.ndarray, np.ndarray]:
    """(best language's index, its score) of each text. The best language is that of the sums over the whole text and
    the prior. The score is its posterior; over more than `evidence` n-grams, sums and prior are scaled down alike to that
    many, so that the score of a long text tells a mixed text from a pure one instead of always being 1."""
    best, _, odds = _odds(values, model, config)
    return best, 1 / odds


def _odds(values: list[str], model: LanguageModel, config: LanguageIdConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best language's index, its logarithm, sum over the languages relative to it) of each text."""
    total = np.zeros((len(values), len(model.languages)))
    seen = np.zeros(len(values))
    for buckets, starts in grams(values, config):
        total += np.add.reduceat(model.log_prob[buckets], starts[:-1], axis=0, dtype=np.float64)
        seen += np.diff(starts)
    total += model.log_prior
    best = total.argmax(1)
    if config.evidence is not None:
        total *= np.minimum(1.0, config.evidence / seen)[:, None]
    top = total[np.arange(len(values)), best]
    return best, top, np.exp(total - top[:, None]).sum(1)


def identify_language(df: DataFrame, model: LanguageModel, text_col: str = "text",
                      config: LanguageIdConfig = LanguageIdConfig(), pred_col: str = "lang_pred",
                      score_col: str = "score") -> DataFrame:
    """All columns of df, then the predicted language and its score (columns of those names in df are replaced).

    The prediction is a learned language, or `und` with score 0 if the text is null or empty, has no letters, or nothing
    was learned; an empty table gives an empty result. Only the text decides. Rows keep their partitions; repeated rows
    get equal answers. Any number of languages: they are scored in blocks, the best one and the sum carried along."""
    source = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in (pred_col, score_col)])
    state = "_lid"
    while state in (*source.columns, pred_col, score_col):
        state = f"_{state}"
    step, held = max(1, config.languages_a_block), T.StructField(state, T.StructType([
        T.StructField("best", T.LongType()), T.StructField("top", T.DoubleType()), T.StructField("sum", T.DoubleType())]))
    starts = list(range(0, len(model.languages), step)) or [0]
    out = source
    for a in starts:
        block = LanguageModel(model.languages[a:a + step], np.ascontiguousarray(model.log_prob[:, a:a + step]), model.log_prior[a:a + step])
        shared = df.sparkSession.sparkContext.broadcast(block)              # buckets x languages of a block
        last = a == starts[-1]
        added = [T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())] if last else [held]
        run = _score_block(shared, a, a == 0, model.languages if last else None, text_col, state, (pred_col, score_col), config)
        out = out.mapInArrow(run, T.StructType([*source.schema.fields, *added]))
    return out


def _score_block(shared, first: int, start: bool, languages: list[str] | None, text_col: str, state: str, names: tuple[str, str],
                 config: LanguageIdConfig):
    """Score a block of languages whose first is number `first`; `languages` names all of them in the last step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20):
                values, n = texts(part.column(text_col)), part.num_rows
                best, top, total = (_odds(values, known, config) if known.languages
                                    else (np.zeros(n, np.int64), np.zeros(n), np.ones(n)))
                best = best + first
                if not start:
                    b, t, s = (x.to_numpy(zero_copy_only=False) for x in part.column(state).flatten())
                    highest = np.maximum(t, top)
                    best = np.where(top > t, best, b)
                    total = s * np.exp(t - highest) + total * np.exp(top - highest)
                    top = highest
                plain = [c for name, c in zip(part.schema.names, part.columns, strict=True) if name != state]
                kept = [name for name in part.schema.names if name != state]
                if languages is None:
                    now = pa.StructArray.from_arrays([pa.array(best, pa.int64()), pa.array(top), pa.array(total)], names=["best", "top", "sum"])
                    yield pa.RecordBatch.from_arrays([*plain, now], names=[*kept, state])
                    continue
                letters = np.array([bool(languages) and any(map(str.isalpha, v)) for v in values], bool)
                pred = [languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
                yield pa.RecordBatch.from_arrays([*plain, pa.array(pred, pa.string()), pa.array(np.where(letters, 1 / total, 0.0), pa.float64())],
                                                 names=[*kept, *names])

    return run
