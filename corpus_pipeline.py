"""Corpus pipeline: documents -> language ID -> SimHash near-dedup -> substring dedup -> decontamination -> BPE ids.

Each stage works on all that its predecessor kept, which is written as Parquet to the shared checkpoint folder and read
again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from churnforge.llm import bpe, decontam, langid, simhash, substrings
from churnforge.llm.textbatch import held_out
from churnforge.session import scratch_path

#: A text whose best language has less than this posterior is rejected.
MIN_LANGUAGE_SCORE = 0.5


def _free(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def _columns(df: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in df.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in one of the languages learned from `docs`; null and empty texts, those without letters and those in no
    language by majority go. Repeated rows stay or go alike."""
    model = langid.fit_language_model(docs, ~held_out("doc_id"))
    pred, score = _free(docs, "lang_pred"), _free(docs, "lang_score")
    plain = langid.LanguageIdConfig(evidence=None)      # a long text in one of several close languages has a majority
    return (langid.identify_language(docs, model, config=plain, pred_col=pred, score_col=score)
            .where((F.col(pred) != langid.UNKNOWN) & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(*_columns(docs)))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id; of repeated rows one stays. Null and empty
    texts are one group."""
    return simhash.simhash_keep(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that also stand elsewhere; texts without such passages, null ones included, stay as they are.
    Repeated rows are passages of each other and lose them alike. n_chars follows."""
    out = substrings.remove_repeats(docs, carry=True)
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text")),
           "n_chars": F.when(changed, F.length("kept_text").cast("long")).otherwise(
               F.col("carried.n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return out.select(*[(new[c] if c in new else F.col(f"carried.`{c}`")).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; null and empty texts stay, repeated rows stay or go alike."""
    found = decontam.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.where("n_hit > 0").select("doc_id", "body").distinct().alias("bad")
    same = (F.col("docs.doc_id").eqNullSafe(F.col("bad.doc_id"))
            & (F.xxhash64(F.coalesce(F.col("docs.text"), F.lit(""))) == F.col("bad.body")))
    return docs.alias("docs").join(bad, same, "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the text that the ids decode to, a row for each
    row; a null text decodes to the empty one."""
    return bpe.bpe_round_trip(docs).select("doc_id", "n_tokens", "ids", F.decode("decoded", "UTF-8").alias("text"))


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: No SQL for naive Bayes, XXH64 fingerprints and BPE: tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and reread. Intermediate tables go once they were used, all of them
    if a stage fails; the last one stays, as the result reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base, last = scratch_path(spark, f"corpus_pipeline-{uuid.uuid4().hex}"), None
    try:
        for k, (name, stage) in enumerate(STAGES):
            path = f"{base}/{k}_{name}"
            stage(spark, docs, sf_dir).write.parquet(path)
            if last:
                _delete(spark, last)
            docs, last = spark.read.parquet(path), path
    except BaseException:
        _delete(spark, base)
        raise
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
