"""The corpus pipeline, stage by stage against plain versions, and as a whole."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as cp
from churnforge.llm import bpe
from tests.conftest import SF001
from tests.llm import brute


def rows_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").withColumn("score", F.lit(1)).withColumn("id", F.lit("x"))
    names = docs.columns
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(cp.STAGES):
        before = rows_of(docs)
        out = stage(spark, docs, SF001)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = rows_of(docs)
        if name == "language_id":
            assert set(after) <= set(before) and len(after) > 0.95 * len(before)
            assert all(any(map(str.isalpha, t)) for t in after.values())
        elif name == "simhash_dedup":
            ids = sorted(before)
            fps = [brute.fingerprint(before[i]) for i in ids]
            roots = brute.components(len(ids), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
            assert sorted(after) == sorted(set(brute.least_ids(ids, roots)))
        elif name == "substring_dedup":
            ids = sorted(before)
            for i, (w, c) in zip(ids, brute.repeats([before[i] for i in ids], 35), strict=True):
                assert after[i] == (" ".join(x for x, gone in zip(w, c, strict=True) if not gone) if any(c) else before[i])
        elif name == "decontaminate":
            assert sorted(after) == sorted(i for i, t in before.items() if not brute.contamination(t, bench, 10)[1])
        else:
            encoder, _ = bpe.codec("byte_bpe_50k.tiktoken")
            assert after == before
            for r in docs.collect():
                assert np.frombuffer(r["ids"], "<u4").tolist() == encoder.encode_ordinary(before[r["doc_id"]])
        if k < len(cp.STAGES) - 1:
            assert docs.columns == names


def test_run_and_an_empty_table(spark, tmp_path):
    out = cp.run(spark, SF001)
    assert out.count() > 100 and out.where("doc_id IS NULL").count() == 0
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF001}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_stages_take_nulls_and_repeats(spark):
    docs = spark.createDataFrame(
        [(1, "The cat sat on the mat and looked at the dog", "en", "s", 44), (1, "The cat sat on the mat and looked at the dog", "en", "s", 44),
         (2, None, None, None, None), (None, "Le chat est sur la table et regarde le chien", "fr", None, None), (3, "", "en", "s", 0),
         (4, "word " * 30_000, "en", "s", 150_000)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF001)
    assert docs.where("doc_id = 1").count() == 1
