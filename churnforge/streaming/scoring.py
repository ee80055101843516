"""Scoring a stream with state fitted in batch.

Every fitted transform here is stateless per row (literal / broadcast lookups, fitted Spark ML
pipelines), so the same apply functions work on a Structured Streaming DataFrame as a
stream-static projection or join. Nothing in the reference streams; this only re-uses the batch
operators on rows that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnforge.functions import clean
from churnforge.operators import encode


def stream_table(spark: SparkSession, path_glob: str, schema, max_files_per_trigger: int = 1) -> DataFrame:
    """A file stream over parquet files (schema declared, never inferred)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path_glob)


def score_stream(stream: DataFrame, te_map: DataFrame, te_cols, model=None, id_col: str = "id") -> DataFrame:
    """Fill categories (P6), apply a fitted target encoding (D7) and, when given, a fitted pipeline."""
    out = clean.clean_frame(stream, categorical=te_cols)
    out = encode.apply_target_encoding(out, te_map, te_cols)
    if model is not None:
        from pyspark.ml.functions import vector_to_array
        out = model.transform(out).withColumn("score", vector_to_array(F.col("probability"))[1])
    return out
