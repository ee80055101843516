"""Scans and sinks.

Every reader takes an explicit schema or reads parquet (self-describing);
schemas are never inferred from CSV text.
"""

from __future__ import annotations

import functools
import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREDICTION_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("score", T.DoubleType(), True),
])


def read_table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    """S1 (parquet form): one driver table; selecting columns prunes the scan."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType, header: bool = True, verbatim: bool = False) -> DataFrame:
    """CSV with a declared schema. Dirty numeric text should be declared string and cleaned.
    ``verbatim`` leaves text as it stands: blanks around it stay, and an empty field is the empty text."""
    reader = spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE")
    if verbatim:
        reader = reader.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False) \
            .option("nullValue", "\u0000").option("emptyValue", "")
    return reader.csv(path)


def read_predictions(spark: SparkSession, path: str, fmt: str = "parquet",
                     id_col: str = "id", score_col: str = "score") -> DataFrame:
    """An earlier prediction table as (id long, score double)."""
    if fmt == "csv":
        raw = spark.read.option("header", True).schema(
            T.StructType([T.StructField(id_col, T.LongType()), T.StructField(score_col, T.DoubleType())])).csv(path)
    else:
        raw = spark.read.parquet(path)
    return raw.select(F.col(id_col).cast("long").alias("id"), F.col(score_col).cast("double").alias("score"))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def delete_path(spark: SparkSession, path: str) -> None:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def existing_sources(spark: SparkSession, paths) -> list[str]:
    """Keep optional sources that exist; the caller logs the skipped ones."""
    return [p for p in paths if _exists(spark, p)]


def union_sources(frames) -> DataFrame | None:
    frames = list(frames)
    if not frames:
        return None
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def require_sources(spark: SparkSession, paths) -> None:
    """Stop when a required source is missing."""
    missing = [p for p in paths if not _exists(spark, p)]
    if missing:
        raise FileNotFoundError(f"required sources missing: {missing}")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None, mode: str = "overwrite") -> None:
    """Write a result table (parquet default, CSV with header on request)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_partitions(df: DataFrame, path: str, partition_by) -> None:
    """S8 by parts: the partitions that ``df`` has rows for are replaced, all others of the table stay (dynamic
    partition overwrite). Rows are dealt by the partition columns and a share of their own, so that a partition
    is written by several tasks, each with one file, however uneven the partitions are."""
    df.hint("rebalance", *partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(*partition_by).parquet(path)


def read_partitions(spark: SparkSession, path: str, **values) -> DataFrame:
    """Rows of some partitions (column = value, or a list of values); only their folders are read."""
    df = spark.read.parquet(path)
    for column, wanted in values.items():
        df = df.filter(F.col(column).isin(*wanted) if isinstance(wanted, (list, tuple, set)) else F.col(column) == wanted)
    return df


def write_predictions(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    write_table(df.select(F.col("id").cast("long"), F.col("score").cast("double")), path, fmt)


def append_run_metrics(spark: SparkSession, path: str, run_id: str, metrics: dict) -> DataFrame:
    """The run report as rows (run_id, key, value, written_at) appended to a table. Returns this
    run's rows as the table now holds them."""
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    rows = [(run_id, str(k), str(v), now) for k, v in metrics.items()]
    spark.createDataFrame(rows, "run_id string, key string, value string, written_at timestamp") \
        .write.mode("append").parquet(path)
    return spark.read.parquet(path).filter(F.col("run_id") == run_id)


def save_fitted(df: DataFrame, path: str) -> None:
    """Fitted maps are small tables; store them as parquet."""
    df.write.mode("overwrite").parquet(path)


def load_fitted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_model(model, path: str) -> None:
    """Spark ML models and pipelines persist with their own writer."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def positive_probability(df: DataFrame, probability_col: str = "probability", labels=None,
                         out: str = "score") -> DataFrame:
    """Take the positive-class probability (label '1', else 'Yes', else index 1)."""
    from pyspark.ml.functions import vector_to_array
    idx = 1
    if labels is not None:
        labels = [str(x) for x in labels]
        for want in ("1", "1.0", "Yes"):
            if want in labels:
                idx = labels.index(want)
                break
    return df.withColumn(out, vector_to_array(F.col(probability_col))[idx])
