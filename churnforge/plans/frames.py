"""Bind the operators to the driver's tables.

order_frame (one row per order): orders joined to customer and nation, with per-order line
aggregates. Roles: id = o_orderkey, label = order status 'F', split = key % 10 < 7 -> train
(a 7:3 train / score split of every row; nothing is filtered out). Numeric columns arrive
as dirty text as in the reference (numbers delivered as text); the dirt is injected by fixed
key rules because the driver's tables hold no nulls or bad text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnforge.functions import clean
from churnforge.sources.tables import read_table
from churnforge.spec import ColumnSpec

ORDER_SPEC = ColumnSpec(
    id="id", label="label",
    numeric=("tenure", "monthly", "total", "acctbal"),
    categorical=("priority", "segment", "nation", "flag"),
)

DOC_SPEC = ColumnSpec(id="doc_id", label="quality", numeric=("n_chars",), categorical=("lang", "source"))


def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-order line count, mean line price and most common return flag (smallest on tie): counts by
    (order, flag) with map-side combine, then by order; no order's lines are gathered."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_extendedprice", "l_returnflag"])
    by_flag = li.groupBy("l_orderkey", "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count("l_extendedprice").alias("n_priced"), F.sum("l_extendedprice").alias("price"))
    return by_flag.groupBy("l_orderkey").agg(
        F.sum("n").alias("n_lines"),
        F.try_divide(F.sum("price"), F.sum("n_priced")).alias("avg_line_price"),
        F.min(F.when(F.col("l_returnflag").isNotNull(), F.struct(-F.col("n"), "l_returnflag")))["l_returnflag"].alias("flag_mode"))


def raw_order_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with text-typed numbers and nullable categories, before cleaning."""
    o = read_table(spark, sf_dir, "orders",
                   ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    n = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])  # 25 rows, fixed size
    lines = line_stats(spark, sf_dir)
    df = (o.join(lines, o.o_orderkey == lines.l_orderkey, "left")
           .join(c, o.o_custkey == c.c_custkey, "inner")
           .join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "inner"))
    k = F.col("o_orderkey")
    price_txt = F.col("avg_line_price").cast("string")
    total_txt = F.col("o_totalprice").cast("string")
    return df.select(
        k.alias("id"),
        F.when(F.col("o_orderstatus") == "F", F.lit("Yes"))
         .when(F.col("o_orderstatus") == "O", F.lit("No"))
         .otherwise(F.col("o_orderstatus")).alias("churn_text"),
        F.when(k % 10 < 7, F.lit("train")).otherwise(F.lit("score")).alias("split"),
        F.col("n_lines").cast("string").alias("tenure_txt"),
        F.when(k % 41 == 0, F.lit(" ")).when(k % 43 == 0, F.lit("abc"))
         .when(k % 47 == 0, F.lit("nan")).otherwise(price_txt).alias("monthly_txt"),
        F.when(k % 53 == 0, F.lit("")).when(k % 59 == 0, F.concat(F.lit(" "), total_txt, F.lit(" ")))
         .when(k % 61 == 0, F.concat(total_txt, F.lit("d"))).otherwise(total_txt).alias("total_txt"),
        F.col("c_acctbal").alias("acctbal"),
        F.when(k % 67 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority")).alias("priority"),
        F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("nation"),
        F.col("flag_mode").alias("flag"),
    )


def order_frame(spark: SparkSession, sf_dir: str, fill: float | None = 0.0) -> DataFrame:
    """Cleaned order frame: P1 label, P5 numbers (fill 0; fill=None keeps nulls as P4)."""
    raw = raw_order_frame(spark, sf_dir)
    return raw.select(
        "id", clean.label_default0("churn_text").alias("label"), "split",
        clean.to_number("tenure_txt", fill).alias("tenure"),
        clean.to_number("monthly_txt", fill).alias("monthly"),
        clean.to_number("total_txt", fill).alias("total"),
        "acctbal", "priority", "segment", "nation", "flag")


#: Nineteen category sources for the all-pairs pattern: as they are, or as quantile bins of a number.
PAIR_CATEGORIES = ("priority", "year", "month", "weekday", "segment", "nation", "region", "flag",
                   "brand", "type", "size", "supp_nation", "supp_region")
PAIR_BINS = {"tenure": 15, "monthly": 20, "total": 20, "acctbal": 10, "supp_acctbal": 10, "retail": 15}


def category_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_frame with calendar parts and the part and supplier of the order's first line (smallest line
    number, then part, then supplier), all as text; an order without lines has nulls there."""
    f = order_frame(spark, sf_dir)
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"])
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    n = F.broadcast(read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"]))      # 25 rows
    r = F.broadcast(read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"]))                      # 5 rows
    places = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    first = li.groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("l")) \
        .select("l_orderkey", "l.l_partkey", "l.l_suppkey")
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_brand", "p_type", "p_size", "p_retailprice"])
    supp = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"]).join(
        places, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_acctbal", F.col("n_name").alias("supp_nation"),
                                                                    F.col("r_name").alias("supp_region"))
    lines = first.join(part, F.col("l_partkey") == F.col("p_partkey"), "left").join(
        supp, F.col("l_suppkey") == F.col("s_suppkey"), "left").select(
        "l_orderkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").cast("string").alias("size"),
        "supp_nation", "supp_region", F.col("s_acctbal").alias("supp_acctbal"), F.col("p_retailprice").alias("retail"))
    dates = o.select("o_orderkey", F.year("o_orderdate").cast("string").alias("year"),
                     F.month("o_orderdate").cast("string").alias("month"), F.dayofweek("o_orderdate").cast("string").alias("weekday"))
    home = places.select(F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    return (f.join(dates, F.col("id") == F.col("o_orderkey")).drop("o_orderkey").join(F.broadcast(home), "nation", "left")
             .join(lines, F.col("id") == F.col("l_orderkey"), "left").drop("l_orderkey"))


def original_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second labelled population with the columns of order_frame, disjoint from it: one row per supplier
    that has line items. Label: a higher share of returned lines than all lines have."""
    li = read_table(spark, sf_dir, "lineitem", ["l_suppkey", "l_extendedprice", "l_returnflag"])
    s = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"])
    n = F.broadcast(read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"]))                     # 25 rows
    returned = F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0))
    per = li.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.avg("l_extendedprice").alias("price"),
                                      F.sum("l_extendedprice").alias("total"), returned.alias("share"))
    rows = per.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.select(F.col("l_suppkey").alias("id"), (F.col("share") > li.select(returned).scalar()).cast("int").alias("label"),
                       F.col("n").cast("double").alias("tenure"), F.col("price").alias("monthly"), "total", F.col("s_acctbal").alias("acctbal"),
                       F.lit(None).cast("string").alias("priority"), F.lit(None).cast("string").alias("segment"),
                       F.col("n_name").alias("nation"), F.lit(None).cast("string").alias("flag"))


def doc_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents left-joined to labels: labelled rows are train, the rest score."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "lang", "source", "n_chars"])
    lab = read_table(spark, sf_dir, "labels", ["doc_id", "quality"])
    df = d.join(lab, "doc_id", "left")
    return df.select("doc_id", F.col("quality").cast("int").alias("quality"),
                     F.when(F.col("quality").isNotNull(), F.lit("train")).otherwise(F.lit("score")).alias("split"),
                     F.col("n_chars").cast("double").alias("n_chars"), "lang", "source")


def embedding_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    return e.select("vec_id", F.col("label").cast("int").alias("label"),
                    F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))


def score_tables(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Three deterministic stand-in prediction tables (model, id, split, label, score) derived from
    order columns, so the combination operators (blends, ranks, calibration, weight search) can be
    checked exactly against SQL. Scores are rounded to 3 places so ties occur. ``orders``: an order frame at hand."""
    f = order_frame(spark, sf_dir) if orders is None else orders
    a = F.round(F.col("total") / (F.col("total") + F.lit(150000.0)), 3)
    b = F.round(F.col("monthly") / (F.col("monthly") + F.lit(40000.0)), 3)
    c = F.round((F.col("acctbal") + F.lit(1000.0)) / F.lit(12000.0), 3)
    return f.select("id", "split", "label", F.explode(F.array(
        F.struct(F.lit("a").alias("model"), a.alias("score")),
        F.struct(F.lit("b").alias("model"), b.alias("score")),
        F.struct(F.lit("c").alias("model"), c.alias("score")))).alias("m")) \
        .select("m.model", "id", "split", "label", "m.score")
