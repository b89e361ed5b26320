"""An experiment table as a view over the star-schema tables: one unit per order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import ExperimentSpec

STAR_SPEC = ExperimentSpec(
    arm="segment",
    control="P",
    numeric=("recency", "history", "acctbal", "mens", "womens", "newbie"),
)

# Upper edges of the spend bands and their labels; the last band is open.
_BANDS = (
    (10_000.0, "1) <10k"),
    (25_000.0, "2) 10-25k"),
    (50_000.0, "3) 25-50k"),
    (100_000.0, "4) 50-100k"),
    (150_000.0, "5) 100-150k"),
    (200_000.0, "6) 150-200k"),
)
_LAST_BAND = "7) 200k +"


def _band(amount: Column) -> Column:
    label = F.lit(_LAST_BAND)
    for edge, name in reversed(_BANDS):
        label = F.when(amount < edge, name).otherwise(label)
    return label


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Per-order facts from the lines: conditional maxima, combined before the shuffle."""
    line = read_table(spark, folder, "lineitem")
    returned = F.col("l_returnflag") == "R"
    visit = returned & (F.col("l_discount") >= 0.085)
    conversion = (
        returned
        & (F.col("l_discount") >= 0.095)
        & (F.col("l_linestatus") == "F")
        & (F.col("l_quantity") >= 40)
    )

    def any_line(condition: Column) -> Column:
        return F.max(F.when(condition, 1).otherwise(0))

    return line.groupBy(F.col("l_orderkey").alias("unit_id")).agg(
        any_line(F.col("l_quantity") >= 25).alias("mens"),
        any_line(F.col("l_quantity") < 25).alias("womens"),
        any_line(visit).alias("visit"),
        any_line(conversion).alias("conversion"),
        F.max(F.when(conversion, F.col("l_extendedprice"))).alias("spend"),
    )


def experiment_units(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with customer and line facts, NULL where an order has no line.

    The customer join comes first: a hot customer is then split by the adaptive skew join, and the
    wide rows end up partitioned by order key, which is unique and therefore even. No join carries
    a broadcast hint; Spark broadcasts region, nation and customer only when their size allows it.
    """
    orders = read_table(spark, folder, "orders")
    place = read_table(spark, folder, "nation").join(
        read_table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
    )
    customer = read_table(spark, folder, "customer").join(
        place, F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    units = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("o_orderkey").alias("unit_id"),
        F.col("o_orderstatus").alias("segment"),
        F.datediff(F.lit("2002-01-01").cast("date"), F.col("o_orderdate")).alias("recency"),
        F.col("o_totalprice").alias("history"),
        F.col("c_acctbal").alias("acctbal"),
        F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("newbie"),
        _band(F.col("o_totalprice")).alias("history_segment"),
        F.col("r_name").alias("zip_code"),
        F.col("c_mktsegment").alias("channel"),
    )
    return units.join(order_lines(spark, folder), "unit_id", "left")


def experiment_table(spark: SparkSession, folder: str) -> DataFrame:
    """Contract columns plus key and one extra numeric; an order without lines has outcome 0."""
    filled = experiment_units(spark, folder)
    for name in ("mens", "womens", "visit", "conversion"):
        filled = filled.withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    filled = filled.withColumn("spend", F.coalesce(F.col("spend"), F.lit(0.0)))
    return filled.select(
        "unit_id", "segment", "recency", "history", "acctbal", "mens", "womens", "newbie",
        "history_segment", "zip_code", "channel", "visit", "conversion", "spend",
    )
