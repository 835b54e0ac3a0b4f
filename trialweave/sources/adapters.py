"""Views of general event and order tables as recordings of trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def user_trials(spark: SparkSession, path: str) -> DataFrame:
    """A trial per user: participant, epoch, sample, condition, value, k (wide)."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return spark.read.parquet(f"{path}/events.parquet").select(
        (F.col("user_id") % 8).cast("long").alias("participant"),
        F.col("user_id").alias("epoch"),
        (F.row_number().over(order) - 1).cast("int").alias("sample"),
        (F.col("user_id") % 2).cast("int").alias("condition"),
        F.col("value"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


def long_form(wide: DataFrame, channels: list[str], keep: list[str] | None = None) -> DataFrame:
    """Wide samples to one row per channel."""
    keep = keep or ["participant", "epoch", "sample"]
    return wide.unpivot(keep, channels, "channel", "value")


def order_trials(spark: SparkSession, path: str) -> DataFrame:
    """A trial per order: samples are its lines in a total order; participant and condition from orders."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    lines = spark.read.parquet(f"{path}/lineitem.parquet").select(
        F.col("l_orderkey").alias("epoch"),
        (F.row_number().over(order) - 1).cast("int").alias("sample"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )
    return lines.join(order_metadata(spark, path), "epoch")


def order_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/orders.parquet").select(F.col("o_orderkey").alias("epoch"), (F.col("o_custkey") % 16).cast("long").alias("participant"), F.col("o_orderpriority").alias("condition"))


def triggers(spark: SparkSession, path: str) -> DataFrame:
    """participant, epoch (the event), at (seconds), label of the user events."""
    return spark.read.parquet(f"{path}/events.parquet").select(
        F.col("user_id").alias("participant"),
        F.col("event_id").alias("epoch"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"),
        F.col("event_type").alias("label"),
    )
