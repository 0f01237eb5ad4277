"""Views of other event-like tables under the raw event schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



# Declared, so that planning a query opens no file.
_EVENTS = "ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
_LINEITEM = (
    "l_orderkey BIGINT, l_partkey BIGINT, l_extendedprice DOUBLE, l_returnflag STRING, "
    "l_shipdate TIMESTAMP_NTZ"
)
_ORDERS = "o_orderkey BIGINT, o_custkey BIGINT"
_PART = "p_partkey BIGINT, p_brand STRING, p_type STRING"


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events.parquet``: clicks stand for cart events, a user-day for a session."""
    raw = spark.read.schema(_EVENTS).parquet(f"{sf_dir}/events.parquet")
    key = F.get_json_object("props", "$.k")
    user = F.col("user_id").cast("string")
    return raw.select(
        F.col("ts").cast("timestamp").alias("event_time"),
        F.when(F.col("event_type") == "click", "cart")
        .otherwise(F.col("event_type"))
        .alias("event_type"),
        key.alias("product_id"),
        F.lit(None).cast("string").alias("category_id"),
        F.concat(F.lit("cat_"), (key.cast("bigint") % 10).cast("string")).alias("category_code"),
        F.lit(None).cast("string").alias("brand"),
        F.col("value").alias("price"),
        user.alias("user_id"),
        F.concat_ws("-", user, F.to_date("ts").cast("string")).alias("user_session"),
    )


def lineitem_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` with its order and part: one order is one session of a customer.

    No join hint: the planner broadcasts ``part`` while its size allows it and falls
    back to a shuffled join beyond that.
    """
    lineitem = spark.read.schema(_LINEITEM).parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.schema(_ORDERS).parquet(f"{sf_dir}/orders.parquet")
    part = spark.read.schema(_PART).parquet(f"{sf_dir}/part.parquet")
    return (
        lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_shipdate").cast("timestamp").alias("event_time"),
            F.when(F.col("l_returnflag") == "N", "view")
            .when(F.col("l_returnflag") == "A", "cart")
            .when(F.col("l_returnflag") == "R", "purchase")
            .alias("event_type"),
            F.col("l_partkey").cast("string").alias("product_id"),
            F.lit(None).cast("string").alias("category_id"),
            F.col("p_type").alias("category_code"),
            F.col("p_brand").alias("brand"),
            F.col("l_extendedprice").alias("price"),
            F.col("o_custkey").cast("string").alias("user_id"),
            F.col("l_orderkey").cast("string").alias("user_session"),
        )
    )


