"""The order tables seen as a sales table.

``orders`` joins ``customer`` and ``nation``; the join strategy is Catalyst's: nation and a small
customer table broadcast under the session's size threshold, a large customer table is sort-merge
joined on its key and adaptive execution splits a customer that holds many of the orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.sources.sales import series_key


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_sales(spark: SparkSession, sf_dir: str, group_by: tuple[str, ...] = ("n_name",)) -> DataFrame:
    """Series per nation (or per nation and segment, ...), dated by order day."""
    orders = _table(spark, sf_dir, "orders")
    customer = _table(spark, sf_dir, "customer")
    nation = _table(spark, sf_dir, "nation")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .select(
            series_key(*group_by).alias("series_id"),
            F.col("o_orderdate").cast("date").alias("ds"),
            F.col("o_totalprice").alias("value"),
            F.col("c_mktsegment").alias("category"),
        )
    )


def customer_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series per customer. Orders still pending carry no total yet: their value is NULL."""
    return _table(spark, sf_dir, "orders").select(
        series_key("o_custkey").alias("series_id"),
        F.col("o_orderdate").cast("date").alias("ds"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("value"),
        F.col("o_orderpriority").alias("category"),
    )


def event_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series per event type: about a month long, so too short for cross-validation."""
    return _table(spark, sf_dir, "events").select(
        series_key("event_type").alias("series_id"),
        F.col("ts").cast("date").alias("ds"),
        F.col("value"),
        F.col("event_type").alias("category"),
    )
