"""The reference concepts on the tables at hand: observations, evidence, cohorts and edges made from events, orders and nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dimensions import dimension, dimensions
from .runtime import table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations. Two dimensions: bucket (k modulo 10), and parity, which rows with an odd k don't carry."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    even = F.when(k % 2 == 0, dimension("parity", F.lit("even"), F.lit("Even")))
    return events(spark, sf_dir).select(
        F.lit("t0").alias("tenant_id"), F.lit("events").alias("source_key"), F.col("user_id").cast("string").alias("entity_id"), F.to_date("ts").alias("metric_date"),
        F.col("event_type").alias("measure_key"), "value", F.to_date("ts").cast("string").alias("subject_key"),
        dimensions(dimension("bucket", k % 10, F.concat(F.lit("Bucket "), k % 10)), even).alias("dimensions"),
    )


def order_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as observations of customers: what was ordered, and 1 for each finished and for each order."""
    o = table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    entry = lambda key, value: F.struct(F.lit(key).alias("measure_key"), value.cast("double").alias("value"))
    measures = F.array(entry("total", F.col("o_totalprice")), entry("orders", F.lit(1)), entry("finished", (F.col("o_orderstatus") == "F").cast("int")))
    return o.select(
        F.lit("t0").alias("tenant_id"), F.lit("orders").alias("source_key"), F.col("o_custkey").cast("string").alias("entity_id"), F.col("d").alias("metric_date"),
        F.inline(measures), F.col("o_orderkey").cast("string").alias("subject_key"), dimensions(dimension("priority", F.col("o_orderpriority"))).alias("dimensions"),
    )


def nation_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("entity_id"), F.col("c_nationkey").cast("string").alias("cohort_id"))


def lineitem_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item is evidence of its order: contribution is its price, and again its discount."""
    li = table(spark, sf_dir, "lineitem")
    record = F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 10, "0"), F.col("l_linenumber").cast("string"))
    entry = lambda key, value: F.struct(F.lit(key).alias("measure_key"), value.alias("contribution"))
    return li.select(
        F.lit("orders").alias("source_key"), F.col("l_suppkey").cast("string").alias("entity_id"), F.to_date("l_shipdate").alias("metric_date"), record.alias("record_id"),
        F.inline(F.array(entry("price", F.col("l_extendedprice")), entry("discounted", F.col("l_extendedprice") * F.col("l_discount")))),
        dimensions(dimension("flag", F.col("l_returnflag"))).alias("dimensions"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region -> nation -> customer."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    name = lambda kind, col: F.concat(F.lit(kind), F.col(col).cast("string"))
    return n.select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child")).unionByName(c.select(name("n", "c_nationkey").alias("parent"), name("c", "c_custkey").alias("child")))


def clickstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as product usage: views are page views of one of ten paths; a session is a user's day, empty for errors."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return events(spark, sf_dir).select(
        F.col("user_id").alias("person_id"), F.col("ts").alias("event_time"), F.when(F.col("event_type") == "view", "page_view").otherwise(F.col("event_type")).alias("event_name"),
        F.concat(F.lit("/page/"), k % 10).alias("path"), F.when(F.col("event_type") == "error", "").otherwise(F.concat_ws(":", F.col("user_id"), F.to_date("ts"))).alias("session_id"),
    )
