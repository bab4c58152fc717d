"""Adapter views of the driver's tables as leads, sightings, phone claims, field claims, places and crawl runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer; a lead without funds counts as merged into the lead before it."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("municipality_id"),
        F.col("c_mktsegment").alias("classification"),
        F.col("c_acctbal").alias("score"),
        F.when(F.col("c_acctbal") < 0, F.col("c_custkey") - 1).alias("merged_into_id"),
    )


def active(found: DataFrame) -> DataFrame:
    return found.where(F.col("merged_into_id").isNull())


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("lead_id"),
        F.col("o_orderpriority").alias("source_id"),
        F.col("o_orderkey").alias("url_id"),
        F.col("o_orderdate").alias("seen_at"),
    )


def phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One phone claim per order; a finished order's is valid."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("lead_id"),
        (F.col("o_orderkey") % 97).alias("e164"),
        F.when(F.col("o_orderstatus") == "O", "mobile").when(F.col("o_orderstatus") == "F", "landline").otherwise("unknown").alias("type"),
        (F.col("o_orderstatus") == "F").alias("valid"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_primary"),
        F.col("o_orderpriority").alias("source_id"),
        F.col("o_orderdate").alias("seen_at"),
        F.col("o_orderkey").alias("claim_id"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("lead_id"),
        F.col("l_returnflag").alias("field"),
        F.col("l_quantity").cast("int").alias("value"),
        F.col("l_linenumber").alias("source_id"),
        F.col("l_shipdate").alias("seen_at"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("part_id"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation below region; a nation's tier is its key modulo 3, its population a rule of the key."""
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("municipality_id"),
        F.col("n_name").alias("place"),
        F.col("n_regionkey").alias("region_id"),
        (F.col("n_nationkey") % 3 + 1).alias("tier"),
        ((F.col("n_nationkey") * 7919) % 25 * 1000 + 5000).alias("population"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"), F.col("user_id").alias("source_id"),
        F.col("event_type").alias("status"), F.floor("value").alias("leads_created"),
    )
