"""Mutation logs derived from ordinary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _log(df: DataFrame, key: Column, version: Column, at: Column, op: Column, value: Column, deadline: Column) -> DataFrame:
    return df.select(
        key.alias("key"),
        version.cast("bigint").alias("version"),
        at.cast("timestamp").alias("committed_at"),
        op.alias("op"),
        value.cast("binary").alias("value"),
        deadline.cast("timestamp").alias("deadline"),
        F.lit(None).cast("bigint").alias("restored_from_version"),
    )


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as keys: an error deletes, a sign-up sets a deadline 12 hours on, other events put their props."""
    kind = F.col("event_type")
    op = F.when(kind == "error", "TOMBSTONE").when(kind == "signup", "EXPIRE").otherwise("PUT")
    ts = F.col("ts").cast("timestamp")
    return _log(table(spark, sf_dir, "events"), F.concat(F.lit("user:"), F.col("user_id").cast("string")), F.col("event_id") + 1, ts, op, F.when(op == "PUT", F.col("props")), F.when(op == "EXPIRE", ts + F.expr("INTERVAL 12 HOURS")))


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as keys, whose commit times go back and forth as versions grow."""
    none = F.lit(None)
    return _log(table(spark, sf_dir, "orders"), F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")), F.col("o_orderkey") + 1, F.col("o_orderdate"), F.lit("PUT"), F.col("o_orderpriority"), none)


def documents_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as keys and whole texts as values, a second apart."""
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id"))
    return _log(table(spark, sf_dir, "documents").where("doc_id IS NOT NULL"), F.col("source"), F.col("doc_id") + 1, at, F.lit("PUT"), F.coalesce("text", F.lit("")), F.lit(None))
