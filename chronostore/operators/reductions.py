"""Counts and levels over logs, replicas and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Newest samples of a name that a latency summary covers.
SAMPLES = 2048


def commit_sizes(log: DataFrame) -> DataFrame:
    """(version, mutations, bytes) of each commit."""
    return log.groupBy("version").agg(F.count("*").alias("mutations"), F.sum(F.coalesce(F.octet_length("value"), F.lit(0))).cast("bigint").alias("bytes"))


def ack_floor(acks: DataFrame) -> DataFrame:
    """(floor): the least of the replicas' highest acknowledged versions; null without replicas."""
    return acks.groupBy("replica").agg(F.max("version").alias("v")).agg(F.min("v").alias("floor"))


def acl_rows(rows: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """Rows of the keys that an identity may see: those under one of its prefixes."""
    seen = F.lit(False)
    for p in prefixes:
        seen = seen | F.col("key").startswith(p)
    return rows.where(seen)


def latency_summary(samples: DataFrame) -> DataFrame:
    """(name, count, sum, least, most, p50, p95, p99) over each name's newest 2,048 of ``samples`` (name, seq, value).

    Percentiles are nearest rank: the value at ceil(q n) of n. The window is
    the metric's own bound; older samples are cut before the shuffle.
    """
    order = Window.partitionBy("name").orderBy(F.desc("seq"))
    last = samples.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= SAMPLES)
    rank = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)").cast("bigint")
    return last.groupBy("name").agg(
        F.count("*").alias("count"), F.sum("value").cast("bigint").alias("sum"), F.min("value").alias("least"), F.max("value").alias("most"), rank(0.5).alias("p50"), rank(0.95).alias("p95"), rank(0.99).alias("p99")
    )


def sync_plan(log: DataFrame, replicas: DataFrame) -> DataFrame:
    """(replica, plan, commits): how each of ``replicas`` (replica, applied) catches up.

    AHEAD of the log is an error; level needs no commits; INCREMENTAL takes
    the commits above ``applied`` if the log has them all; else FULL, which
    starts from a snapshot. The versions after the log's last gap are found by
    an equality join of each version with the one before it.
    """
    versions = log.select("version").distinct()
    before = versions.select((F.col("version") + 1).alias("version"), F.lit(True).alias("follows"))
    edge = versions.join(before, "version", "left").agg(F.max("version").alias("last"), F.max(F.when(F.col("follows").isNull(), F.col("version"))).alias("since"))
    last, since = (int(x or 0) for x in edge.first())  # two numbers
    one = replicas.withColumn("last", F.lit(last).cast("bigint")).withColumn("since", F.lit(since))
    plan = F.when(F.col("applied") > F.col("last"), "AHEAD").when(F.col("applied") == F.col("last"), "INCREMENTAL").when((F.col("applied") == 0) | (F.col("applied") + 1 < F.col("since")), "FULL").otherwise("INCREMENTAL")
    return one.withColumn("plan", plan).select("replica", "plan", F.when(F.col("plan") == "INCREMENTAL", F.col("last") - F.col("applied")).otherwise(0).cast("bigint").alias("commits"))
