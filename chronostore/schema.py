"""Row types of mutation logs and version chains, and the rules that their rows keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One row for each key that a commit changes.
LOG = "key string, version bigint, committed_at timestamp, op string, value binary, deadline timestamp, restored_from_version bigint"
#: One row for each version of a key.
CHAIN = "key string, version bigint, value binary, tombstone boolean, committed_at timestamp, expires_at timestamp, restored_from_version bigint, tombstone_reason string"
COMMITS = "version bigint, committed_at timestamp, mutations array<struct<key:string,op:string,value:binary,deadline:timestamp,restored_from_version:bigint>>"
RULES = "prefix string, max_versions int, max_age_seconds bigint"

OPS = ("PUT", "TOMBSTONE", "EXPIRE", "RESTORE_PUT", "RESTORE_TOMBSTONE", "EXPIRED_TOMBSTONE")
MAX_KEY_BYTES = 1 << 20
MAX_VALUE_BYTES = 16 << 20
MAX_WRITES = 4096
MAX_WRITE_BYTES = 32 << 20


def log_faults(log: DataFrame) -> DataFrame:
    """Rows of ``log`` that break a rule, with the rule's name in ``fault``; no rows for a sound log.

    A null in key, version, committed_at or op is a fault; so is a key that one
    version changes twice, which is reported once, by aggregation.
    """
    has = lambda c: F.col(c).isNotNull()
    with_value, restored = F.col("op").isin("PUT", "RESTORE_PUT"), F.col("op").isin("RESTORE_PUT", "RESTORE_TOMBSTONE")
    fault: Column = (
        F.when(F.col("key").isNull() | (F.col("key") == ""), "empty key")
        .when(F.octet_length("key") > MAX_KEY_BYTES, "key too long")
        .when(F.col("version").isNull() | (F.col("version") < 1), "version below 1")
        .when(F.col("committed_at").isNull(), "no commit time")
        .when(F.col("op").isNull() | ~F.col("op").isin(*OPS), "unknown op")
        .when(with_value != has("value"), "value of the wrong op")
        .when(F.octet_length("value") > MAX_VALUE_BYTES, "value too long")
        .when(has("deadline") != (F.col("op") == "EXPIRE"), F.when(F.col("op") != "RESTORE_PUT", "deadline of the wrong op"))
        .when(restored != has("restored_from_version"), "source of the wrong op")
    )
    rows = log.select("key", "version", fault.alias("fault")).where("fault IS NOT NULL")
    twice = log.groupBy("key", "version").agg(F.count("*").alias("n")).where("n > 1")
    return rows.unionByName(twice.select("key", "version", F.lit("key changed twice in a version").alias("fault")))


def chain_faults(chain: DataFrame) -> DataFrame:
    """Rows of ``chain`` that break an invariant.

    A row has a key, a version of 1 or more and a commit time; exactly one of
    value and tombstone; on a tombstone a reason and no deadline; a source only
    below its own version. Of a version that a key has twice, one row is given.
    """
    dead, source = F.col("tombstone"), F.col("restored_from_version")
    bad = (dead == F.col("value").isNotNull()) | (dead & F.col("expires_at").isNotNull()) | (dead != F.col("tombstone_reason").isNotNull())
    bad = bad | dead.isNull() | F.col("key").isNull() | F.col("version").isNull() | (F.col("version") < 1) | F.col("committed_at").isNull() | F.coalesce(source >= F.col("version"), F.lit(False))
    twice = chain.groupBy("key", "version").agg(F.count("*").alias("_n"), F.min_by(F.struct(*chain.columns), F.xxhash64(*chain.columns)).alias("_row")).where("_n > 1")
    return chain.where(bad).unionByName(twice.select("_row.*")).distinct()
