"""Changes as log rows: deletes, deadlines, restores, expiry sweeps, transactions.

Nothing is changed in place. Each function returns what a change does and the
log rows that record it; a caller appends them at the version it allots.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import seconds_left
from ..schema import MAX_WRITE_BYTES, MAX_WRITES
from ..sources.shared import numbered
from .chain import as_of, current, heads, instant, latest_version, visible


def _rows(df: DataFrame, version: Column, at: Column, op: Column, value: Column | None = None, deadline: Column | None = None, source: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return df.select(
        "key",
        version.cast("bigint").alias("version"),
        at.alias("committed_at"),
        op.alias("op"),
        (none if value is None else value).cast("binary").alias("value"),
        (none if deadline is None else deadline).cast("timestamp").alias("deadline"),
        (none if source is None else source).cast("bigint").alias("restored_from_version"),
    )


def affected(chain: DataFrame, keys: DataFrame, now: datetime | str) -> DataFrame:
    """(key, affected): 1 for keys that a delete or a new deadline would change, those visible now, else 0."""
    live = current(chain, now).select("key", F.lit(1).alias("_live"))
    return keys.select("key").distinct().join(live, "key", "left").select("key", F.coalesce("_live", F.lit(0)).cast("bigint").alias("affected"))


def delete(chain: DataFrame, keys: DataFrame, version: int, now: datetime | str) -> DataFrame:
    """Log rows that delete the visible ones of ``keys`` in one commit."""
    hit = affected(chain, keys, now).where("affected = 1")
    return _rows(hit, F.lit(version), instant(now), F.lit("TOMBSTONE"))


def expire(chain: DataFrame, keys: DataFrame, version: int, now: datetime | str, seconds: int) -> DataFrame:
    """Log rows that give the visible ones of ``keys`` a deadline ``seconds`` from now."""
    if seconds < 0:
        raise ValueError("seconds below 0")
    hit = affected(chain, keys, now).where("affected = 1")
    return _rows(hit, F.lit(version), instant(now), F.lit("EXPIRE"), deadline=instant(now) + F.make_dt_interval(secs=F.lit(seconds)))


def restore_at(chain: DataFrame, keys: DataFrame, at_version: int, version: int, now: datetime | str) -> DataFrame:
    """Log rows that restore ``keys`` to the newest version at or below ``at_version``.

    The source's own version, value and absolute deadline are carried; a
    deleted source restores a tombstone; keys without a source give no row,
    whether they had none yet or retention removed it (``lookup_status`` tells).
    """
    old = as_of(chain, version=at_version).join(keys.select("key").distinct(), "key", "left_semi").withColumnRenamed("version", "source")
    dead = F.col("state") == "DELETED"
    return _rows(old, F.lit(version), instant(now), F.when(dead, "RESTORE_TOMBSTONE").otherwise("RESTORE_PUT"), F.col("value"), F.when(~dead, F.col("expires_at")), F.col("source"))


def expire_due(chain: DataFrame, now: datetime | str, last_version: int) -> DataFrame:
    """Log rows that delete the heads whose deadline has come, each in a commit of its own after ``last_version``.

    They go in order of deadline, key and version; the numbers are counted
    over ranges of that order, not in one task.
    """
    at = instant(now)
    due = heads(chain).where(~F.col("tombstone") & (F.col("expires_at") <= at)).select("key", F.col("version").alias("head"), "expires_at")
    return _rows(numbered(due, "expires_at", "key", "head"), F.col("nth") + last_version, at, F.lit("EXPIRED_TOMBSTONE"))


def conflicts(chain: DataFrame, writes: DataFrame, snapshot_version: int) -> DataFrame:
    """(key, latest_version): written keys that were committed after the snapshot; any at all refuse the commit."""
    late = latest_version(chain.where(F.col("version") > snapshot_version))
    return late.join(writes.select("key").distinct(), "key", "left_semi").select("key", F.col("version").alias("latest_version"))


def write_set_faults(writes: DataFrame) -> DataFrame:
    """(fault): the limits that a write set breaks; one mutation for each key."""
    sizes = writes.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("value"), F.lit(0))).alias("bytes"))
    over = sizes.select(F.explode(F.array(F.when(F.col("n") > MAX_WRITES, "too many writes"), F.when(F.col("bytes") > MAX_WRITE_BYTES, "too many bytes"))).alias("fault"))
    twice = writes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("key written twice").alias("fault")).distinct()
    return over.where("fault IS NOT NULL").unionByName(twice)


def transaction_view(chain: DataFrame, writes: DataFrame, snapshot_version: int, now: datetime | str) -> DataFrame:
    """(key, value, expires_at): what a transaction reads: its snapshot, visible now, under its own ``writes`` (key, op, value, deadline)."""
    at = instant(now)
    base = heads(chain.where(F.col("version") <= snapshot_version)).where(visible(at)).select("key", F.col("value").alias("old"), "expires_at")
    own = writes.select("key", "op", F.col("value").alias("new"), "deadline")
    both = base.join(own, "key", "full")
    op, puts = F.col("op"), F.col("op").isin("PUT", "RESTORE_PUT")
    due = (op != "PUT") & F.coalesce(F.col("deadline") <= at, F.lit(False))
    value = F.when(op.isNull(), F.col("old")).when(puts & ~due, F.col("new")).when((op == "EXPIRE") & ~due, F.col("old"))
    expires = F.when(op.isNull(), F.col("expires_at")).when(op.isin("RESTORE_PUT", "EXPIRE"), F.col("deadline"))
    return both.select("key", value.alias("value"), expires.alias("expires_at")).where("value IS NOT NULL")


def transaction_ttl(chain: DataFrame, writes: DataFrame, snapshot_version: int, now: datetime | str, keys: DataFrame) -> DataFrame:
    """(key, ttl) of ``keys`` inside a transaction: -2 not visible to it, -1 without a deadline, else whole seconds left."""
    at = instant(now)
    live = transaction_view(chain, writes, snapshot_version, now).select("key", F.lit(1).alias("_live"), "expires_at")
    left = F.when(F.col("_live").isNull(), -2).when(F.col("expires_at").isNull(), -1).otherwise(seconds_left(F.col("expires_at"), at))
    return keys.select("key").join(live, "key", "left").select("key", left.cast("bigint").alias("ttl"))


class TransactionConflict(Exception):
    """The keys that were committed after the transaction's snapshot; nothing was committed."""

    def __init__(self, keys: list[str]):
        super().__init__(f"{len(keys)} written keys changed since the snapshot")
        self.keys = keys


def commit(chain: DataFrame, writes: DataFrame, snapshot_version: int, version: int, at: datetime | str) -> DataFrame:
    """Log rows of a transaction's write set, all at one version; without writes, none.

    The first committer wins: if any written key has a version above
    ``snapshot_version``, the whole transaction is refused with
    TransactionConflict. ``writes``: key, op, value, deadline and, where some
    are restores, restored_from_version.
    """
    lost = [r.key for r in conflicts(chain, writes, snapshot_version).select("key").collect()]  # at most MAX_WRITES
    if lost:
        raise TransactionConflict(sorted(lost))
    source = F.col("restored_from_version") if "restored_from_version" in writes.columns else None
    return _rows(writes, F.lit(version), instant(at), F.col("op"), F.col("value"), F.col("deadline"), source)
