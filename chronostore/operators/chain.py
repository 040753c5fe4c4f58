"""Reads of version chains: current, as of a point, history, time to live.

Reads at one point are aggregations with a partial step before the shuffle, so
a key costs one row a task however many versions it has. Reads at many points
are as-of joins over blocks. Chains are as ``replay`` returns them; keys
without versions give no rows unless a function takes keys.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binary import seconds_left
from ..functions.blocks import HOT_ROWS, MICROS, VERSIONS, blocked, carried, carried_last, hot_only

ROW = ("version", "value", "tombstone", "committed_at", "expires_at", "restored_from_version", "tombstone_reason")
#: Versions that the SQL history reads before it filters; rows of a page; bytes of values that a page may have.
PREFETCH, PAGE, PAGE_BYTES = 1000, 100, 16 << 20


def visible(at: Column) -> Column:
    """Whether a version is neither deleted nor, at ``at``, expired; a deadline itself is expired."""
    return ~F.col("tombstone") & (F.col("expires_at").isNull() | (at < F.col("expires_at")))


def instant(at: datetime | str | Column) -> Column:
    return at if isinstance(at, Column) else F.lit(at).cast("timestamp")


def heads(chain: DataFrame) -> DataFrame:
    """Each key's newest version."""
    best = chain.groupBy("key").agg(F.max_by(F.struct(*ROW), "version").alias("head"))
    return best.select("key", "head.*")


def current(chain: DataFrame, now: datetime | str) -> DataFrame:
    """(key, value, version): heads visible at ``now``; a dead head hides what is older."""
    return heads(chain).where(visible(instant(now))).select("key", "value", "version")


def latest_version(chain: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(key, version): each key's highest version. With ``keys``, a row for each of them, 0 without any version."""
    found = chain.groupBy("key").agg(F.max("version").alias("version"))
    if keys is None:
        return found
    return keys.select("key").join(found, "key", "left").select("key", F.coalesce("version", F.lit(0).cast("bigint")).alias("version"))


def is_current(chain: DataFrame, pairs: DataFrame, now: datetime | str) -> DataFrame:
    """(key, version, is_current) of ``pairs``: whether it is the head, has a value, and its deadline has come."""
    tops = heads(chain).select("key", F.col("version").alias("_top"), "tombstone", "expires_at")
    due = (F.col("version") == F.col("_top")) & ~F.col("tombstone") & (F.col("expires_at") <= instant(now))
    return pairs.join(tops, "key", "left").select("key", "version", F.coalesce(due, F.lit(False)).alias("is_current"))


def ttl(chain: DataFrame, keys: DataFrame, now: datetime | str) -> DataFrame:
    """(key, ttl): -2 not visible, -1 without a deadline, else whole seconds left. Repeated keys stay."""
    at = instant(now)
    live = heads(chain).where(visible(at)).select("key", F.lit(1).alias("_live"), "expires_at")
    left = F.when(F.col("_live").isNull(), -2).when(F.col("expires_at").isNull(), -1).otherwise(seconds_left(F.col("expires_at"), at))
    return keys.select("key").join(live, "key", "left").select("key", left.cast("bigint").alias("ttl"))


def as_of(chain: DataFrame, version: int | None = None, timestamp: datetime | str | None = None, boundaries: DataFrame | None = None) -> DataFrame:
    """(key, version, value, state, expires_at) at a point, for keys that have a version there.

    At a version: the newest at or below it, deadlines ignored. At a time: the
    highest version committed at or before it, with deadlines as of that time.
    ``state`` is VALUE or DELETED, and a deleted row has no value. With the
    ``boundaries`` of a chain that retention cut, keys that had a version at
    the point, but keep none, give a row of state UNAVAILABLE without a version.
    """
    if (version is None) == (timestamp is None):
        raise ValueError("give a version or a timestamp")
    if version is not None:
        found, lives, began = heads(chain.where(F.col("version") <= version)), ~F.col("tombstone"), F.col("first_version") <= version
    else:
        at = instant(timestamp)
        found, lives, began = heads(chain.where(F.col("committed_at") <= at)), visible(at), F.col("first_committed_at") <= at
    out = found.select("key", "version", F.when(lives, F.col("value")).alias("value"), F.when(lives, "VALUE").otherwise("DELETED").alias("state"), "expires_at")
    if boundaries is None:
        return out
    cut = boundaries.where(F.col("truncated") & began).select("key")
    return out.join(cut, "key", "full").withColumn("state", F.coalesce("state", F.lit("UNAVAILABLE")))


def intervals(chain: DataFrame, block: int = VERSIONS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``chain`` with next_version and next_committed_at: a version holds until then, exclusive; null: still.

    A later version with an earlier commit time ends all before it, so the
    next commit time is the least of all later ones. Windows run from the
    newest version down, which makes that a running minimum.
    """
    rows, part = blocked(chain, F.col("version"), block, hot_rows)
    down = Window.partitionBy(*part).orderBy(F.desc("version"))
    out = rows.withColumn("next_version", F.lag("version").over(down)).withColumn("next_committed_at", F.min("committed_at").over(down.rowsBetween(Window.unboundedPreceding, -1)))
    if part == ("key",):
        return out
    ends = hot_only(rows).groupBy("key", "_block").agg(F.min("version").alias("v"), F.min("committed_at").alias("t"))
    blocks = Window.partitionBy("key").orderBy(F.desc("_block"))
    carry = ends.select("key", "_block", F.lag("v").over(blocks).alias("_v"), F.min("t").over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("_t"))
    out = carried(out, carry)
    return out.withColumn("next_version", F.coalesce("next_version", "_v")).withColumn("next_committed_at", F.least("next_committed_at", "_t")).drop("_hot", "_block", "_v", "_t")


def as_of_points(chain: DataFrame, points: DataFrame, block: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """As-of join: ``points`` (key, at_version or at_timestamp, any other columns) with version, value and state.

    The state is MISSING where the key has no version there. Repeated points
    stay; a null point is MISSING.
    """
    by_time = "at_timestamp" in points.columns
    if by_time:
        held = intervals(chain, hot_rows=hot_rows).where(F.col("next_committed_at").isNull() | (F.col("committed_at") < F.col("next_committed_at")))
        held = held.withColumn("_at", F.unix_micros("committed_at"))
        at, width = F.unix_micros("at_timestamp"), block or MICROS
    else:
        held, at, width = chain.withColumn("_at", F.col("version")), F.col("at_version"), block or VERSIONS
    found = F.struct("version", "value", "tombstone", "expires_at")
    left = held.select("key", "_at", F.lit(0).alias("_side"), found.alias("_row"))
    right = points.select("key", at.cast("bigint").alias("_at"), F.lit(1).alias("_side"), F.struct(*points.columns).alias("_point"))
    both = left.unionByName(right, allowMissingColumns=True)
    got = carried_last(both, ("_at", "_side"), width, "_row", "_found", hot_rows).where("_side = 1")
    row = F.when(F.col("_at").isNotNull(), F.col("_found"))
    lives = ~row["tombstone"]
    if by_time:
        lives = lives & (row["expires_at"].isNull() | (F.col("_point.at_timestamp") < row["expires_at"]))
    return got.select("_point.*", row["version"].alias("version"), F.when(lives, row["value"]).alias("value"), F.when(row.isNull(), "MISSING").when(lives, "VALUE").otherwise("DELETED").alias("state"))


def lookup_status(chain: DataFrame, boundaries: DataFrame, points: DataFrame) -> DataFrame:
    """(key, at_version or at_timestamp, status) of ``points``: FOUND, KEY_NOT_FOUND or HISTORY_UNAVAILABLE.

    A point from the key's first version on that retention has left nothing
    for is unavailable; without a collected version it isn't found.
    """
    at, first = ("at_timestamp", "first_committed_at") if "at_timestamp" in points.columns else ("at_version", "first_version")
    got = as_of_points(chain, points.select("key", at)).join(boundaries.select("key", first, "truncated"), "key", "left")
    gone = F.col("truncated") & (F.col(at) >= F.col(first))
    return got.select("key", at, F.when(F.col("state") != "MISSING", "FOUND").when(gone, "HISTORY_UNAVAILABLE").otherwise("KEY_NOT_FOUND").alias("status"))


def newest(chain: DataFrame, n: int) -> DataFrame:
    """Each key's newest ``n`` versions with ``rn``; ranks above ``n`` are cut before the shuffle as well."""
    order = Window.partitionBy("key").orderBy(F.desc("version"))
    return chain.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)


def history(chain: DataFrame, offset: int = 0, limit: int = PAGE) -> DataFrame:
    """(key, version, committed_ms, state, value): a page of each key's versions, newest first; expired ones keep their value."""
    if offset < 0 or not 1 <= limit <= PREFETCH:
        raise ValueError("offset from 0, limit from 1 to 1000")
    page = newest(chain, offset + limit).where(F.col("rn") > offset)
    return page.select("key", "version", F.unix_millis("committed_at").alias("committed_ms"), F.when(F.col("tombstone"), "TOMBSTONE").otherwise("VALUE").alias("state"), "value")


def history_bytes(page: DataFrame) -> DataFrame:
    """(key, versions, bytes, fits) of a page of ``history``: bytes of each key's values, and whether they keep to 16 MiB."""
    size = F.sum(F.coalesce(F.octet_length("value"), F.lit(0))).cast("bigint")
    return page.groupBy("key").agg(F.count("*").alias("versions"), size.alias("bytes")).withColumn("fits", F.col("bytes") <= PAGE_BYTES)


def history_where(chain: DataFrame, least: int = 0, ascending: bool = False, offset: int = 0, limit: int = PAGE) -> DataFrame:
    """As ``history``, but of the newest 1,000 versions only those from ``least`` on, in either order."""
    order = Window.partitionBy("key").orderBy(F.asc("version") if ascending else F.desc("version"))
    rows = newest(chain, PREFETCH).where(F.col("version") >= least).withColumn("rn", F.row_number().over(order))
    return history(rows.where((F.col("rn") > offset) & (F.col("rn") <= offset + limit)).drop("rn"), 0, limit)
