"""Mutation logs to version chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import HOT_ROWS, VERSIONS, blocked, carried, hot_only


def seeds_of(heads: DataFrame) -> DataFrame:
    """Keys' heads as log rows, for a replay that goes on from them."""
    op = F.when(F.col("tombstone"), "TOMBSTONE").otherwise("RESTORE_PUT")
    return heads.select("key", "version", "committed_at", op.alias("op"), "value", F.col("expires_at").alias("deadline"), "restored_from_version")


def replay(log: DataFrame, seeds: DataFrame | None = None, block: int = VERSIONS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The chain of ``log``; ``seeds`` are log rows that come before it and aren't returned.

    A put or restore writes a value and a delete a tombstone. An EXPIRE copies
    the value before it under a new deadline if that value is visible at the
    commit, and deletes otherwise: it lives if the last other operation wrote a
    value and no EXPIRE since came at or after its predecessor's deadline.

    Rows are shuffled and sorted once. Of keys with more than ``hot_rows`` rows
    each block of versions is a partition, and what it needs from those before
    it (last base, last deadline, last late EXPIRE) is carried between one
    summary row for each block. Null values of a put are kept as they are; an
    empty log gives an empty chain. Versions of a key are distinct and keys are
    not null (``schema.log_faults`` tells).
    """
    rows = log.withColumn("_seed", F.lit(False))
    if seeds is not None:
        rows = rows.unionByName(seeds.withColumn("_seed", F.lit(True)))
    rows, part = blocked(rows, F.col("version"), block, hot_rows)
    order = Window.partitionBy(*part).orderBy("version")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    is_late = lambda op, at, deadline: (op == "EXPIRE") & F.coalesce(at >= deadline, F.lit(False))

    def stepped(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_before", F.lag("deadline").over(order)).withColumn("_base", F.last(F.when(F.col("op") != "EXPIRE", F.struct("op", "value", "version")), True).over(running))
        return rows.withColumn("_late", F.max(F.when(is_late(F.col("op"), F.col("committed_at"), F.col("_before")), F.col("version"))).over(running))

    out = stepped(rows)
    if part != ("key",):
        ends = stepped(hot_only(rows)).groupBy("key", "_block").agg(
            F.max_by(F.struct("deadline", "_base"), "version").alias("end"),
            F.min_by(F.struct("op", "committed_at", "version"), "version").alias("head"),
            F.max("_late").alias("late"),
        )
        blocks = Window.partitionBy("key").orderBy("_block")
        earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn("before", F.lag("end").over(blocks)["deadline"])
        # The first row of a block comes after the last one of the block before it.
        ends = ends.withColumn("first", F.when(is_late(F.col("head.op"), F.col("head.committed_at"), F.col("before")), F.col("head.version"))).withColumn("late", F.greatest("late", "first"))
        late = F.greatest(F.max("late").over(earlier), "first")
        out = carried(out, ends.select("key", "_block", F.last("end._base", True).over(earlier).alias("_c_base"), late.alias("_c_late")))
        out = out.withColumn("_late", F.greatest("_late", "_c_late")).withColumn("_base", F.coalesce("_base", "_c_base"))
    base = F.col("_base")
    lives = F.coalesce(base["op"].isin("PUT", "RESTORE_PUT") & (F.coalesce("_late", F.lit(0)) <= base["version"]), F.lit(False))
    reason = F.when(F.col("op") == "EXPIRED_TOMBSTONE", "EXPIRED").when(F.col("op") == "RESTORE_TOMBSTONE", "RESTORED").otherwise("DELETED")
    return out.where(~F.col("_seed")).select(
        "key",
        "version",
        F.when(lives, base["value"]).alias("value"),
        (~lives).alias("tombstone"),
        "committed_at",
        F.when(lives, F.col("deadline")).alias("expires_at"),
        "restored_from_version",
        F.when(~lives, reason).alias("tombstone_reason"),
    )
