"""Windows over a key's rows that no single task has to hold.

Most keys have few rows, and each is a window partition of its own. A key may
hold a large part of all rows, though: such hot keys are found first, by a
count over the key column. Their rows are cut into blocks of the ordering
column, each block is a window partition, and what a row needs from other
blocks is carried between one summary row for each block. Without hot keys the
plan has neither blocks nor joins.

Keys are not null (``schema.log_faults`` tells); rows with a null key are one
window partition, which is never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Versions in a block.
VERSIONS = 1 << 20
#: Microseconds in a block.
MICROS = 3_600_000_000
#: Rows of a key that one task takes.
HOT_ROWS = 1 << 20
#: Hot keys that are broadcast at most.
BROADCAST_KEYS = 100_000


def block_of(order: Column, width: int) -> Column:
    return F.floor(order / F.lit(width)).cast("bigint")


def blocked(rows: DataFrame, order: Column, width: int, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, tuple[str, ...]]:
    """``rows`` and the columns that name a window partition: ("key",), or ("key", "_block") where keys are hot.

    In the second case rows have ``_hot``, null for keys of ``hot_rows`` rows or fewer, whose block is 0.
    """
    many = rows.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).select(F.col("key").alias("_hot"))
    if many.isEmpty():
        return rows, ("key",)
    many = stored(many, "hot-keys")  # fewer than one for hot_rows rows
    many = F.broadcast(many) if many.count() <= BROADCAST_KEYS else many
    marked = rows.join(many, F.col("key") == F.col("_hot"), "left")
    return marked.withColumn("_block", F.when(F.col("_hot").isNotNull(), block_of(order, width)).otherwise(F.lit(0).cast("bigint"))), ("key", "_block")


def hot_only(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("_hot").isNotNull())


def carried(rows: DataFrame, carry: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``carry``, which has a row for each block of each hot key."""
    other = carry.withColumnsRenamed({"key": "_on_key", "_block": "_on_block"})
    return rows.join(other, (F.col("key") == F.col("_on_key")) & (F.col("_block") == F.col("_on_block")), "left").drop("_on_key", "_on_block")


def carried_last(rows: DataFrame, order: tuple[str, ...], width: int, value: str, out: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``out``: the key's last ``value`` that isn't null, at or before the row in ``order``.

    ``order[0]`` is the numeric column that blocks are cut from.
    """
    rows, part = blocked(rows, F.col(order[0]), width, hot_rows)
    here = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn(out, F.last(value, True).over(here))
    if part == ("key",):
        return local
    ends = hot_only(rows).groupBy("key", "_block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_end"))
    before = Window.partitionBy("key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("key", "_block", F.last("_end", True).over(before).alias("_carry"))
    return carried(local, carry).withColumn(out, F.coalesce(out, "_carry")).drop("_hot", "_block", "_carry")


def ranked(rows: DataFrame, out: str = "rn", width: int = VERSIONS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``out``: 1 for a key's newest version, 2 for the one before it, and so on."""
    rows, part = blocked(rows, F.col("version"), width, hot_rows)
    local = rows.withColumn(out, F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("version"))))
    if part == ("key",):
        return local
    later = Window.partitionBy("key").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carry = hot_only(rows).groupBy("key", "_block").agg(F.count("*").alias("n")).select("key", "_block", F.sum("n").over(later).alias("_carry"))
    return carried(local, carry).withColumn(out, F.col(out) + F.coalesce("_carry", F.lit(0))).drop("_hot", "_block", "_carry")
