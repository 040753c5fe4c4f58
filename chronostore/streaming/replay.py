"""Continuous replay with Structured Streaming.

Each micro-batch of new log rows is replayed by the same native operators as a
whole log, from the heads of its keys. What a stream has built lies in a
folder: ``chain/batch=n`` has the chain rows of a micro-batch, ``heads/batch=n``
every key's head after it. A batch that is tried again overwrites its own
folders, so each row is applied once. One key's rows are cut into blocks like
any other's (``functions.blocks``), so a trigger may take a backlog of any size.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chain import heads
from ..operators.replay import replay, seeds_of
from ..operators.writes import expire_due
from ..schema import CHAIN, LOG
from ..sources.shared import delete

#: The batch that an installed snapshot counts as.
INSTALLED = -1


class OutOfOrder(ValueError):
    """A batch skips versions, or has rows of versions that were passed without them."""


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete batches under ``path``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    done = [s.getPath() for s in fs.listStatus(folder) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName().partition("=")[2]) for p in done)


def read_chain(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """The chain that a stream has built in ``out``, of the batches below ``before`` if given."""
    done = [n for n in _batches(spark, f"{out}/chain") if before is None or n < before]
    if not done:
        return spark.createDataFrame([], CHAIN)
    return spark.read.schema(CHAIN).parquet(*[f"{out}/chain/batch={n}" for n in done])


def read_heads(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """Every key's head after the newest batch, or the newest one below ``before``."""
    done = [n for n in _batches(spark, f"{out}/heads") if before is None or n < before]
    return spark.read.schema(CHAIN).parquet(f"{out}/heads/batch={done[-1]}") if done else spark.createDataFrame([], CHAIN)


def applied_in_order(applied: int, batch: DataFrame) -> int:
    """The version that a replica stands at after ``batch``, rows of the log above ``applied``.

    A replica takes exactly the next versions; a batch that skips some is
    refused. Counts tell, so rows never leave the executors.
    """
    low, high, n = batch.agg(F.min("version"), F.max("version"), F.count_distinct("version")).first()
    if n == 0:
        return applied
    if low != applied + 1 or high - low + 1 != n:
        raise OutOfOrder(f"expected versions from {applied + 1} on without a gap")
    return high


def apply_batch(out: str, batch: DataFrame, number: int, contiguous: bool = True) -> None:
    """Apply log rows to what ``out`` holds. OutOfOrder leaves it as it was.

    Rows at or below the applied version are dropped if the chain has them, as
    when a file arrives twice; one that it lacks came too late and is refused.
    ``contiguous``: versions above it must follow without a gap. Rows that
    repeat key and version within a batch count once. A batch writes each key's
    head anew, which costs as much as there are keys, so triggers should be
    large rather than many.
    """
    spark = batch.sparkSession
    state = read_heads(spark, out, number)
    applied = state.agg(F.max("version")).first()[0] or 0
    late = batch.where(F.col("version") <= applied).select("key", "version")
    if not late.isEmpty() and not late.join(read_chain(spark, out, number).select("key", "version"), ["key", "version"], "left_anti").isEmpty():
        raise OutOfOrder(f"rows at or below version {applied} that were never applied")
    fresh = batch.where(F.col("version") > applied).dropDuplicates(["key", "version"])
    if contiguous:
        applied_in_order(applied, fresh)
    touched = fresh.select("key").distinct()
    new = f"{out}/chain/batch={number}"
    replay(fresh, seeds_of(state.join(touched, "key", "left_semi"))).write.mode("overwrite").parquet(new)
    rows = spark.read.schema(CHAIN).parquet(new)
    heads(rows).select(*rows.columns).unionByName(state.join(touched, "key", "left_anti")).write.mode("overwrite").parquet(f"{out}/heads/batch={number}")
    for old in _batches(spark, f"{out}/heads")[:-2]:  # the state before this batch stays, for another try
        delete(spark, f"{out}/heads/batch={old}")


def install(chain: DataFrame, out: str) -> int:
    """Start ``out`` from a snapshot's chain; its highest version, which the stream then follows on from."""
    spark = chain.sparkSession
    if _batches(spark, f"{out}/heads"):
        raise ValueError("the folder has a stream's state already")
    chain.write.mode("overwrite").parquet(f"{out}/chain/batch={INSTALLED}")
    rows = read_chain(spark, out)
    heads(rows).select(*rows.columns).write.mode("overwrite").parquet(f"{out}/heads/batch={INSTALLED}")
    return rows.agg(F.max("version")).first()[0] or 0


def run(spark: SparkSession, log_path: str, out: str, checkpoint: str, contiguous: bool = True, **options: str) -> StreamingQuery:
    """Replay what ``log_path`` has and hasn't been replayed, then stop; another run goes on from there."""
    log = spark.readStream.schema(LOG).options(**options).parquet(log_path)
    step: Callable[[DataFrame, int], None] = lambda batch, number: apply_batch(out, batch, number, contiguous)
    return log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sweep(spark: SparkSession, out: str, log_path: str, now: datetime | str) -> int:
    """Append log rows that delete the heads whose deadline has come; how many. The next run of the stream applies them.

    Versions are allotted from the applied one on, so there must be no other
    writer. A sweep that is repeated before that run appends the same rows,
    which count once.
    """
    state = read_heads(spark, out)
    rows = expire_due(state, now, state.agg(F.max("version")).first()[0] or 0)
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(log_path)
    return n


def expirations(spark: SparkSession, out: str, log_path: str, checkpoint: str, every: str = "10 seconds") -> StreamingQuery:
    """A stream that sweeps at each trigger, as of the trigger's own time."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def step(batch: DataFrame, number: int) -> None:
        at = batch.agg(F.max("timestamp")).first()[0]
        if at is not None:
            sweep(batch.sparkSession, out, log_path, at)

    return clock.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
