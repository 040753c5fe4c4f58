"""Differences of keys' values between two points."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import after, common_prefix
from .chain import instant

Point = int | datetime | str


def _reached(point: Point, version: str = "version", at: str = "committed_at") -> Column:
    return F.col(version) <= point if isinstance(point, int) else F.col(at) <= instant(point)


def diff(chain: DataFrame, before: Point, after_: Point, boundaries: DataFrame | None = None) -> DataFrame:
    """(key, before_state, after_state, common_prefix, before_suffix, after_suffix) for all keys that either point has.

    Points are versions (int) or times, in any order and mix. States are VALUE,
    DELETED or MISSING; the prefix is counted in bytes and 0 unless both sides
    have a value; a suffix is null where its side has none, and empty where
    the other side begins with it. With the ``boundaries`` of a chain that
    retention cut, a side may be UNAVAILABLE; prefix and suffixes are then null.

    Both points are found in one aggregation over the chain.
    """
    row = F.struct("value", "tombstone", "expires_at")
    points = {"old": before, "new": after_}
    found = chain.where(_reached(before) | _reached(after_)).groupBy("key").agg(*[F.max_by(row, F.when(_reached(p), F.col("version"))).alias(f"{side}_row") for side, p in points.items()])
    if boundaries is not None:
        cut = [(F.col("truncated") & _reached(p, "first_version", "first_committed_at")).alias(f"{side}_cut") for side, p in points.items()]
        found = found.join(boundaries.select("key", *cut).where("old_cut OR new_cut"), "key", "full")
    for side, p in points.items():
        held = F.col(f"{side}_row")
        lives = ~held["tombstone"]
        if not isinstance(p, int):
            lives = lives & (held["expires_at"].isNull() | (instant(p) < held["expires_at"]))
        lost = F.coalesce(F.col(f"{side}_cut"), F.lit(False)) if boundaries is not None else F.lit(False)
        state = F.when(held.isNotNull(), F.when(lives, "VALUE").otherwise("DELETED")).when(lost, "UNAVAILABLE").otherwise("MISSING")
        found = found.withColumn(f"{side}_state", state).withColumn(side, F.when(lives, held["value"]))
    found = found.withColumn("n", common_prefix(F.col("old"), F.col("new")))
    shown = lambda c: F.when((F.col("old_state") != "UNAVAILABLE") & (F.col("new_state") != "UNAVAILABLE"), c)
    return found.select(
        "key",
        F.col("old_state").alias("before_state"),
        F.col("new_state").alias("after_state"),
        shown(F.col("n")).alias("common_prefix"),
        shown(after(F.col("old"), F.col("n"))).alias("before_suffix"),
        shown(after(F.col("new"), F.col("n"))).alias("after_suffix"),
    )
