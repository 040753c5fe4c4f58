"""Commit logs and snapshots as Parquet tables.

A commit log has a row for each commit with its mutations as an array, so that
one commit is one unit. A snapshot is a chain and its boundaries as of a
version, in a folder named after it; the newest two are kept.
"""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chain import heads
from ..operators.replay import replay, seeds_of
from ..operators.retention import boundaries, boundaries_after, retain
from .shared import delete, new_path, stored

FIELDS = ("key", "op", "value", "deadline", "restored_from_version")


def as_commits(log: DataFrame) -> DataFrame:
    """One row for each version. A commit has at most 4,096 mutations, which bounds its array."""
    return log.groupBy("version").agg(F.min("committed_at").alias("committed_at"), F.sort_array(F.collect_list(F.struct(*FIELDS))).alias("mutations"))


def as_log(commits: DataFrame) -> DataFrame:
    return commits.select("version", "committed_at", F.inline("mutations")).select("key", "version", "committed_at", "op", "value", "deadline", "restored_from_version")


def compact(commits: DataFrame, through: int) -> DataFrame:
    """The commits above ``through``; the filter reaches the scan."""
    return commits.where(F.col("version") > through)


def recover(snapshot: DataFrame, log: DataFrame, cut: int) -> DataFrame:
    """The chain of ``snapshot``, a chain as of version ``cut``, and of the part of ``log`` above it.

    Only the tail is replayed; each key starts from its head in the snapshot.
    """
    tail = log.where(F.col("version") > cut)
    return snapshot.unionByName(replay(tail, seeds_of(heads(snapshot))))


def recover_boundaries(earlier: DataFrame, chain: DataFrame) -> DataFrame:
    """Boundaries after a recovery: those of the snapshot, and new ones of keys that it didn't have."""
    return boundaries(chain, earlier=earlier)


class Snapshot(NamedTuple):
    version: int
    chain: DataFrame
    boundaries: DataFrame


class Snapshots:
    """Snapshots under a folder, by version."""

    def __init__(self, spark: SparkSession, path: str | None = None, kept: int = 2):
        self.spark, self.path, self.kept = spark, path or new_path(spark, "snapshots"), kept

    def _exists(self, *parts: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def versions(self) -> list[int]:
        """Versions of complete snapshots, newest first; an interrupted one has no totals and doesn't count."""
        if not self._exists():
            return []
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        names = [s.getPath().getName() for s in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)]
        return sorted((int(n.partition("=")[2]) for n in names if n.startswith("cut=") and self._exists(n, "totals", "_SUCCESS")), reverse=True)

    @staticmethod
    def _totals(chain: DataFrame, bounds: DataFrame) -> tuple:
        """Row counts and sums of row hashes, which tell whether the files hold what was written."""
        one = lambda df: tuple(df.select(F.xxhash64(*sorted(df.columns)).cast("decimal(20,0)").alias("h")).agg(F.count("*"), F.coalesce(F.sum("h"), F.lit(0)).cast("string")).first())
        return (*one(chain), *one(bounds))

    def save(self, chain: DataFrame, version: int, bounds: DataFrame | None = None) -> None:
        """Write ``chain`` as of ``version`` and its boundaries, by default those of an uncut chain. Totals come last and make it complete."""
        folder, rows = f"{self.path}/cut={version}", chain.where(F.col("version") <= version)
        rows.write.mode("overwrite").parquet(f"{folder}/chain")
        rows = self.spark.read.parquet(f"{folder}/chain")
        (boundaries(rows) if bounds is None else bounds).write.mode("overwrite").parquet(f"{folder}/boundaries")
        totals = self._totals(rows, self.spark.read.parquet(f"{folder}/boundaries"))
        self.spark.createDataFrame([totals], "n bigint, sum string, bn bigint, bsum string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/totals")
        for old in self.versions()[self.kept :]:
            delete(self.spark, f"{self.path}/cut={old}")

    def read(self, version: int) -> Snapshot:
        """The snapshot of ``version``; ValueError if its files don't hold what was written."""
        folder = f"{self.path}/cut={version}"
        try:
            chain, bounds = (self.spark.read.parquet(f"{folder}/{x}") for x in ("chain", "boundaries"))
            sound = self._totals(chain, bounds) == tuple(self.spark.read.parquet(f"{folder}/totals").first())
        except (PySparkException, Py4JError) as e:
            raise ValueError(f"snapshot {version} cannot be read") from e
        if not sound:
            raise ValueError(f"snapshot {version} is not what was written")
        return Snapshot(version, chain, bounds)

    def load(self) -> Snapshot | None:
        """The newest sound snapshot; broken newer ones are passed over.

        None without any snapshot, for a recovery from the whole log; if there
        are some and none is sound, an error.
        """
        found = self.versions()
        for version in found:
            try:
                return self.read(version)
            except ValueError:
                if version == found[-1]:
                    raise
        return None

    def safe_compaction(self) -> int:
        """The version through which the log may go: the oldest of at least two snapshots, else 0."""
        found = self.versions()
        return found[-1] if len(found) > 1 else 0


class Maintained(NamedTuple):
    chain: DataFrame
    boundaries: DataFrame
    commits: DataFrame
    compacted_through: int


def maintain(chain: DataFrame, commits: DataFrame, snapshots: Snapshots, rules: DataFrame, now: datetime | str, version: int, oldest_snapshot: int = 0, earlier: DataFrame | None = None) -> Maintained:
    """Collect history under ``rules``, save a snapshot as of ``version``, compact the commits.

    Commits go only through the oldest snapshot that is kept, so that a broken
    newest one still leaves a way to recover.
    """
    bounds = stored(boundaries_after(chain, rules, now, oldest_snapshot, earlier), "boundaries")
    kept = stored(retain(chain, rules, now, oldest_snapshot), "retained")
    snapshots.save(kept, version, bounds)
    through = snapshots.safe_compaction()
    return Maintained(kept, bounds, compact(commits, through), through)
