"""Retention: which versions a key keeps, and what is known of those it lost."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import HOT_ROWS, VERSIONS, ranked
from .chain import instant

#: Rules that are broadcast at most; beyond it the joins shuffle.
BROADCAST_RULES = 100_000


def with_rule(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` (key, ...) with _rule (prefix, max_versions, max_age_seconds) of the longest prefix that fits, or null.

    The rule of prefix '' is the default. Keys are cut to each length that
    prefixes have and joined by equality, so no key meets a rule that doesn't
    fit, and rows stay where they are. Of rules that repeat a prefix, the one
    that keeps most versions counts.
    """
    body = F.struct("max_versions", "max_age_seconds")
    rules = rules.where("prefix IS NOT NULL").groupBy("prefix").agg(F.max(body).alias("r")).select("prefix", F.struct("prefix", "r.*").alias("rule"))
    sizes = {r[0]: r[1] for r in rules.groupBy(F.length("prefix")).count().collect()}  # a row for each length
    few, found = sum(sizes.values()) <= BROADCAST_RULES, []
    for n in sorted(sizes, reverse=True):
        if n == 0:
            default = rules.where("prefix = ''").first()["rule"]
            found.append(F.struct(F.lit("").alias("prefix"), F.lit(default["max_versions"]).cast("int").alias("max_versions"), F.lit(default["max_age_seconds"]).cast("bigint").alias("max_age_seconds")))
            continue
        of = rules.where(F.length("prefix") == n).select(F.col("prefix").alias(f"_p{n}"), F.col("rule").alias(f"_r{n}"))
        rows = rows.join(F.broadcast(of) if few else of, F.substring("key", 1, n) == F.col(f"_p{n}"), "left")
        found.append(F.col(f"_r{n}"))
    none = F.lit(None).cast("struct<prefix:string,max_versions:int,max_age_seconds:bigint>")
    drop = [f"_{x}{n}" for n in sizes if n for x in "pr"]
    return rows.withColumn("_rule", F.coalesce(*found, none)).drop(*drop)


def rule_for_key(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, prefix, max_versions, max_age_seconds): for each distinct key its rule of the longest prefix.

    Keys that no rule fits give no row.
    """
    return with_rule(keys.select("key").distinct(), rules).where("_rule IS NOT NULL").select("key", "_rule.*")


def collected(chain: DataFrame, rules: DataFrame, now: datetime | str, oldest_snapshot: int = 0, block: int = VERSIONS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(key, versions, kept, floor, first_version, first_committed_at): what a collection of ``chain`` does to each key.

    A key keeps a run of its newest versions: as many as its rule allows, up
    to the first one that is too old; its newest in any case; and all from the
    one that the oldest open snapshot reads. Keys without a rule keep all and
    have a null floor. One pass over three columns of the chain: versions are
    ranked within keys, and all else is one aggregation.
    """
    rows = ranked(with_rule(chain.select("key", "version", "committed_at"), rules), "_rn", block, hot_rows)
    most = F.greatest(F.col("_rule.max_versions"), F.lit(1))
    old = F.col("committed_at") < instant(now) - F.make_dt_interval(secs=F.col("_rule.max_age_seconds"))
    read = F.col("version") <= oldest_snapshot
    out = rows.groupBy("key").agg(
        F.count("*").alias("versions"),
        F.max("version").alias("head"),
        F.min_by(F.struct("version", "committed_at"), "version").alias("first"),
        F.max(most).alias("most"),
        F.min(F.when(F.col("_rn") <= most, F.col("version"))).alias("by_count"),
        # The newest too-old version stops the run; the least version above it is where the run begins.
        F.max(F.when(old, F.col("version"))).alias("stop"),
        F.min(F.when(old, F.col("_rn"))).alias("stop_rn"),
        F.max(F.when(read, F.col("version"))).alias("pin"),
        F.min(F.when(read, F.col("_rn"))).alias("pin_rn"),
    )
    # A floor need not be a version itself: what counts is which versions lie above it.
    by_age = F.least("head", F.coalesce(F.col("stop") + 1, F.lit(1).cast("bigint")))
    floor = F.when(F.col("most").isNotNull(), F.least(F.greatest("by_count", by_age), "pin"))
    young = F.greatest(F.coalesce(F.col("stop_rn") - 1, F.col("versions")), F.lit(1))
    kept = F.greatest(F.least(F.col("versions"), F.col("most"), young), F.coalesce("pin_rn", F.lit(0)))
    kept = F.when(F.col("most").isNotNull(), kept).otherwise(F.col("versions")).cast("bigint")
    return out.select("key", "versions", kept.alias("kept"), floor.alias("floor"), F.col("first.version").alias("first_version"), F.col("first.committed_at").alias("first_committed_at"))


def floors(chain: DataFrame, rules: DataFrame, now: datetime | str, oldest_snapshot: int = 0) -> DataFrame:
    """(key, floor): the oldest version that each key with a rule keeps."""
    return collected(chain, rules, now, oldest_snapshot).where("floor IS NOT NULL").select("key", "floor")


def retain(chain: DataFrame, rules: DataFrame, now: datetime | str, oldest_snapshot: int = 0) -> DataFrame:
    """The versions of ``chain`` that retention keeps."""
    low = floors(chain, rules, now, oldest_snapshot)
    return chain.join(low, "key", "left").where(F.col("floor").isNull() | (F.col("version") >= F.col("floor"))).select(*chain.columns)


def removed(chain: DataFrame, rules: DataFrame, now: datetime | str, oldest_snapshot: int = 0) -> DataFrame:
    """(key, removed): how many versions each key loses; keys that lose none are left out."""
    gone = collected(chain, rules, now, oldest_snapshot).select("key", (F.col("versions") - F.col("kept")).alias("removed"))
    return gone.where("removed > 0")


def boundaries(chain: DataFrame, gone: DataFrame | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """(key, first_version, first_committed_at, truncated).

    ``gone``: ``removed`` of this chain. ``earlier``: boundaries from before;
    their first versions stay, and truncated stays true once it is.
    """
    first = chain.groupBy("key").agg(F.min_by(F.struct("version", "committed_at"), "version").alias("f"))
    out = first.select("key", F.col("f.version").alias("first_version"), F.col("f.committed_at").alias("first_committed_at"), F.lit(False).alias("truncated"))
    if gone is not None:
        out = out.join(gone, "key", "left").withColumn("truncated", F.coalesce(F.col("removed") > 0, F.lit(False))).drop("removed")
    return _since(out, earlier)


def boundaries_after(chain: DataFrame, rules: DataFrame, now: datetime | str, oldest_snapshot: int = 0, earlier: DataFrame | None = None) -> DataFrame:
    """``boundaries`` of ``chain`` after a collection under ``rules``, in the collection's own pass."""
    out = collected(chain, rules, now, oldest_snapshot)
    return _since(out.select("key", "first_version", "first_committed_at", (F.col("kept") < F.col("versions")).alias("truncated")), earlier)


def _since(out: DataFrame, earlier: DataFrame | None) -> DataFrame:
    if earlier is None:
        return out
    old = earlier.select("key", F.col("first_version").alias("v"), F.col("first_committed_at").alias("t"), F.col("truncated").alias("g"))
    return out.join(old, "key", "full").select("key", F.coalesce("v", "first_version").alias("first_version"), F.coalesce("t", "first_committed_at").alias("first_committed_at"), (F.coalesce("g", F.lit(False)) | F.coalesce("truncated", F.lit(False))).alias("truncated"))
