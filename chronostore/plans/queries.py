"""The registered queries: each takes (spark, sf_dir) and reads whole tables.

Binary values are shown as text and times as microseconds since 1970.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binary import tsv_cell
from ..operators import chain as C
from ..operators import reductions, retention, writes
from ..operators.diff import diff
from ..operators.replay import replay
from ..schema import LOG, RULES
from ..sources.commits import Snapshots, as_commits, as_log, compact, maintain, recover, recover_boundaries
from ..sources.shared import new_path, stored
from ..sources.tables import documents_log, events_log, orders_log, table
from .views import register

NOW = "2024-01-31 00:00:00"
THEN = "2024-01-15 12:00:00"
EARLY = "2024-01-10 00:00:00"
ASKED = "user:7"
ORDERS_THEN = "1996-01-01 00:00:00"
VERSION, LATER = 4000, 8000
#: prefix, most versions, most seconds of age.
RULE_ROWS = [("", 20, 20 * 86400), ("user:1", 5, 10 * 86400), ("user:12", 3, 30 * 86400)]
WRITES = [("user:1", "PUT", b"one", None), ("user:2", "TOMBSTONE", None, None), ("user:new", "PUT", b"new", None), ("user:3", "EXPIRE", None, "2024-02-01 00:00:00"), ("user:4", "EXPIRE", None, "2024-01-30 00:00:00")]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def events_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(events_log(spark, sf_dir))


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULE_ROWS, RULES)


def write_set(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(WRITES, "key string, op string, value binary, deadline string")
    return rows.withColumn("deadline", F.col("deadline").cast("timestamp"))


def text(column: str = "value") -> Column:
    return F.col(column).cast("string").alias(column)


def micros(column: str, name: str) -> Column:
    return F.unix_micros(column).alias(name)


def shown_chain(chain: DataFrame) -> DataFrame:
    return chain.select("key", "version", text(), "tombstone", micros("committed_at", "committed_us"), micros("expires_at", "expires_us"), "tombstone_reason")


def shown_bounds(bounds: DataFrame) -> DataFrame:
    return bounds.select("key", "first_version", micros("first_committed_at", "first_committed_us"), "truncated")


def shown_log(log: DataFrame) -> DataFrame:
    return log.select("key", "version", micros("committed_at", "committed_us"), "op", text(), micros("deadline", "deadline_us"), "restored_from_version")


def asked_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers as user keys: some have events and some don't."""
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("key"))


@query
def replay_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_chain(events_chain(spark, sf_dir))


@query
def current_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.current(events_chain(spark, sf_dir), NOW).select("key", text(), "version")


@query
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.latest_version(events_chain(spark, sf_dir))


@query
def latest_version_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.latest_version(events_chain(spark, sf_dir), asked_keys(spark, sf_dir))


@query
def is_current_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = events_chain(spark, sf_dir)
    return C.is_current(chain, chain.where("expires_at IS NOT NULL").select("key", "version"), NOW)


@query
def ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ttl(events_chain(spark, sf_dir), asked_keys(spark, sf_dir), "2024-01-30 06:00:00")


@query
def del_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.affected(events_chain(spark, sf_dir), asked_keys(spark, sf_dir), NOW)


@query
def del_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_log(writes.delete(events_chain(spark, sf_dir), asked_keys(spark, sf_dir), 1_000_000_000, NOW))


@query
def expire_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_log(writes.expire(events_chain(spark, sf_dir), asked_keys(spark, sf_dir), 1_000_000_000, NOW, 60))


@query
def getat_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.as_of(events_chain(spark, sf_dir), version=VERSION).select("key", "version", text(), "state")


@query
def getat_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.as_of(events_chain(spark, sf_dir), timestamp=THEN).select("key", "version", text(), "state")


@query
def getat_timestamp_regressing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.as_of(replay(orders_log(spark, sf_dir)), timestamp=ORDERS_THEN).select("key", "version", text(), "state")


@query
def validity_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.intervals(replay(orders_log(spark, sf_dir)))
    return rows.select("key", "version", micros("committed_at", "committed_us"), "next_version", micros("next_committed_at", "next_committed_us"))


@query
def asof_join_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase's user as of 10 versions before it."""
    points = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), (F.col("event_id") - 9).alias("at_version"))
    return C.as_of_points(events_chain(spark, sf_dir), points).select("event_id", "key", "version", text(), "state")


@query
def asof_join_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer as of the midnight of every one of their orders, on a log whose clock goes back and forth."""
    points = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("key"), F.col("o_orderdate").cast("timestamp").alias("at_timestamp"))
    return C.as_of_points(replay(orders_log(spark, sf_dir)), points).select("o_orderkey", "key", "version", text(), "state")


@query
def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.history(events_chain(spark, sf_dir), 5, 10).select("key", "version", "committed_ms", "state", text())


@query
def history_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each source's page of whole texts, against the bound of a page."""
    return C.history_bytes(C.history(replay(documents_log(spark, sf_dir)), 0, 1000))


@query
def history_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of deep chains (five keys hold all events) the oldest of the newest 1,000 versions from 2,000 on."""
    log = events_log(spark, sf_dir).withColumn("key", F.concat(F.lit("group:"), (F.substring_index("key", ":", -1).cast("bigint") % 5).cast("string")))
    return C.history_where(replay(log), 2000, True, 5, 20).select("key", "version", "committed_ms", "state", text())


@query
def diff_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff(events_chain(spark, sf_dir), VERSION, LATER).select("key", "before_state", "after_state", "common_prefix", text("before_suffix"), text("after_suffix"))


@query
def diff_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff(events_chain(spark, sf_dir), EARLY, LATER).select("key", "before_state", "after_state", "common_prefix", text("before_suffix"), text("after_suffix"))


@query
def diff_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts: each source's document 500 against its newest."""
    out = diff(replay(documents_log(spark, sf_dir)), 500, 1_000_000_000)
    size = lambda c: F.octet_length(c).cast("bigint").alias(c)
    return out.select("key", "before_state", "after_state", "common_prefix", size("before_suffix"), size("after_suffix"))


@query
def restore_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_log(writes.restore_at(events_chain(spark, sf_dir), asked_keys(spark, sf_dir), VERSION, 1_000_000_000, NOW))


@query
def restore_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads after the restore, replayed from the log and its rows."""
    log = events_log(spark, sf_dir)
    back = writes.restore_at(replay(log), asked_keys(spark, sf_dir), VERSION, 1_000_000_000, NOW)
    return C.heads(replay(log.unionByName(back))).select("key", "version", text(), "tombstone", "restored_from_version", "tombstone_reason")


@query
def expire_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_log(writes.expire_due(events_chain(spark, sf_dir), NOW, 1_000_000_000))


@query
def rule_for_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.rule_for_key(events_log(spark, sf_dir), rules(spark))


@query
def retain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_chain(retention.retain(events_chain(spark, sf_dir), rules(spark), NOW, VERSION))


@query
def gc_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.removed(events_chain(spark, sf_dir), rules(spark), NOW, VERSION)


@query
def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_bounds(retention.boundaries_after(events_chain(spark, sf_dir), rules(spark), NOW))


def retained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The events' chain after a collection, and its boundaries."""
    chain = stored(events_chain(spark, sf_dir), "chain")
    return retention.retain(chain, rules(spark), NOW), stored(retention.boundaries_after(chain, rules(spark), NOW), "boundaries")


@query
def lookup_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every asked key at three versions, after retention."""
    points = asked_keys(spark, sf_dir).select("key", F.explode(F.array(*[F.lit(v).cast("bigint") for v in (50, VERSION, 1_000_000_000)])).alias("at_version"))
    return C.lookup_status(*retained(spark, sf_dir), points)


@query
def lookup_status_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every asked key at three times, after retention."""
    points = asked_keys(spark, sf_dir).select("key", F.explode(F.array(*[F.lit(t).cast("timestamp") for t in (EARLY, THEN, NOW)])).alias("at_timestamp"))
    return C.lookup_status(*retained(spark, sf_dir), points).select("key", micros("at_timestamp", "at_us"), "status")


@query
def getat_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point read that tells what retention removed from what never was."""
    chain, bounds = retained(spark, sf_dir)
    return C.as_of(chain, version=VERSION, boundaries=bounds).select("key", "version", text(), "state")


@query
def diff_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain, bounds = retained(spark, sf_dir)
    return diff(chain, VERSION, LATER, bounds).select("key", "before_state", "after_state", "common_prefix", text("before_suffix"), text("after_suffix"))


@query
def txn_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.conflicts(events_chain(spark, sf_dir), write_set(spark), VERSION)


@query
def txn_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.transaction_view(events_chain(spark, sf_dir), write_set(spark), VERSION, NOW).select("key", text())


@query
def txn_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of the written keys after the commit of the write set."""
    log = events_log(spark, sf_dir)
    rows = writes.commit(replay(log), write_set(spark), 999_999_999, 1_000_000_000, NOW)
    return shown_chain(C.heads(replay(log.unionByName(rows))).where("version = 1000000000"))


@query
def txn_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys for which a commit of the write set is refused, as the commit itself names them; none if it isn't."""
    keys: list[str] = []
    try:
        writes.commit(events_chain(spark, sf_dir), write_set(spark), VERSION, 1_000_000_000, NOW)
    except writes.TransactionConflict as e:
        keys = e.keys
    return spark.createDataFrame([(k,) for k in keys], "key string")


@query
def txn_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.transaction_ttl(events_chain(spark, sf_dir), write_set(spark), LATER, "2024-01-30 06:00:00", asked_keys(spark, sf_dir))


@query
def commit_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as mutations of their order's commit."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + 1).alias("version"), F.col("l_returnflag").cast("binary").alias("value"))
    return reductions.commit_sizes(lines)


@query
def ack_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as replicas that acknowledge the versions they saw."""
    return reductions.ack_floor(table(spark, sf_dir, "events").select(F.col("event_type").alias("replica"), (F.col("event_id") + 1).alias("version")))


@query
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("seq"), F.round(F.col("value") * 1000).cast("bigint").alias("value"))
    return reductions.latency_summary(samples)


@query
def sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as replicas at 60 times their number, against a log compacted through version 3,000."""
    replicas = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("replica"), (F.col("s_suppkey") * 60).alias("applied"))
    return reductions.sync_plan(compact(as_commits(events_log(spark, sf_dir)), 3000), replicas)


@query
def wal_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a log compacted through VERSION still has, by way of stored commits."""
    commits = stored(as_commits(events_log(spark, sf_dir)), "commits")
    return shown_log(as_log(compact(commits, VERSION)))


@query
def recover_snapshot_plus_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir)
    snapshot = stored(replay(log.where(F.col("version") <= VERSION)), "snapshot")
    return shown_chain(recover(snapshot, log, VERSION))


@query
def recovered_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries after a collection, a snapshot of what it left, and a recovery from that and the rest of the log."""
    log, shots = events_log(spark, sf_dir), Snapshots(spark)
    old = stored(replay(log.where(F.col("version") <= VERSION)), "chain")
    shots.save(retention.retain(old, rules(spark), NOW), VERSION, retention.boundaries_after(old, rules(spark), NOW))
    cut, snapshot, bounds = shots.load()
    return shown_bounds(recover_boundaries(bounds, recover(snapshot, log, cut)))


@query
def maintained_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the snapshot of a maintenance run holds: the chain after retention, as of LATER."""
    log, shots = events_log(spark, sf_dir), Snapshots(spark)
    maintain(replay(log), as_commits(log), shots, rules(spark), NOW, LATER)
    return shown_chain(shots.load().chain)


@query
def acl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reductions.acl_rows(C.current(events_chain(spark, sf_dir), NOW), ("user:1", "user:77")).select("key", text())


@query
def tsv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as cells of tab-separated text."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", tsv_cell(F.col("text")).alias("cell"))


@query
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events log in three appended parts, each replayed by a run of the same stream."""
    from ..streaming.replay import read_chain, run

    log = events_log(spark, sf_dir)
    source, out, checkpoint = (new_path(spark, f"stream-{x}") for x in ("log", "chain", "checkpoint"))
    for low, high in ((0, VERSION), (VERSION, LATER), (LATER, 1 << 62)):
        log.where((F.col("version") > low) & (F.col("version") <= high)).write.mode("append").parquet(source)
        run(spark, source, out, checkpoint).awaitTermination()
    return shown_chain(read_chain(spark, out))


def in_sql(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    register(events_chain(spark, sf_dir), NOW)
    return spark.sql(statement)


@query
def sql_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_sql(spark, sf_dir, "SELECT key, CAST(value AS STRING) AS value, version FROM current")


@query
def sql_as_of_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_sql(spark, sf_dir, f"SELECT key, version, CAST(value AS STRING) AS value, state FROM as_of_version({VERSION})")


@query
def sql_as_of_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_sql(spark, sf_dir, f"SELECT key, version, CAST(value AS STRING) AS value, state FROM as_of_timestamp(TIMESTAMP '{THEN}')")


@query
def sql_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_sql(spark, sf_dir, f"SELECT version, committed_at, state, CAST(value AS STRING) AS value FROM history('{ASKED}') WHERE version >= 100 ORDER BY version LIMIT 5 OFFSET 1")


@query
def sql_diff_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_sql(spark, sf_dir, _sql_diff(f"diff_versions('{ASKED}', {VERSION}, {LATER})"))


@query
def sql_diff_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_sql(spark, sf_dir, _sql_diff(f"diff_timestamps('{ASKED}', TIMESTAMP '{EARLY}', TIMESTAMP '{THEN}')"))


@query
def sql_diff_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_sql(spark, sf_dir, _sql_diff(f"diff_mixed('{ASKED}', {VERSION}, NULL, NULL, TIMESTAMP '{EARLY}')"))


def _sql_diff(call: str) -> str:
    return f"SELECT before_state, CAST(before_value AS STRING) AS before_value, after_state, CAST(after_value AS STRING) AS after_value FROM {call}"
