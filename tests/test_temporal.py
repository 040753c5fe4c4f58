import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from chronostore.functions.binary import after, common_prefix, tsv_cell
from chronostore.operators import chain as C
from chronostore.operators import reductions, retention, writes
from chronostore.operators.diff import diff
from chronostore.operators.replay import replay
from chronostore.plans.views import register
from chronostore.schema import CHAIN, LOG, RULES, chain_faults, log_faults
from chronostore.sources.commits import Snapshots, as_commits, as_log, compact, maintain, recover, recover_boundaries
from chronostore.sources.shared import new_path, numbered
from chronostore.streaming.replay import OutOfOrder, applied_in_order, apply_batch, install, read_chain, read_heads, run, sweep

NOW = datetime(2026, 1, 1)


def t(seconds):
    return NOW + timedelta(seconds=seconds)


def us(x):
    return None if x is None else int(x.replace(tzinfo=timezone.utc).timestamp() * 1_000_000)


def log_of(spark, rows):
    """rows: (key, version, seconds, op, value, deadline seconds, source)"""
    full = [(*r, *[None] * (7 - len(r))) for r in rows]
    return spark.createDataFrame([(k, v, t(s), op, None if x is None else bytearray(x), None if d is None else t(d), src) for k, v, s, op, x, d, src in full], LOG)


def random_rows(n, keys=5, seed=3):
    rnd, rows = random.Random(seed), []
    for v in range(1, n + 1):
        op = rnd.choice(["PUT", "PUT", "EXPIRE", "EXPIRE", "EXPIRE", "TOMBSTONE", "RESTORE_PUT", "RESTORE_TOMBSTONE", "EXPIRED_TOMBSTONE"])
        at = v * 10 + rnd.randint(-40, 40)
        value = f"v{rnd.randint(0, 9)}".encode() if op in ("PUT", "RESTORE_PUT") else None
        deadline = at + rnd.randint(-10, 60) if op == "EXPIRE" or (op == "RESTORE_PUT" and rnd.random() < 0.5) else None
        rows.append((f"k{rnd.randint(0, keys - 1)}", v, at, op, value, deadline, 1 if op.startswith("RESTORE") else None))
    return rows


def fold(head, op, at, value, deadline):
    """(tombstone, value, expires) after one mutation; ``head``: the same before it, or None."""
    if op in ("PUT", "RESTORE_PUT"):
        return False, value, deadline if op == "RESTORE_PUT" else None
    if op == "EXPIRE" and head is not None and not head[0] and (head[2] is None or at < head[2]):
        return False, head[1], deadline
    return True, None, None


def folded(rows):
    heads, out = {}, {}
    for k, v, s, op, x, d, _ in rows:
        heads[k] = fold(heads.get(k), op, s, x, d)
        out[k, v] = (heads[k][1], heads[k][0], heads[k][2])
    return out


def seen(chain):
    return {(r.key, r.version): (None if r.value is None else bytes(r.value), r.tombstone, None if r.expires_at is None else round((r.expires_at - NOW).total_seconds())) for r in chain.collect()}


@pytest.mark.parametrize("block, hot_rows", [(1, 0), (7, 0), (7, 80), (1 << 20, 1 << 20)])
def test_replay_equals_a_sequential_fold(spark, block, hot_rows):
    """In one window a key, in blocks of versions, and with some keys of either kind."""
    rows = random_rows(400)
    chain = replay(log_of(spark, rows), block=block, hot_rows=hot_rows)
    assert seen(chain) == folded(rows)
    assert chain_faults(chain).isEmpty() and log_faults(log_of(spark, rows)).isEmpty()


def test_empty_log(spark):
    chain = replay(spark.createDataFrame([], LOG))
    assert chain.count() == 0 and C.heads(chain).count() == 0 and C.intervals(chain).count() == 0
    assert retention.retain(chain, spark.createDataFrame([("", 1, 1)], RULES), NOW).count() == 0


def test_log_faults(spark):
    log = log_of(spark, [("", 1, 0, "PUT", b"x"), ("a", 0, 0, "PUT", b"x"), ("b", 2, 0, "PUT"), ("c", 3, 0, "EXPIRE"), ("d", 4, 0, "NOPE"), ("e", 5, 0, "PUT", b"x", 9), ("f", 6, 0, "RESTORE_TOMBSTONE"), ("g", 7, 0, "PUT", b""), ("g", 7, 0, "PUT", b"y")])
    assert {r.key for r in log_faults(log).collect()} == {"", "a", "b", "c", "d", "e", "f", "g"}


def test_dead_head_hides_older_versions_and_history_keeps_them(spark):
    chain = replay(log_of(spark, [("key", 1, 0, "PUT", b"v1"), ("key", 2, 0, "PUT", b"v2"), ("key", 3, 0, "TOMBSTONE")]))
    assert C.current(chain, NOW).count() == 0
    assert [r.version for r in C.history(chain).orderBy(F.desc("version")).collect()] == [3, 2, 1]
    assert C.latest_version(chain).first().version == 3


def test_time_to_live(spark):
    chain = replay(log_of(spark, [("key", 1, 0, "PUT", b"value"), ("key", 2, 0, "EXPIRE", None, 10), ("plain", 3, 0, "PUT", b"x")]))
    keys = spark.createDataFrame([("key",), ("plain",), ("none",)], "key string")
    at = lambda s: {r.key: r.ttl for r in C.ttl(chain, keys, t(s)).collect()}
    assert at(0) == {"key": 10, "plain": -1, "none": -2} and at(9.5)["key"] == 0 and at(10)["key"] == -2
    assert C.is_current(chain, chain.select("key", "version"), t(10)).where("is_current").select("version").first()[0] == 2


def test_points_with_a_clock_that_goes_back(spark):
    chain = replay(log_of(spark, [("k", 1, 0, "PUT", b"a"), ("k", 2, 3, "PUT", b"b"), ("k", 3, 1, "PUT", b"c")]))
    get = lambda s: C.as_of(chain, timestamp=t(s)).first()
    assert get(2).version == 3 and get(0).version == 1 and get(5).version == 3 and get(-1) is None
    with pytest.raises(ValueError):
        C.as_of(chain)


@pytest.mark.parametrize("width, hot_rows", [(5, 0), (5, 60), (1 << 40, 1 << 20)])
def test_as_of_joins_equal_look_ups(spark, width, hot_rows):
    rows = random_rows(300, seed=8)
    want, chain = folded(rows), replay(log_of(spark, rows))
    asked = [(f"k{i % 6}", i * 7 % 330, i) for i in range(60)]
    points = spark.createDataFrame([*asked, (None, None, -1), asked[0]], "key string, at_version bigint, value bigint")
    got = C.as_of_points(chain, points.withColumnRenamed("value", "id"), width, hot_rows)
    by_version = {r.id: (r.version, r.state) for r in got.collect()}
    assert got.count() == 62 and by_version[-1] == (None, "MISSING")
    times = spark.createDataFrame([(k, t(v * 10), i) for k, v, i in asked], "key string, at_timestamp timestamp, id bigint")
    by_time = {r.id: (r.version, r.state) for r in C.as_of_points(chain, times, width, hot_rows).collect()}
    for k, v, i in asked:
        low = max((x[1] for x in rows if x[0] == k and x[1] <= v), default=None)
        assert by_version[i] == (low, "MISSING" if low is None else "DELETED" if want[k, low][1] else "VALUE")
        low = max((x[1] for x in rows if x[0] == k and x[2] <= v * 10), default=None)
        state = "MISSING" if low is None else "DELETED" if want[k, low][1] or (want[k, low][2] is not None and v * 10 >= want[k, low][2]) else "VALUE"
        assert by_time[i] == (low, state)


@pytest.mark.parametrize("block, hot_rows", [(3, 0), (1 << 20, 1 << 20)])
def test_intervals(spark, block, hot_rows):
    rows = random_rows(120, seed=5)
    got = {(r.key, r.version): (r.next_version, r.next_committed_at) for r in C.intervals(replay(log_of(spark, rows)), block, hot_rows).collect()}
    for k, v, *_ in rows:
        later = [x for x in rows if x[0] == k and x[1] > v]
        assert got[k, v] == (min((x[1] for x in later), default=None), min((t(x[2]) for x in later), default=None))


def test_history_pages(spark):
    chain = replay(log_of(spark, [("k", v, v, "PUT", str(v).encode()) for v in range(1, 1501)]))
    versions = lambda df: sorted(r.version for r in df.collect())
    assert versions(C.history(chain, 1498, 10)) == [1, 2] and versions(C.history(chain, 2000, 10)) == []
    assert versions(C.history_where(chain, ascending=True, limit=1)) == [501]  # the newest 1,000 begin there
    assert versions(C.history_where(chain, least=1490, offset=2, limit=3)) == [1496, 1497, 1498]
    with pytest.raises(ValueError):
        C.history(chain, 0, 1001)


def test_diff(spark):
    rows = [("p", 1, 0, "PUT", b"prefix-old"), ("p", 2, 1, "PUT", b"prefix-new"), ("gone", 1, 0, "PUT", b"x"), ("gone", 2, 1, "TOMBSTONE"), ("late", 2, 1, "PUT", "é".encode()), ("same", 1, 0, "PUT", b"ab")]
    got = {r.key: tuple(bytes(x) if isinstance(x, bytearray | bytes) else x for x in r[1:]) for r in diff(replay(log_of(spark, rows)), 1, 2).collect()}
    assert got["p"] == ("VALUE", "VALUE", 7, b"old", b"new")
    assert got["gone"] == ("VALUE", "DELETED", 0, b"x", None) and got["late"] == ("MISSING", "VALUE", 0, None, "é".encode())
    assert got["same"] == ("VALUE", "VALUE", 2, b"", b"")
    assert {r.key for r in diff(replay(log_of(spark, rows)), t(1), 1).where("common_prefix = 7").collect()} == {"p"}


def test_byte_functions(spark):
    rnd = random.Random(1)
    pairs = [(b"", b""), (b"\xff\x00", b"\xff\x01"), ("é".encode(), "è".encode()), (None, b"a"), (b"a" * 70_000, b"a" * 69_999 + b"b")]
    pairs += [(x := bytes(rnd.choices(b"ab", k=rnd.randint(0, 9))), x[: rnd.randint(0, 9)] + b"b") for _ in range(40)]
    df = spark.createDataFrame([(i, *[None if x is None else bytearray(x) for x in p]) for i, p in enumerate(pairs)], "i int, a binary, b binary")
    for r in df.select("i", common_prefix(F.col("a"), F.col("b")).alias("n"), after(F.col("a"), common_prefix(F.col("a"), F.col("b"))).alias("rest")).collect():
        a, b = pairs[r.i]
        n = next((k for k, (x, y) in enumerate(zip(a or b"", b or b"")) if x != y), min(len(a or b""), len(b or b"")))
        assert r.n == n and (r.rest is None if a is None else bytes(r.rest) == a[n:])
    cells = spark.createDataFrame([(bytearray(b"a\tb\\c\r\n"),), (bytearray(b"\xff\x00"),), (None,), (bytearray(b""),)], "v binary")
    assert [r[0] for r in cells.select(tsv_cell(F.col("v"))).collect()] == ["a\\tb\\\\c\\r\\n", "base64:/wA=", "\\N", ""]


def test_restore_keeps_provenance_and_deadline(spark):
    log = log_of(spark, [("k", 1, 0, "PUT", b"first"), ("k", 3, 1, "EXPIRE", None, 60), ("k", 4, 2, "PUT", b"second"), ("dead", 2, 0, "TOMBSTONE")])
    keys = spark.createDataFrame([("k",), ("dead",), ("none",)], "key string")
    back = writes.restore_at(replay(log), keys, 3, 9, t(5))
    chain = replay(log.unionByName(back))
    heads = {r.key: r for r in C.heads(chain).collect()}
    assert (heads["k"].version, bytes(heads["k"].value), heads["k"].restored_from_version, heads["k"].expires_at) == (9, b"first", 3, t(60))
    assert (heads["dead"].tombstone, heads["dead"].tombstone_reason, heads["dead"].restored_from_version) == (True, "RESTORED", 2) and "none" not in heads


def test_expiry_sweep(spark):
    log = log_of(spark, [("b", 1, 0, "PUT", b"x"), ("b", 2, 0, "EXPIRE", None, 5), ("a", 3, 0, "PUT", b"x"), ("a", 4, 0, "EXPIRE", None, 5), ("kept", 5, 0, "PUT", b"x"), ("kept", 6, 0, "EXPIRE", None, 1), ("kept", 7, 0.5, "PUT", b"y")])
    due = writes.expire_due(replay(log), t(5), 7)
    assert sorted((r.version, r.key, r.op) for r in due.collect()) == [(8, "a", "EXPIRED_TOMBSTONE"), (9, "b", "EXPIRED_TOMBSTONE")]
    assert C.heads(replay(log.unionByName(due))).where("tombstone_reason = 'EXPIRED'").count() == 2


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"), (F.col("id") % 3).alias("y"))
    rows = [(r.x, r.nth) for r in numbered(df, "x", "y").collect()]
    assert [n for _, n in sorted(rows)] == list(range(1, 1001))


def test_retention(spark):
    day = 86400
    rows = [("users:1", v, -(4 - v) * day, "PUT", b"x") for v in (1, 2, 3)] + [("cache:1", v, -(7 - v) * day, "PUT", b"x") for v in (4, 5, 6)]
    chain = replay(log_of(spark, rows))
    rules = spark.createDataFrame([("", 1, day), ("users:", 2, 10 * day)], RULES)
    kept = retention.retain(chain, rules, NOW, 5)
    assert sorted((r.key, r.version) for r in kept.collect()) == [("cache:1", 5), ("cache:1", 6), ("users:1", 2), ("users:1", 3)]
    gone = retention.removed(chain, rules, NOW, 5)
    assert {r.key: r.removed for r in gone.collect()} == {"users:1": 1, "cache:1": 1}
    low = retention.boundaries(chain, gone)
    points = spark.createDataFrame([("users:1", 1), ("users:1", 2), ("users:1", 0), ("none", 5)], "key string, at_version bigint")
    status = {(r.key, r.at_version): r.status for r in C.lookup_status(kept, low, points).collect()}
    assert status == {("users:1", 1): "HISTORY_UNAVAILABLE", ("users:1", 2): "FOUND", ("users:1", 0): "KEY_NOT_FOUND", ("none", 5): "KEY_NOT_FOUND"}
    again = {r.key: (r.first_version, r.truncated) for r in retention.boundaries(kept, earlier=low).collect()}
    assert again == {"users:1": (1, True), "cache:1": (4, True)}


def test_retention_keeps_what_an_open_snapshot_reads(spark):
    rows = [("key", v, -(7 - v) * 86400, "PUT", b"x") for v in range(1, 7)]
    kept = retention.retain(replay(log_of(spark, rows)), spark.createDataFrame([("", 1, 3600)], RULES), NOW, 3)
    assert sorted(r.version for r in kept.collect()) == [3, 4, 5, 6]


def test_longest_prefix_rules(spark):
    keys = spark.createDataFrame([("users:admin:1",), ("users:2",), ("x",), ("us",)], "key string")
    rules = spark.createDataFrame([("", 1, 1), ("users:", 2, 2), ("users:admin:", 3, 3)], RULES)
    assert {r.key: r.max_versions for r in retention.rule_for_key(keys, rules).collect()} == {"users:admin:1": 3, "users:2": 2, "x": 1, "us": 1}


def test_transactions(spark):
    log = log_of(spark, [("shared", 1, 0, "PUT", b"before"), ("other", 2, 0, "PUT", b"o"), ("shared", 3, 1, "PUT", b"outside")])
    chain = replay(log)
    own = spark.createDataFrame([("shared", "PUT", bytearray(b"mine"), None), ("other", "EXPIRE", None, t(-1)), ("new", "PUT", bytearray(b"n"), None)], "key string, op string, value binary, deadline timestamp")
    assert [tuple(r) for r in writes.conflicts(chain, own, 2).collect()] == [("shared", 3)] and writes.conflicts(chain, own, 3).isEmpty()
    assert {r.key: bytes(r.value) for r in writes.transaction_view(chain, own, 2, NOW).collect()} == {"shared": b"mine", "new": b"n"}
    none = own.where("false")
    assert {r.key: bytes(r.value) for r in writes.transaction_view(chain, none, 2, NOW).collect()} == {"shared": b"before", "other": b"o"}
    rows = writes.commit(chain, own, 3, 4, NOW)
    assert {r.version for r in rows.collect()} == {4} and writes.commit(chain, none, 0, 4, NOW).isEmpty()
    assert writes.write_set_faults(own).isEmpty()
    many = spark.range(4097).select(F.col("id").cast("string").alias("key"), F.lit("TOMBSTONE").alias("op"), F.lit(None).cast("binary").alias("value"), F.lit(None).cast("timestamp").alias("deadline"))
    assert {r.fault for r in writes.write_set_faults(many.unionByName(many)).collect()} == {"too many writes", "key written twice"}


def test_the_first_committer_wins(spark):
    """Two transactions from one snapshot stage one key: the second is refused as a whole and nothing of it is committed."""
    log = log_of(spark, [("shared", 1, 0, "PUT", b"before")])
    staged = lambda key, value: spark.createDataFrame([("shared", "PUT", bytearray(value), None), (key, "PUT", bytearray(value), None)], "key string, op string, value binary, deadline timestamp")
    after_first = log.unionByName(writes.commit(replay(log), staged("a", b"first"), 1, 2, NOW))
    with pytest.raises(writes.TransactionConflict) as refused:
        writes.commit(replay(after_first), staged("b", b"second"), 1, 3, NOW)
    assert refused.value.keys == ["shared"]
    assert {r.key: bytes(r.value) for r in C.current(replay(after_first), NOW).collect()} == {"shared": b"first", "a": b"first"}


def test_a_staged_restore_keeps_its_source(spark):
    log = log_of(spark, [("k", 1, 0, "PUT", b"first"), ("k", 2, 0, "PUT", b"second"), ("dead", 3, 0, "TOMBSTONE")])
    keys = spark.createDataFrame([("k",), ("dead",)], "key string")
    staged = writes.restore_at(replay(log), keys, 1, 99, NOW).unionByName(writes.restore_at(replay(log), keys.where("key = 'dead'"), 3, 99, NOW))
    rows = writes.commit(replay(log), staged.select("key", "op", "value", "deadline", "restored_from_version"), 3, 4, NOW)
    assert log_faults(log.unionByName(rows)).isEmpty() and {r.key: r.restored_from_version for r in rows.collect()} == {"k": 1, "dead": 3}


def test_time_to_live_inside_a_transaction(spark):
    chain = replay(log_of(spark, [("a", 1, 0, "PUT", b"x"), ("a", 2, 0, "EXPIRE", None, 100), ("b", 3, 0, "PUT", b"x"), ("c", 4, 0, "PUT", b"x"), ("c", 5, 0, "EXPIRE", None, 50)]))
    own = spark.createDataFrame([("a", "EXPIRE", None, t(30)), ("c", "PUT", bytearray(b"new"), None), ("d", "RESTORE_PUT", bytearray(b"r"), t(9)), ("e", "RESTORE_PUT", bytearray(b"r"), t(0))], "key string, op string, value binary, deadline timestamp")
    keys = spark.createDataFrame([(k,) for k in "abcdef"], "key string")
    assert {r.key: r.ttl for r in writes.transaction_ttl(chain, own, 5, NOW, keys).collect()} == {"a": 30, "b": -1, "c": -1, "d": 9, "e": -2, "f": -2}


def test_three_absences(spark):
    """Deleted, never there, and no longer retained are told apart by point reads, diffs and restores."""
    chain = replay(log_of(spark, [("profile", 2, 0, "PUT", b"one"), ("profile", 3, 1, "TOMBSTONE"), ("profile", 4, 2, "PUT", b"two"), ("late", 5, 3, "PUT", b"x")]))
    rules = spark.createDataFrame([("", 1, 10**6)], RULES)
    bounds = retention.boundaries_after(chain, rules, t(9))
    kept = retention.retain(chain, rules, t(9))
    state = lambda c, **p: {r.key: r.state for r in C.as_of(c, **p).collect()}
    assert state(chain, version=3) == {"profile": "DELETED"} and state(chain, version=1, boundaries=bounds) == {}
    assert state(kept, version=3, boundaries=bounds) == {"profile": "UNAVAILABLE"} and state(kept, timestamp=t(1), boundaries=bounds) == {"profile": "UNAVAILABLE"}
    assert state(kept, version=1, boundaries=bounds) == {} and state(kept, version=5, boundaries=bounds) == {"profile": "VALUE", "late": "VALUE"}
    got = {r.key: tuple(r)[1:] for r in diff(kept, 3, 5, bounds).collect()}
    assert got["profile"][:3] == ("UNAVAILABLE", "VALUE", None) and got["profile"][4] is None and got["late"][:3] == ("MISSING", "VALUE", 0)
    keys = spark.createDataFrame([("profile",), ("late",)], "key string")
    assert writes.restore_at(kept, keys, 3, 9, t(9)).isEmpty()
    points = keys.select("key", F.lit(3).cast("bigint").alias("at_version"))
    assert {r.key: r.status for r in C.lookup_status(kept, bounds, points).collect()} == {"profile": "HISTORY_UNAVAILABLE", "late": "KEY_NOT_FOUND"}


def test_latest_version_of_absent_keys_is_zero(spark):
    chain = replay(log_of(spark, [("k", 7, 0, "PUT", b"x")]))
    keys = spark.createDataFrame([("k",), ("none",)], "key string")
    assert {r.key: r.version for r in C.latest_version(chain, keys).collect()} == {"k": 7, "none": 0}


def test_chain_faults(spark):
    good = ("k", 1, bytearray(b"x"), False, NOW, None, None, None)
    bad = [(None, *good[1:]), ("a", 0, *good[2:]), ("b", 1, None, *good[3:]), ("c", 1, *good[2:4], None, *good[5:]), ("d", 1, None, True, NOW, None, None, None), ("e", 2, *good[2:6], 2, None), ("f", *good[1:]), ("f", *good[1:])]
    assert sorted(r.key or "" for r in chain_faults(spark.createDataFrame([good, *bad], CHAIN)).collect()) == ["", "a", "b", "c", "d", "e", "f"]


def test_history_bytes(spark):
    chain = replay(log_of(spark, [("k", 1, 0, "PUT", b"abc"), ("k", 2, 0, "TOMBSTONE"), ("k", 3, 0, "PUT", "é".encode()), ("big", 4, 0, "PUT", bytes(9 << 20)), ("big", 5, 0, "PUT", bytes(8 << 20))]))
    assert {r.key: (r.versions, r.bytes, r.fits) for r in C.history_bytes(C.history(chain)).collect()} == {"k": (3, 5, True), "big": (2, 17 << 20, False)}


def test_deletes_touch_visible_keys_only(spark):
    chain = replay(log_of(spark, [("a", 1, 0, "PUT", b"x"), ("b", 2, 0, "TOMBSTONE")]))
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    assert {r.key: r.affected for r in writes.affected(chain, keys, NOW).collect()} == {"a": 1, "b": 0, "c": 0}
    assert [r.key for r in writes.delete(chain, keys, 3, NOW).collect()] == ["a"]
    assert writes.expire(chain, keys, 3, NOW, 0).first().deadline == NOW
    with pytest.raises(ValueError):
        writes.expire(chain, keys, 3, NOW, -1)


def test_commits_snapshots_and_recovery(spark):
    rows = random_rows(200, seed=11)
    log = log_of(spark, rows)
    commits = as_commits(log)
    assert as_log(commits).exceptAll(log).isEmpty() and compact(commits, 150).count() == 50
    shots = Snapshots(spark, new_path(spark, "snapshots"))
    assert shots.load() is None and shots.safe_compaction() == 0
    for cut in (50, 90, 130):
        shots.save(replay(log.where(F.col("version") <= cut)), cut)
    assert shots.versions() == [130, 90] and shots.safe_compaction() == 90
    cut, snapshot, bounds = shots.load()
    chain = recover(snapshot, log, cut)
    assert seen(chain) == folded(rows)
    firsts = {r.key: r.first_version for r in recover_boundaries(bounds, chain).collect()}
    assert firsts == {k: min(r[1] for r in rows if r[0] == k) for k in {r[0] for r in rows}}


@pytest.mark.parametrize("harm", ["cut short", "one file gone", "no totals"])
def test_a_broken_newest_snapshot_is_passed_over(spark, harm):
    rows = random_rows(120, seed=12)
    log = log_of(spark, rows)
    shots = Snapshots(spark, new_path(spark, "snapshots"))
    for cut in (40, 80):
        shots.save(replay(log.where(F.col("version") <= cut)).repartition(3), cut)
    folder = f"{shots.path}/cut=80/{'totals' if harm == 'no totals' else 'chain'}"
    name = next(f for f in sorted(os.listdir(folder)) if f.endswith(".parquet"))
    if harm == "cut short":
        with open(f"{folder}/{name}", "r+b") as f:
            f.truncate(100)
        os.remove(f"{folder}/.{name}.crc")
    else:
        os.remove(f"{folder}/{name if harm == 'one file gone' else '_SUCCESS'}")
    cut, snapshot, _ = shots.load()
    assert cut == 40 and seen(recover(snapshot, log, cut)) == folded(rows)
    if harm != "no totals":
        with pytest.raises(ValueError):
            shots.read(80)


def test_maintenance(spark):
    """Retention, a snapshot with its boundaries, and a log that still reaches back to the older of two snapshots."""
    rows = [("k", v, v, "PUT", str(v).encode()) for v in range(1, 31)]
    log, shots = log_of(spark, rows), Snapshots(spark)
    rules = spark.createDataFrame([("", 4, 10**6)], RULES)
    first = maintain(replay(log.where("version <= 10")), as_commits(log), shots, rules, t(99), 10)
    assert first.compacted_through == 0 and first.commits.count() == 30 and first.chain.count() == 4
    chain = recover(first.chain, log.where("version <= 20"), 10)
    second = maintain(chain, first.commits, shots, rules, t(99), 20, earlier=first.boundaries)
    assert second.compacted_through == 10 and second.commits.agg(F.min("version")).first()[0] == 11
    cut, snapshot, bounds = shots.load()
    assert cut == 20 and sorted(r.version for r in snapshot.collect()) == [17, 18, 19, 20]
    assert [(r.first_version, r.truncated) for r in bounds.collect()] == [(1, True)]
    whole = recover(snapshot, as_log(second.commits), cut)
    assert sorted(r.version for r in whole.collect()) == list(range(17, 31)) and recover_boundaries(bounds, whole).first().truncated


def test_sync_plan_and_floor(spark):
    log = log_of(spark, [("k", v, v, "PUT", b"x") for v in (1, 2, 5, 6, 7)])
    replicas = spark.createDataFrame([("new", 0), ("old", 2), ("near", 5), ("level", 7), ("ahead", 8)], "replica string, applied bigint")
    assert {r.replica: (r.plan, r.commits) for r in reductions.sync_plan(log, replicas).collect()} == {"new": ("FULL", 0), "old": ("FULL", 0), "near": ("INCREMENTAL", 2), "level": ("INCREMENTAL", 0), "ahead": ("AHEAD", 0)}
    acks = spark.createDataFrame([("a", 7), ("b", 4), ("b", 6)], "replica string, version bigint")
    assert reductions.ack_floor(acks).first()[0] == 6 and reductions.ack_floor(acks.where("false")).first()[0] is None


def test_latency_summary_is_nearest_rank(spark):
    rows = [("x", i, v) for i, v in enumerate((1, 2, 100))] + [("y", i, i) for i in range(3000)]
    got = {r.name: r for r in reductions.latency_summary(spark.createDataFrame(rows, "name string, seq bigint, value bigint")).collect()}
    assert (got["x"].p50, got["x"].p95, got["x"].sum) == (2, 100, 103) and (got["y"].count, got["y"].least) == (2048, 952) if not callable(got["y"].count) else got["y"]["count"] == 2048


def test_acl_rows(spark):
    df = spark.createDataFrame([("public:1",), ("private:1",)], "key string")
    assert reductions.acl_rows(df, ("public:",)).count() == 1 and reductions.acl_rows(df, ()).count() == 0


def test_stream_equals_batch(spark):
    rows = random_rows(240, seed=21)
    log = log_of(spark, rows)
    source, out, checkpoint = (new_path(spark, x) for x in ("log", "chain", "checkpoint"))
    for low in (0, 80, 160):
        log.where((F.col("version") > low) & (F.col("version") <= low + 80)).write.mode("append").parquet(source)
        run(spark, source, out, checkpoint).awaitTermination()
    log.where("version <= 80").write.mode("append").parquet(source)  # comes twice
    run(spark, source, out, checkpoint).awaitTermination()
    got = read_chain(spark, out)
    assert got.schema == spark.createDataFrame([], CHAIN).schema and seen(got) == folded(rows) and got.count() == 240
    assert seen(read_heads(spark, out)) == seen(C.heads(replay(log)))


def test_a_stream_refuses_gaps_and_rows_that_come_too_late(spark):
    """Nothing is dropped in silence, and what was refused leaves the state as it was."""
    log = log_of(spark, [("k", v, v, "PUT", str(v).encode()) for v in range(1, 8)])
    out = new_path(spark, "chain")
    apply_batch(out, log.where("version IN (1, 2)"), 0)
    for refused in ("version = 4", "version >= 5", "version IN (3, 5)"):
        with pytest.raises(OutOfOrder):
            apply_batch(out, log.where(refused), 1)
    assert read_chain(spark, out).count() == 2
    apply_batch(out, log.where("version IN (2, 3)"), 1)
    apply_batch(out, log.where("version IN (2, 3)"), 1)  # the same batch tried again
    apply_batch(out, log.where("version = 6"), 2, contiguous=False)
    assert sorted(r.version for r in read_chain(spark, out).collect()) == [1, 2, 3, 6]
    with pytest.raises(OutOfOrder):
        apply_batch(out, log.where("version = 5"), 3, contiguous=False)
    apply_batch(out, log.where("version IN (1, 6)"), 3)
    assert read_chain(spark, out).count() == 4
    with pytest.raises(ValueError):
        install(replay(log), out)


def test_a_stream_follows_on_from_a_snapshot(spark):
    rows = random_rows(120, seed=5)
    log, out = log_of(spark, rows), new_path(spark, "chain")
    assert install(replay(log.where("version <= 70")), out) == 70
    apply_batch(out, log.where("version > 70"), 0)
    assert seen(read_chain(spark, out)) == folded(rows)


def test_active_expiration(spark):
    log = log_of(spark, [("a", 1, 0, "PUT", b"x"), ("a", 2, 0, "EXPIRE", None, 5), ("b", 3, 0, "PUT", b"y")])
    source, out, checkpoint = (new_path(spark, x) for x in ("log", "chain", "checkpoint"))
    log.write.parquet(source)
    run(spark, source, out, checkpoint).awaitTermination()
    assert sweep(spark, out, source, t(4)) == 0 and sweep(spark, out, source, t(5)) == 1 and sweep(spark, out, source, t(5)) == 1
    run(spark, source, out, checkpoint).awaitTermination()
    got = {r.key: (r.version, r.tombstone_reason) for r in read_heads(spark, out).collect()}
    assert got == {"a": (4, "EXPIRED"), "b": (3, None)} and sweep(spark, out, source, t(9)) == 0


def test_replicas_refuse_gaps(spark):
    rows = spark.range(5, 8).select(F.col("id").alias("version"))
    assert applied_in_order(4, rows) == 7 and applied_in_order(4, rows.where("false")) == 4
    for applied in (3, 5, 9):
        with pytest.raises(OutOfOrder):
            applied_in_order(applied, rows)


def test_sql_views(spark):
    register(replay(log_of(spark, [("k", v, v, "PUT", f"v{v}".encode()) for v in (1, 2, 3)] + [("d", 4, 4, "TOMBSTONE")])), t(9))
    one = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    assert one("SELECT key, CAST(value AS STRING) FROM current WHERE key = 'k'") == [("k", "v3")]
    assert one("SELECT version, state FROM history('k') WHERE version >= 2 ORDER BY version LIMIT 1") == [(2, "VALUE")]
    assert one("SELECT state FROM as_of_version(4) WHERE key = 'd'") == [("DELETED",)]
    assert one("SELECT version FROM as_of_timestamp(TIMESTAMP '2026-01-01 00:00:02') WHERE key = 'k'") == [(2,)]
    assert one("SELECT before_state, after_state FROM diff_versions('k', 1, 3)") == [("VALUE", "VALUE")] and one("SELECT before_state FROM diff_versions('none', 1, 3)") == [("MISSING",)]
    assert one("SELECT before_state, after_state FROM diff_versions('d', 3, 4)") == [("MISSING", "DELETED")]
    assert one("SELECT CAST(after_value AS STRING) FROM diff_timestamps('k', TIMESTAMP '2026-01-01 00:00:00', TIMESTAMP '2026-01-01 00:00:02')") == [("v2",)]
    assert one("SELECT before_state, CAST(after_value AS STRING) FROM diff_mixed('k', NULL, TIMESTAMP '2025-01-01 00:00:00', 1, NULL)") == [("MISSING", "v1")]
    assert one("SELECT count(*) FROM as_of_version(0)") == [(0,)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_filters_reach_the_scan_and_one_point_costs_one_shuffle(spark):
    path = new_path(spark, "chain")
    replay(log_of(spark, random_rows(50))).write.parquet(path)
    plan = plan_of(C.as_of(spark.read.parquet(path), version=9))
    assert "LessThanOrEqual(version,9)" in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name, shuffles, scans", [("replay", 1, 1), ("heads", 1, 1), ("intervals", 1, 1), ("as_of_points", 2, 1), ("diff", 1, 1), ("boundaries", 1, 1), ("retain", 2, 2)])
def test_rows_are_shuffled_once(spark, name, shuffles, scans):
    """Without hot keys: one shuffle and one scan, but where two tables meet."""
    path = new_path(spark, "log")
    log_of(spark, random_rows(50)).write.parquet(path)
    chain = replay(spark.read.parquet(path))
    rules = spark.createDataFrame([("", 1, 1), ("k1", 2, 2)], RULES)
    points = spark.createDataFrame([("k1", NOW)], "key string, at_timestamp timestamp")
    df = {
        "replay": lambda: chain,
        "heads": lambda: C.heads(chain),
        "intervals": lambda: C.intervals(chain),
        "as_of_points": lambda: C.as_of_points(chain, points),
        "diff": lambda: diff(chain, 10, 20),
        "boundaries": lambda: retention.boundaries_after(chain, rules, NOW),
        "retain": lambda: retention.retain(chain, rules, NOW),
    }[name]()
    plan = plan_of(df)
    assert plan.count("Exchange hashpartitioning(key") <= shuffles and plan.count("FileScan") == scans, plan


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from chronostore.sources import shared

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(RuntimeError):
        shared.shared_folder(Cluster)
