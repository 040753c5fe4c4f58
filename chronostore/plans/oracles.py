"""SQL for DuckDB that gives the registered queries' rows from the same tables.

Written in another shape than the operators: correlated look-ups, ordered
aggregates and NOT EXISTS in place of blocks, carries and as-of joins.
"""

from __future__ import annotations

from .queries import ASKED, EARLY, LATER, NOW, ORDERS_THEN, RULE_ROWS, THEN, VERSION

_LOG = """log AS (
  SELECT 'user:' || user_id AS key, event_id + 1 AS version, ts AS committed_at,
         CASE event_type WHEN 'error' THEN 'TOMBSTONE' WHEN 'signup' THEN 'EXPIRE' ELSE 'PUT' END AS op,
         CASE WHEN event_type NOT IN ('error', 'signup') THEN props END AS value,
         CASE WHEN event_type = 'signup' THEN ts + INTERVAL 12 HOUR END AS deadline,
         NULL::BIGINT AS restored_from_version
  FROM events)"""


def _chain(log: str = "log", name: str = "chain") -> str:
    """An EXPIRE lives if its base, the last other operation, wrote a value and no EXPIRE up to it was late."""
    return f"""{name}_steps AS (SELECT *, lag(deadline) OVER (PARTITION BY key ORDER BY version) AS due FROM {log}),
{name}_base AS (SELECT e.key, e.version, max(b.version) AS base FROM {log} e JOIN {log} b ON b.key = e.key AND b.version <= e.version AND b.op <> 'EXPIRE' WHERE e.op = 'EXPIRE' GROUP BY ALL),
{name}_lives AS (
  SELECT x.key, x.version, b.value FROM {name}_base x JOIN {log} b ON b.key = x.key AND b.version = x.base AND b.op IN ('PUT', 'RESTORE_PUT')
  WHERE NOT EXISTS (SELECT 1 FROM {name}_steps s WHERE s.key = x.key AND s.version > x.base AND s.version <= x.version AND s.committed_at >= s.due)),
{name} AS (
  SELECT l.key, l.version, CASE WHEN l.op IN ('PUT', 'RESTORE_PUT') THEN l.value ELSE v.value END AS value,
         NOT (l.op IN ('PUT', 'RESTORE_PUT') OR v.version IS NOT NULL) AS tombstone, l.committed_at,
         CASE WHEN l.op = 'RESTORE_PUT' OR v.version IS NOT NULL THEN l.deadline END AS expires_at, l.restored_from_version,
         CASE WHEN l.op IN ('PUT', 'RESTORE_PUT') OR v.version IS NOT NULL THEN NULL WHEN l.op = 'RESTORE_TOMBSTONE' THEN 'RESTORED' WHEN l.op = 'EXPIRED_TOMBSTONE' THEN 'EXPIRED' ELSE 'DELETED' END AS tombstone_reason
  FROM {log} l LEFT JOIN {name}_lives v ON v.key = l.key AND v.version = l.version)"""


CHAIN = f"WITH {_LOG},\n{_chain()}"
_HEADS = "heads AS (SELECT * FROM chain c WHERE NOT EXISTS (SELECT 1 FROM chain d WHERE d.key = c.key AND d.version > c.version))"
HEADS = f"{CHAIN},\n{_HEADS}"
_ORDERS = "orders_log AS (SELECT 'cust:' || o_custkey AS key, o_orderkey + 1 AS version, o_orderdate AS committed_at, o_orderpriority AS value FROM orders)"
_ASKED = "asked AS (SELECT 'user:' || c_custkey AS key FROM customer)"
_RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', {n}, {s})" for p, n, s in RULE_ROWS) + ") r(prefix, max_versions, max_age_seconds))"
_RULED = f"""{_RULES},
ruled AS (SELECT key, arg_max(prefix, length(prefix)) AS prefix, arg_max(max_versions, length(prefix)) AS max_versions, arg_max(max_age_seconds, length(prefix)) AS max_age_seconds
          FROM (SELECT DISTINCT key FROM log) k JOIN rules r ON starts_with(k.key, r.prefix) GROUP BY key)"""
_SHOWN = "key, version, value, tombstone, epoch_us(committed_at) AS committed_us, epoch_us(expires_at) AS expires_us, tombstone_reason"
_LOG_SHOWN = "key, version, epoch_us(committed_at) AS committed_us, op, value, epoch_us(deadline) AS deadline_us, restored_from_version"
_LIVE = f"NOT tombstone AND (expires_at IS NULL OR TIMESTAMP '{NOW}' < expires_at)"


def _kept(snapshot: int) -> str:
    return f"""{_RULED},
ranked AS (SELECT c.*, row_number() OVER w AS rn, bool_or(committed_at < TIMESTAMP '{NOW}' - to_seconds(max_age_seconds)) OVER w AS old, max_versions FROM chain c JOIN ruled USING (key) WINDOW w AS (PARTITION BY key ORDER BY version DESC)),
pins AS (SELECT key, min(rn) AS pin FROM ranked WHERE version <= {snapshot} GROUP BY key),
kept AS (SELECT r.* FROM ranked r LEFT JOIN pins USING (key) WHERE rn = 1 OR (rn <= max_versions AND NOT old) OR rn <= pin)"""


def _point(where: str, live: str = "NOT tombstone") -> str:
    return f"SELECT key, version, CASE WHEN {live} THEN value END AS value, CASE WHEN {live} THEN 'VALUE' ELSE 'DELETED' END AS state FROM (SELECT unnest(arg_max(c, version)) FROM chain c WHERE {where} GROUP BY key)"


def _diff(old: str, new: str, chain: str) -> str:
    """Prefix and suffixes by bytes, through hexadecimal digits."""
    return f"""{chain}, o AS ({old}), n AS ({new}),
both_ AS (SELECT coalesce(o.key, n.key) AS key, coalesce(o.state, 'MISSING') AS before_state, coalesce(n.state, 'MISSING') AS after_state, o.value AS ov, n.value AS nv, hex(encode(o.value)) AS oh, hex(encode(n.value)) AS nh FROM o FULL JOIN n ON o.key = n.key),
cut AS (SELECT *, CASE WHEN oh IS NULL OR nh IS NULL OR oh = '' OR nh = '' THEN 0 ELSE coalesce(list_position(list_transform(list_zip(string_split(oh, ''), string_split(nh, '')), lambda x: x[1] IS DISTINCT FROM x[2]), true) - 1, length(oh)) // 2 END AS n FROM both_)"""


_DIFF_SHOWN = "SELECT key, before_state, after_state, n AS common_prefix, substr(ov, n + 1) AS before_suffix, substr(nv, n + 1) AS after_suffix FROM cut"
_AT = lambda v: f"SELECT key, CASE WHEN tombstone THEN NULL ELSE value END AS value, CASE WHEN tombstone THEN 'DELETED' ELSE 'VALUE' END AS state FROM (SELECT unnest(arg_max(c, version)) FROM chain c WHERE version <= {v} GROUP BY key)"
_T10 = f"TIMESTAMP '{EARLY}'"
_LEFT = lambda v: f"""SELECT s.key, a.version, CASE WHEN NOT a.tombstone THEN a.value END AS value, CASE WHEN a.key IS NULL THEN 'UNAVAILABLE' WHEN a.tombstone THEN 'DELETED' ELSE 'VALUE' END AS state
  FROM (SELECT DISTINCT key FROM chain WHERE version <= {v}) s LEFT JOIN (SELECT unnest(arg_max(k, version)) FROM kept k WHERE version <= {v} GROUP BY key) a ON s.key = a.key"""  # noqa: E731
_CUT_CHAIN = f"WITH {_LOG}, cut AS (SELECT * FROM log WHERE version <= {VERSION}),\n{_chain('cut')}"


def _one_diff(old: str, new: str) -> str:
    """Before and after of one key, by look-ups of a single row each."""
    return f"""{CHAIN}, o AS (SELECT * FROM ({old}) WHERE key = '{ASKED}'), n AS (SELECT * FROM ({new}) WHERE key = '{ASKED}')
      SELECT coalesce((SELECT state FROM o), 'MISSING') AS before_state, (SELECT value FROM o) AS before_value, coalesce((SELECT state FROM n), 'MISSING') AS after_state, (SELECT value FROM n) AS after_value"""


def _timed(at: str) -> str:
    return _point(f"committed_at <= TIMESTAMP '{at}'", f"NOT tombstone AND (expires_at IS NULL OR TIMESTAMP '{at}' < expires_at)")



_DOCS = "chain AS (SELECT source AS key, doc_id + 1 AS version, coalesce(text, '') AS value, false AS tombstone FROM documents WHERE doc_id IS NOT NULL)"
_RESTORE = f"""back AS (
  SELECT a.key, 1000000000 AS version, TIMESTAMP '{NOW}' AS committed_at, CASE WHEN c.tombstone THEN 'RESTORE_TOMBSTONE' ELSE 'RESTORE_PUT' END AS op,
         c.value, c.expires_at AS deadline, c.version AS restored_from_version
  FROM (SELECT DISTINCT key FROM asked) a JOIN chain c ON c.key = a.key AND c.version = (SELECT max(version) FROM chain d WHERE d.key = a.key AND d.version <= {VERSION}))"""
_WRITES = f"""writes AS (SELECT * FROM (VALUES ('user:1', 'PUT', 'one', NULL::TIMESTAMP), ('user:2', 'TOMBSTONE', NULL, NULL), ('user:new', 'PUT', 'new', NULL),
  ('user:3', 'EXPIRE', NULL, TIMESTAMP '2024-02-01 00:00:00'), ('user:4', 'EXPIRE', NULL, TIMESTAMP '2024-01-30 00:00:00')) w(key, op, value, deadline))"""
_GROUPS = """log AS (SELECT 'group:' || (user_id % 5) AS key, event_id + 1 AS version, ts AS committed_at,
  CASE event_type WHEN 'error' THEN 'TOMBSTONE' WHEN 'signup' THEN 'EXPIRE' ELSE 'PUT' END AS op, CASE WHEN event_type NOT IN ('error', 'signup') THEN props END AS value,
  CASE WHEN event_type = 'signup' THEN ts + INTERVAL 12 HOUR END AS deadline, NULL::BIGINT AS restored_from_version FROM events)"""
#: A run of EXPIREs alone lies between a base and the next; a running state is cheaper on long chains than look-ups for each row.
_GROUP_CHAIN = f"""WITH {_GROUPS},
runs AS (SELECT *, count(*) FILTER (WHERE op <> 'EXPIRE') OVER (PARTITION BY key ORDER BY version) AS run, lag(deadline) OVER (PARTITION BY key ORDER BY version) AS due FROM log),
chain AS (SELECT key, version, committed_at, NOT (op = 'PUT' OR (first(op) OVER w = 'PUT' AND NOT coalesce(bool_or(op = 'EXPIRE' AND coalesce(committed_at >= due, false)) OVER w, false))) AS tombstone, first(value) OVER w AS base
          FROM runs WINDOW w AS (PARTITION BY key, run ORDER BY version))"""

ORACLES: dict[str, str] = {
    "replay_chain": f"{CHAIN} SELECT {_SHOWN} FROM chain",
    "stream_replay": f"{CHAIN} SELECT {_SHOWN} FROM chain",
    "recover_snapshot_plus_log": f"{CHAIN} SELECT {_SHOWN} FROM chain",
    "current_get": f"{HEADS} SELECT key, value, version FROM heads WHERE {_LIVE}",
    "latest_version": "SELECT 'user:' || user_id AS key, max(event_id) + 1 AS version FROM events GROUP BY user_id",
    "is_current_version": f"{CHAIN} SELECT key, version, version = (SELECT max(version) FROM chain d WHERE d.key = c.key) AND expires_at <= TIMESTAMP '{NOW}' AS is_current FROM chain c WHERE expires_at IS NOT NULL",
    "ttl": f"""{HEADS}, {_ASKED} SELECT a.key, CASE WHEN h.key IS NULL OR h.tombstone OR h.expires_at <= TIMESTAMP '2024-01-30 06:00:00' THEN -2 WHEN h.expires_at IS NULL THEN -1
        ELSE greatest(0, (epoch_us(h.expires_at) - epoch_us(TIMESTAMP '2024-01-30 06:00:00')) // 1000000) END::BIGINT AS ttl FROM asked a LEFT JOIN heads h ON a.key = h.key""",
    "del_effect": f"{HEADS}, {_ASKED} SELECT DISTINCT key, CASE WHEN key IN (SELECT key FROM heads WHERE {_LIVE}) THEN 1 ELSE 0 END::BIGINT AS affected FROM asked",
    "del_rows": f"{HEADS}, {_ASKED} SELECT DISTINCT key, 1000000000::BIGINT AS version, epoch_us(TIMESTAMP '{NOW}') AS committed_us, 'TOMBSTONE' AS op, NULL::VARCHAR AS value, NULL::BIGINT AS deadline_us, NULL::BIGINT AS restored_from_version FROM asked WHERE key IN (SELECT key FROM heads WHERE {_LIVE})",
    "expire_effect": f"{HEADS}, {_ASKED} SELECT DISTINCT key, 1000000000::BIGINT AS version, epoch_us(TIMESTAMP '{NOW}') AS committed_us, 'EXPIRE' AS op, NULL::VARCHAR AS value, epoch_us(TIMESTAMP '{NOW}') + 60000000 AS deadline_us, NULL::BIGINT AS restored_from_version FROM asked WHERE key IN (SELECT key FROM heads WHERE {_LIVE})",
    "getat_version": f"{CHAIN} {_point(f'version <= {VERSION}')}",
    "getat_timestamp": CHAIN + " " + _point(f"committed_at <= TIMESTAMP '{THEN}'", f"NOT tombstone AND (expires_at IS NULL OR TIMESTAMP '{THEN}' < expires_at)"),
    "getat_timestamp_regressing": f"WITH {_ORDERS} SELECT key, max(version) AS version, arg_max(value, version) AS value, 'VALUE' AS state FROM orders_log WHERE committed_at <= TIMESTAMP '{ORDERS_THEN}' GROUP BY key",
    "validity_intervals": f"WITH {_ORDERS} SELECT a.key, a.version, epoch_us(a.committed_at) AS committed_us, min(b.version) AS next_version, epoch_us(min(b.committed_at)) AS next_committed_us FROM orders_log a LEFT JOIN orders_log b ON a.key = b.key AND b.version > a.version GROUP BY a.key, a.version, a.committed_at",
    "asof_join_versions": f"""{CHAIN} SELECT e.event_id, 'user:' || e.user_id AS key, c.version, c.value, CASE WHEN c.key IS NULL THEN 'MISSING' WHEN c.tombstone THEN 'DELETED' ELSE 'VALUE' END AS state
        FROM events e LEFT JOIN chain c ON c.key = 'user:' || e.user_id AND c.version = (SELECT max(version) FROM chain d WHERE d.key = 'user:' || e.user_id AND d.version <= e.event_id - 9) WHERE e.event_type = 'purchase'""",
    "asof_join_timestamps": f"""WITH {_ORDERS} SELECT o.o_orderkey, 'cust:' || o.o_custkey AS key, max(l.version) AS version, arg_max(l.value, l.version) AS value, CASE WHEN count(l.key) = 0 THEN 'MISSING' ELSE 'VALUE' END AS state
        FROM orders o LEFT JOIN orders_log l ON l.key = 'cust:' || o.o_custkey AND l.committed_at <= o.o_orderdate GROUP BY o.o_orderkey, o.o_custkey""",
    "history_page": f"{CHAIN} SELECT key, version, epoch_us(committed_at) // 1000 AS committed_ms, CASE WHEN tombstone THEN 'TOMBSTONE' ELSE 'VALUE' END AS state, value FROM (SELECT unnest((array_agg(c ORDER BY version DESC))[6:15], recursive := true) FROM chain c GROUP BY key)",
    "history_sql": f"""{_GROUP_CHAIN}, top AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS rn FROM chain)
        SELECT key, version, epoch_us(committed_at) // 1000 AS committed_ms, CASE WHEN tombstone THEN 'TOMBSTONE' ELSE 'VALUE' END AS state, CASE WHEN NOT tombstone THEN base END AS value
        FROM top WHERE rn <= 1000 AND version >= 2000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY version) BETWEEN 6 AND 25""",
    "diff_versions": _diff(_AT(VERSION), _AT(LATER), CHAIN) + _DIFF_SHOWN,
    "diff_timestamps": _diff(_point(f"committed_at <= {_T10}", f"NOT tombstone AND (expires_at IS NULL OR {_T10} < expires_at)"), _AT(LATER), CHAIN) + _DIFF_SHOWN,
    "diff_documents": _diff(_AT(500), _AT(1_000_000_000), f"WITH {_DOCS}") + "SELECT key, before_state, after_state, n AS common_prefix, length(oh) // 2 - n AS before_suffix, length(nh) // 2 - n AS after_suffix FROM cut",
    "restore_at": f"{CHAIN}, {_ASKED}, {_RESTORE} SELECT {_LOG_SHOWN} FROM back",
    "restore_heads": f"""{HEADS}, {_ASKED}, {_RESTORE} SELECT h.key, coalesce(b.version, h.version) AS version, CASE WHEN b.key IS NULL THEN h.value ELSE b.value END AS value, CASE WHEN b.key IS NULL THEN h.tombstone ELSE b.op = 'RESTORE_TOMBSTONE' END AS tombstone, b.restored_from_version,
        CASE WHEN b.key IS NULL THEN h.tombstone_reason WHEN b.op = 'RESTORE_TOMBSTONE' THEN 'RESTORED' END AS tombstone_reason FROM heads h LEFT JOIN back b ON h.key = b.key""",
    "expire_due": f"{HEADS} SELECT key, 1000000000 + row_number() OVER (ORDER BY expires_at, key, version) AS version, epoch_us(TIMESTAMP '{NOW}') AS committed_us, 'EXPIRED_TOMBSTONE' AS op, NULL::VARCHAR AS value, NULL::BIGINT AS deadline_us, NULL::BIGINT AS restored_from_version FROM heads WHERE NOT tombstone AND expires_at <= TIMESTAMP '{NOW}'",
    "rule_for_key": f"WITH {_LOG}, {_RULED} SELECT key, prefix, max_versions::INTEGER AS max_versions, max_age_seconds::BIGINT AS max_age_seconds FROM ruled",
    "retain": f"{CHAIN}, {_kept(VERSION)} SELECT {_SHOWN} FROM kept",
    "gc_removed": f"{CHAIN}, {_kept(VERSION)} SELECT key, count(*) AS removed FROM chain c WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.key = c.key AND k.version = c.version) GROUP BY key",
    "boundaries": f"{CHAIN}, {_kept(0)} SELECT c.key, min(c.version) AS first_version, epoch_us(arg_min(c.committed_at, c.version)) AS first_committed_us, count(*) > count(k.key) AS truncated FROM chain c LEFT JOIN kept k ON c.key = k.key AND c.version = k.version GROUP BY c.key",
    "lookup_status": f"""{CHAIN}, {_ASKED}, {_kept(0)}, points AS (SELECT key, unnest([50, {VERSION}, 1000000000])::BIGINT AS at_version FROM asked)
        SELECT p.key, p.at_version, CASE WHEN EXISTS (SELECT 1 FROM kept k WHERE k.key = p.key AND k.version <= p.at_version) THEN 'FOUND'
          WHEN EXISTS (SELECT 1 FROM chain c WHERE c.key = p.key AND c.version <= p.at_version) THEN 'HISTORY_UNAVAILABLE' ELSE 'KEY_NOT_FOUND' END AS status FROM points p""",
    "lookup_status_timestamps": f"""{CHAIN}, {_ASKED}, {_kept(0)}, points AS (SELECT key, unnest([{_T10}, TIMESTAMP '{THEN}', TIMESTAMP '{NOW}']) AS t FROM asked)
        SELECT p.key, epoch_us(p.t) AS at_us, CASE WHEN EXISTS (SELECT 1 FROM kept k WHERE k.key = p.key AND k.committed_at <= p.t) THEN 'FOUND'
          WHEN EXISTS (SELECT 1 FROM chain c WHERE c.key = p.key AND c.committed_at <= p.t) THEN 'HISTORY_UNAVAILABLE' ELSE 'KEY_NOT_FOUND' END AS status FROM points p""",
    "getat_retained": f"{CHAIN}, {_kept(0)} {_LEFT(VERSION)}",
    "diff_retained": _diff(_LEFT(VERSION), _LEFT(LATER), f"{CHAIN}, {_kept(0)}")
    + """, shown AS (SELECT *, before_state <> 'UNAVAILABLE' AND after_state <> 'UNAVAILABLE' AS ok FROM cut)
        SELECT key, before_state, after_state, CASE WHEN ok THEN n END AS common_prefix, CASE WHEN ok THEN substr(ov, n + 1) END AS before_suffix, CASE WHEN ok THEN substr(nv, n + 1) END AS after_suffix FROM shown""",
    "latest_version_asked": f"WITH {_ASKED} SELECT a.key, coalesce((SELECT max(event_id) + 1 FROM events e WHERE 'user:' || e.user_id = a.key), 0) AS version FROM asked a",
    "history_payload": f"""WITH {_DOCS}, page AS (SELECT key, value FROM chain QUALIFY row_number() OVER (PARTITION BY key ORDER BY version DESC) <= 1000)
        SELECT key, count(*) AS versions, sum(strlen(value))::BIGINT AS bytes, sum(strlen(value)) <= 16777216 AS fits FROM page GROUP BY key""",
    "txn_refused": f"WITH {_LOG}, {_WRITES} SELECT DISTINCT w.key FROM writes w WHERE EXISTS (SELECT 1 FROM log l WHERE l.key = w.key AND l.version > {VERSION})",
    "txn_ttl": f"""{CHAIN}, {_ASKED}, {_WRITES}, t AS (SELECT TIMESTAMP '2024-01-30 06:00:00' AS now), base AS (SELECT key, expires_at FROM (SELECT unnest(arg_max(c, version)) FROM chain c WHERE version <= {LATER} GROUP BY key), t WHERE NOT tombstone AND (expires_at IS NULL OR now < expires_at)),
        seen AS (SELECT key, expires_at FROM base WHERE key NOT IN (SELECT key FROM writes) UNION ALL SELECT key, NULL FROM writes WHERE op = 'PUT'
          UNION ALL SELECT b.key, w.deadline FROM base b JOIN writes w ON w.key = b.key AND w.op = 'EXPIRE', t WHERE w.deadline > now)
        SELECT a.key, CASE WHEN s.key IS NULL THEN -2 WHEN s.expires_at IS NULL THEN -1 ELSE (epoch_us(s.expires_at) - epoch_us(now)) // 1000000 END::BIGINT AS ttl FROM asked a LEFT JOIN seen s ON s.key = a.key, t""",
    "recovered_boundaries": f"""{_CUT_CHAIN}, {_kept(0)}, gone AS (SELECT key, count(*) AS n FROM chain c WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.key = c.key AND k.version = c.version) GROUP BY key)
        SELECT key, min(version) AS first_version, epoch_us(arg_min(committed_at, version)) AS first_committed_us, key IN (SELECT key FROM gone) AS truncated FROM log GROUP BY key""",
    "maintained_snapshot": f"{CHAIN}, {_kept(0)} SELECT {_SHOWN} FROM kept WHERE version <= {LATER}",
    "sql_current": f"{HEADS} SELECT key, value, version FROM heads WHERE {_LIVE}",
    "sql_as_of_version": f"{CHAIN} {_point(f'version <= {VERSION}')}",
    "sql_as_of_timestamp": f"{CHAIN} {_timed(THEN)}",
    "sql_history": f"""{CHAIN}, last AS (SELECT * FROM chain WHERE key = '{ASKED}' ORDER BY version DESC LIMIT 1000)
        SELECT version, epoch_us(committed_at) // 1000 AS committed_at, CASE WHEN tombstone THEN 'TOMBSTONE' ELSE 'VALUE' END AS state, value FROM last WHERE version >= 100 ORDER BY version LIMIT 5 OFFSET 1""",
    "sql_diff_versions": _one_diff(_point(f"version <= {VERSION}"), _point(f"version <= {LATER}")),
    "sql_diff_timestamps": _one_diff(_timed(EARLY), _timed(THEN)),
    "sql_diff_mixed": _one_diff(_point(f"version <= {VERSION}"), _timed(EARLY)),
    "txn_conflicts": f"WITH {_LOG}, {_WRITES} SELECT w.key, max(l.version) AS latest_version FROM writes w JOIN log l ON l.key = w.key WHERE l.version > {VERSION} GROUP BY w.key",
    "txn_visible": f"""{CHAIN}, {_WRITES}, base AS (SELECT key, value FROM (SELECT unnest(arg_max(c, version)) FROM chain c WHERE version <= {VERSION} GROUP BY key) WHERE {_LIVE})
        SELECT key, value FROM base WHERE key NOT IN (SELECT key FROM writes) UNION ALL SELECT key, value FROM writes WHERE op = 'PUT'
        UNION ALL SELECT b.key, b.value FROM base b JOIN writes w ON w.key = b.key AND w.op = 'EXPIRE' AND w.deadline > TIMESTAMP '{NOW}'""",
    "txn_commit": f"""{HEADS}, {_WRITES}, done AS (SELECT w.*, h.value AS old, coalesce({_LIVE}, false) AS live FROM writes w LEFT JOIN heads h ON h.key = w.key),
        after_ AS (SELECT *, op = 'PUT' OR (op = 'EXPIRE' AND live) AS lives FROM done)
        SELECT key, 1000000000::BIGINT AS version, CASE WHEN lives THEN coalesce(value, old) END AS value, NOT lives AS tombstone, epoch_us(TIMESTAMP '{NOW}') AS committed_us,
          CASE WHEN lives AND op = 'EXPIRE' THEN epoch_us(deadline) END AS expires_us, CASE WHEN NOT lives THEN 'DELETED' END AS tombstone_reason FROM after_""",
    "commit_sizes": "SELECT l_orderkey + 1 AS version, count(*) AS mutations, sum(strlen(l_returnflag))::BIGINT AS bytes FROM lineitem GROUP BY l_orderkey",
    "ack_floor": "SELECT min(v) AS floor FROM (SELECT max(event_id) + 1 AS v FROM events GROUP BY event_type)",
    "latency_percentiles": """WITH last AS (SELECT event_type AS name, round(value * 1000)::BIGINT AS value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 2048),
        s AS (SELECT name, list_sort(list(value)) AS l, count(*) AS n, sum(value)::BIGINT AS total FROM last GROUP BY name)
        SELECT name, n AS count, total AS sum, l[1] AS least, l[n] AS most, l[ceil(0.5 * n)::INT] AS p50, l[ceil(0.95 * n)::INT] AS p95, l[ceil(0.99 * n)::INT] AS p99 FROM s""",
    "sync_plan": """WITH e AS (SELECT coalesce(max(event_id + 1), 0) AS last FROM events WHERE event_id + 1 > 3000) SELECT s_suppkey AS replica, CASE WHEN s_suppkey * 60 > last THEN 'AHEAD' WHEN s_suppkey * 60 = last THEN 'INCREMENTAL' WHEN s_suppkey = 0 OR s_suppkey * 60 < 3000 THEN 'FULL' ELSE 'INCREMENTAL' END AS plan,
        CASE WHEN s_suppkey * 60 > last OR s_suppkey = 0 OR s_suppkey * 60 < 3000 THEN 0 ELSE last - s_suppkey * 60 END::BIGINT AS commits FROM supplier, e""",
    "wal_compact": f"WITH {_LOG} SELECT {_LOG_SHOWN} FROM log WHERE version > {VERSION}",
    "acl_rows": f"{HEADS} SELECT key, value FROM heads WHERE {_LIVE} AND (starts_with(key, 'user:1') OR starts_with(key, 'user:77'))",
    "tsv_cells": r"SELECT doc_id, CASE WHEN text IS NULL THEN '\N' ELSE replace(replace(replace(replace(text, '\', '\\'), chr(9), '\t'), chr(13), '\r'), chr(10), '\n') END AS cell FROM documents",
}
