"""Chains in Spark SQL: views and table functions, planned by Catalyst.

    SELECT key, value FROM current WHERE key = 'user:1'
    SELECT * FROM as_of_version(5000) WHERE key = 'user:1'
    SELECT version, state FROM history('user:1') WHERE version >= 10 ORDER BY version LIMIT 5
    SELECT * FROM diff_versions('user:1', 3, 9)
    SELECT * FROM diff_mixed('user:1', NULL, TIMESTAMP '2024-01-10 00:00:00', 9, NULL)
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from ..operators.chain import PREFETCH, current

_DIFF = """RETURNS TABLE (before_state STRING, before_value BINARY, after_state STRING, after_value BINARY) RETURN
  SELECT CASE WHEN o IS NULL THEN 'MISSING' WHEN o.live THEN 'VALUE' ELSE 'DELETED' END, IF(o.live, o.value, NULL),
         CASE WHEN n IS NULL THEN 'MISSING' WHEN n.live THEN 'VALUE' ELSE 'DELETED' END, IF(n.live, n.value, NULL)
  FROM (SELECT max_by(struct(value, was_live AS live), version) FILTER (WHERE was) AS o, max_by(struct(value, is_live AS live), version) FILTER (WHERE is) AS n
        FROM (SELECT version, value, {was} AS was, {was_live} AS was_live, {is_} AS is, {is_live} AS is_live FROM chain WHERE key = k))"""
_LIVE = "NOT tombstone AND (expires_at IS NULL OR {t} < expires_at)"


def _diff(was: str, was_live: str, is_: str, is_live: str) -> str:
    return _DIFF.format(was=was, was_live=was_live, is_=is_, is_live=is_live)


FUNCTIONS = {
    "as_of_version": """(v BIGINT) RETURNS TABLE (key STRING, version BIGINT, value BINARY, state STRING) RETURN
      SELECT key, h.version, h.value, IF(h.tombstone, 'DELETED', 'VALUE')
      FROM (SELECT key, max_by(struct(version, value, tombstone), version) AS h FROM chain WHERE version <= v GROUP BY key)""",
    "as_of_timestamp": f"""(t TIMESTAMP) RETURNS TABLE (key STRING, version BIGINT, value BINARY, state STRING) RETURN
      SELECT key, h.version, IF(h.live, h.value, NULL), IF(h.live, 'VALUE', 'DELETED')
      FROM (SELECT key, max_by(struct(version, value, live), version) AS h
            FROM (SELECT key, version, value, {_LIVE.format(t="t")} AS live FROM chain WHERE committed_at <= t) GROUP BY key)""",
    "history": f"""(k STRING) RETURNS TABLE (version BIGINT, committed_at BIGINT, state STRING, value BINARY) RETURN
      SELECT version, unix_millis(committed_at), IF(tombstone, 'TOMBSTONE', 'VALUE'), value
      FROM chain WHERE key = k ORDER BY version DESC LIMIT {PREFETCH}""",
    "diff_versions": "(k STRING, a BIGINT, b BIGINT) " + _diff("version <= a", "NOT tombstone", "version <= b", "NOT tombstone"),
    "diff_timestamps": "(k STRING, a TIMESTAMP, b TIMESTAMP) " + _diff("committed_at <= a", _LIVE.format(t="a"), "committed_at <= b", _LIVE.format(t="b")),
    # Of each point either the version or the time is given, the other is null.
    "diff_mixed": "(k STRING, av BIGINT, at TIMESTAMP, bv BIGINT, bt TIMESTAMP) "
    + _diff(
        "IF(av IS NULL, committed_at <= at, version <= av)",
        f"IF(av IS NULL, {_LIVE.format(t='at')}, NOT tombstone)",
        "IF(bv IS NULL, committed_at <= bt, version <= bv)",
        f"IF(bv IS NULL, {_LIVE.format(t='bt')}, NOT tombstone)",
    ),
}


def register(chain: DataFrame, now: datetime | str) -> None:
    """Views ``chain`` and ``current``, and the table functions above, in the session of ``chain``: all or none.

    A key filter reaches the chain's scan. ``history`` reads a key's newest
    1,000 versions, as paging does. Absent keys give no rows, but for the
    diffs, which give one row of MISSING.
    """
    spark, made = chain.sparkSession, []
    try:
        chain.createOrReplaceTempView("chain")
        current(chain, now).createOrReplaceTempView("current")
        for name, body in FUNCTIONS.items():
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
            made.append(name)
    except Exception:
        for name in made:
            spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
        spark.catalog.dropTempView("current")
        spark.catalog.dropTempView("chain")
        raise
