"""Queries over the session event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators import eventlog
from quillstream.plans.registry import query
from quillstream.sources.tables import read_table

_ORDER = "priority ASC NULLS LAST, created_at DESC NULLS LAST, id"
_BODY = r"""regexp_replace(CASE WHEN coalesce(length(data), 0) = 0 THEN '{}' ELSE data END, '("(?:[^"\\]|\\.)*")|\s+', '\1', 'g')"""
_STAMP = r"coalesce(octet_length(encode(regexp_replace(regexp_replace(strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f'), '0+$', ''), '\.$', ''))), 19) + 3"
_SIZE = f"""(49 + octet_length(encode(CAST(id AS VARCHAR))) + octet_length(encode(coalesce(type, ''))) + 2
  + octet_length(encode(CAST(coalesce(priority, 0) AS VARCHAR))) + octet_length(encode(body)) + 5 * (length(body) - length(translate(body, '<>&', ''))) + {_STAMP})"""
_FIRST = f"SELECT *, {_BODY} AS body, row_number() OVER (PARTITION BY session_id ORDER BY {_ORDER}) AS position FROM session_events QUALIFY position <= 512"
_USED = f"SELECT *, {_SIZE} AS wire_bytes, CAST(sum({_SIZE}) OVER (PARTITION BY session_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used_bytes FROM ({_FIRST})"
_SNAP = f"SELECT session_id, id, position, wire_bytes, used_bytes FROM ({_USED}) WHERE used_bytes <= 2048 OR (position = 1 AND priority = 1)"
_HASH = """unhex(sha256(unhex(printf('%016X', octet_length(encode(coalesce(type, ''))))) || encode(coalesce(type, ''))
  || unhex(printf('%016X', octet_length(encode(coalesce(data, ''))))) || encode(coalesce(data, ''))))"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "session_events")


@query(f"""SELECT session_id, CAST(position AS INTEGER) AS position, id FROM (SELECT e.*, row_number() OVER (PARTITION BY session_id ORDER BY {_ORDER}) AS position
  FROM session_events e WHERE session_id IN (SELECT id FROM sessions)) WHERE position <= 100""")
def events_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.read_events(_events(spark, sf_dir), read_table(spark, sf_dir, "sessions")).select("session_id", "position", "id")


@query(f"""SELECT session_id, CAST(position AS INTEGER) AS position, id, type FROM (SELECT e.*, row_number() OVER (PARTITION BY session_id ORDER BY {_ORDER}) AS position
  FROM session_events e WHERE type IN ('error_observed', 'git_operation') AND priority <= 2
  AND session_id IN (SELECT id FROM sessions WHERE namespace = 'lab-a')) WHERE position <= 20""")
def events_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = eventlog.read_events(_events(spark, sf_dir), read_table(spark, sf_dir, "sessions"), "lab-a", ["error_observed", "git_operation"], 2, 20)
    return found.select("session_id", "position", "id", "type")


@query(f"SELECT session_id, id, CAST(position AS INTEGER) AS position, CAST(wire_bytes AS BIGINT) AS wire_bytes, used_bytes FROM ({_SNAP})")
def snapshot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = eventlog.snapshots(_events(spark, sf_dir))
    return found.select("session_id", "id", "position", F.col("wire_bytes").cast("long").alias("wire_bytes"), "used_bytes")


@query(f"""SELECT t.session_id, coalesce(k.n, 0) AS event_count, coalesce(k.used, 0) AS byte_budget_used, coalesce(k.n, 0) < t.offered AS budget_exceeded
  FROM (SELECT session_id, least(count(*), 512) AS offered FROM session_events GROUP BY 1) t
  LEFT JOIN (SELECT session_id, count(*) AS n, max(used_bytes) AS used FROM ({_SNAP}) GROUP BY 1) k USING (session_id)""")
def snapshot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.snapshot_summaries(_events(spark, sf_dir))


@query(f"""SELECT id FROM (SELECT id, h, list(h) OVER (PARTITION BY session_id ORDER BY id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS recent
  FROM (SELECT *, coalesce(data_hash, {_HASH}) AS h FROM session_events)) WHERE NOT coalesce(list_contains(recent, h), false)""")
def events_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.without_recent_repeats(_events(spark, sf_dir)).select("id")


@query("""SELECT id FROM (SELECT id, count(*) OVER (PARTITION BY session_id) AS n, row_number() OVER (PARTITION BY session_id
  ORDER BY priority DESC NULLS FIRST, created_at ASC NULLS FIRST, id DESC) AS age FROM session_events) WHERE age <= n - 1000""")
def events_evicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.evicted(_events(spark, sf_dir)).select("id")


_FAULTS = """CASE WHEN s.id IS NULL THEN 1 ELSE 0 END AS unknown_session, CASE WHEN e.priority BETWEEN 1 AND 4 THEN 0 ELSE 1 END AS bad_priority,
  CASE WHEN length(coalesce(e.type, '')) BETWEEN 1 AND 64 THEN 0 ELSE 1 END AS bad_type, CASE WHEN coalesce(e.data, '') = '' OR json_valid(e.data) THEN 0 ELSE 1 END AS bad_data"""


@query(f"""SELECT batch_id, n_events, n_unknown, n_priority, n_type, n_data, n_events BETWEEN 1 AND 100 AND n_unknown + n_priority + n_type + n_data = 0 AS accepted FROM (
  SELECT batch_id, count(*) AS n_events, sum(unknown_session)::BIGINT AS n_unknown, sum(bad_priority)::BIGINT AS n_priority, sum(bad_type)::BIGINT AS n_type, sum(bad_data)::BIGINT AS n_data
  FROM (SELECT e.batch_id, {_FAULTS} FROM session_events e LEFT JOIN sessions s ON s.id = e.session_id) GROUP BY 1)""")
def events_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which delivered batches a sink takes, and why not the others: all events of a batch or none."""
    return eventlog.checked_batches(_events(spark, sf_dir), read_table(spark, sf_dir, "sessions"))


@query(f"SELECT id, lower(hex({_HASH})) AS hash, coalesce(data_hash <> {_HASH}, false) AS differs FROM session_events")
def events_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.event_hashes(_events(spark, sf_dir))


@query("""SELECT s.namespace, s.client, e.type, count(*) AS n_events, sum(CASE WHEN e.priority = 1 THEN 1 ELSE 0 END)::BIGINT AS n_urgent,
  count(DISTINCT e.session_id) AS n_sessions FROM session_events e JOIN sessions s ON s.id = e.session_id GROUP BY ROLLUP (s.namespace, s.client, e.type)""")
def events_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = read_table(spark, sf_dir, "sessions").select(F.col("id").alias("session_id"), "namespace", "client")
    joined = _events(spark, sf_dir).select("session_id", "type", "priority").join(sessions, "session_id")
    return joined.rollup("namespace", "client", "type").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(F.when(F.col("priority") == 1, 1).otherwise(0)).alias("n_urgent"), F.count_distinct("session_id").alias("n_sessions")
    )


@query("""SELECT tool, n_calls, n_failed, round(n_failed / n_calls, 6) AS failure_rate FROM (
  SELECT json_extract_string(data, '$.tool_name') AS tool, count(*) AS n_calls,
  sum(CASE WHEN TRY_CAST(json_extract_string(data, '$.exit_code') AS INTEGER) <> 0 THEN 1 ELSE 0 END)::BIGINT AS n_failed
  FROM session_events WHERE type = 'tool_invocation' AND json_valid(data) GROUP BY 1)""")
def tool_failure_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _events(spark, sf_dir).where("type = 'tool_invocation' and try_parse_json(data) is not null")
    body = calls.select(F.get_json_object("data", "$.tool_name").alias("tool"), F.expr("try_cast(get_json_object(data, '$.exit_code') as int)").alias("exit_code"))
    by = body.groupBy("tool").agg(F.count(F.lit(1)).alias("n_calls"), F.sum(F.when(F.col("exit_code") != 0, 1).otherwise(0)).alias("n_failed"))
    return by.withColumn("failure_rate", F.round(F.col("n_failed") / F.col("n_calls"), 6))


@query("""SELECT CAST(late AS BIGINT) AS late_minutes, count(*) AS n FROM (SELECT least(240, greatest(0, datediff('minute', created_at, received_at))) AS late
  FROM session_events WHERE created_at IS NOT NULL) GROUP BY 1""")
def events_lateness(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = F.expr("timestampdiff(MINUTE, date_trunc('MINUTE', created_at), date_trunc('MINUTE', received_at))")
    late = _events(spark, sf_dir).where("created_at is not null").select(F.least(F.lit(240), F.greatest(F.lit(0), minutes)).cast("long").alias("late_minutes"))
    return late.groupBy("late_minutes").agg(F.count(F.lit(1)).alias("n"))
