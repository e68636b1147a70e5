"""Queries over sessions, clients and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators import sessions as ops
from quillstream.plans.registry import query
from quillstream.sources.tables import read_table, utc_micros

_AT = "2026-06-01 00:00:00"
_EXPIRY = "coalesce(expires_at, last_activity + to_minutes(least(coalesce(ttl_minutes, 120), 10080)))"


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "sessions")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "session_labels")


@query("""SELECT s.id, s.namespace, coalesce(l.n, 0) AS n_labels, l.labels FROM sessions s LEFT JOIN (
  SELECT session_id, count(*) AS n, string_agg(label_key || '=' || label_value, ';' ORDER BY label_key) AS labels
  FROM (SELECT session_id, label_key, min(label_value) AS label_value FROM session_labels WHERE label_key IS NOT NULL GROUP BY 1, 2) GROUP BY 1) l ON l.session_id = s.id""")
def sessions_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.with_labels(_sessions(spark, sf_dir), _labels(spark, sf_dir))
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("id", "namespace", F.coalesce(F.size(F.map_keys("labels")), F.lit(0)).cast("long").alias("n_labels"), F.array_join(pairs, ";").alias("labels")).withColumn("n_labels", F.greatest("n_labels", F.lit(0)))


@query("""SELECT s.id, s.namespace, s.client FROM sessions s WHERE s.id IN (SELECT session_id FROM session_labels
  WHERE (label_key = 'arm' AND label_value = 'hook') OR (label_key = 'team' AND label_value = 'retrieval') GROUP BY 1 HAVING count(DISTINCT label_key) = 2)""")
def sessions_by_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ops.labelled(_labels(spark, sf_dir), {"arm": "hook", "team": "retrieval"})
    s = _sessions(spark, sf_dir)
    return s.join(own, s["id"] == own["session_id"], "left_semi").select("id", "namespace", "client")


@query("SELECT namespace, client, count(*) AS n_sessions, epoch_us(max(last_activity)) AS last_us FROM sessions GROUP BY 1, 2")
def clients_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.clients(_sessions(spark, sf_dir)).select("namespace", "client", "n_sessions", utc_micros("last_activity").alias("last_us"))


@query(f"SELECT id, epoch_us({_EXPIRY}) AS expiry_us FROM sessions WHERE {_EXPIRY} < TIMESTAMP '{_AT}'")
def sessions_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.expired(_sessions(spark, sf_dir), F.expr(f"timestamp_ntz'{_AT}'")).select("id", utc_micros("expiry").alias("expiry_us"))


@query("""SELECT s.namespace, s.client, count(*) AS n_sessions, sum(coalesce(l.n, 0))::BIGINT AS n_labels, sum(coalesce(e.n, 0))::BIGINT AS n_events FROM sessions s
  LEFT JOIN (SELECT session_id, count(*) AS n FROM session_labels GROUP BY 1) l ON l.session_id = s.id
  LEFT JOIN (SELECT session_id, count(*) AS n FROM session_events GROUP BY 1) e ON e.session_id = s.id GROUP BY 1, 2""")
def clients_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.cascade(_sessions(spark, sf_dir), _labels(spark, sf_dir), read_table(spark, sf_dir, "session_events"))


@query("""SELECT s.id, epoch_us(greatest(s.last_activity, e.seen)) AS last_us FROM sessions s
  LEFT JOIN (SELECT session_id, max(received_at) AS seen FROM session_events GROUP BY 1) e ON e.session_id = s.id""")
def sessions_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.touched(_sessions(spark, sf_dir), read_table(spark, sf_dir, "session_events")).select("id", utc_micros("last_activity").alias("last_us"))


@query("""SELECT session_id, count(*) AS n_events, epoch_us(min(created_at)) AS start_us, epoch_us(max(created_at)) + 1800000000 AS end_us FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS span FROM (
    SELECT *, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY session_id ORDER BY created_at, id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh
    FROM session_events WHERE created_at IS NOT NULL)) GROUP BY session_id, span""")
def sessions_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = ops.activity_spans(read_table(spark, sf_dir, "session_events"))
    return spans if spark.conf.get("spark.sql.session.timeZone") == "UTC" else spans.withColumns({c: F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', cast(timestamp_micros({c}) as timestamp_ntz))") for c in ("start_us", "end_us")})


@query("""SELECT team, n_sessions, n_expired FROM (SELECT lower(trim(l.label_value)) AS team, count(DISTINCT s.id) AS n_sessions,
  sum(CASE WHEN coalesce(s.expires_at, s.last_activity + to_minutes(least(coalesce(s.ttl_minutes, 120), 10080))) < TIMESTAMP '2026-06-01' THEN 1 ELSE 0 END)::BIGINT AS n_expired
  FROM sessions s JOIN session_labels l ON l.session_id = s.id AND l.label_key = 'team' GROUP BY 1)""")
def teams_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    team = _labels(spark, sf_dir).where("label_key = 'team'").select(F.col("session_id").alias("id"), F.lower(F.trim("label_value")).alias("team"))
    joined = _sessions(spark, sf_dir).withColumn("over", ops.expiry() < F.expr("timestamp_ntz'2026-06-01 00:00:00'")).join(team, "id")
    return joined.groupBy("team").agg(F.count_distinct("id").alias("n_sessions"), F.sum(F.col("over").cast("int")).alias("n_expired"))
