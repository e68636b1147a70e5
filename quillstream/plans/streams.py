"""Queries that run as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.plans.registry import query
from quillstream.sources.tables import table_path
from quillstream.streaming import events as S


@query("""SELECT type, strftime(received_at, '%Y-%m-%d') AS day, count(*) AS n_events, max(priority) AS lowest FROM session_events GROUP BY 1, 2""")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drained(S.daily_counts(S.table_stream(spark, table_path(sf_dir, "session_events"))), "daily-counts", "complete")


_HASH = """coalesce(data_hash, unhex(sha256(unhex(printf('%016X', octet_length(encode(coalesce(type, ''))))) || encode(coalesce(type, ''))
  || unhex(printf('%016X', octet_length(encode(coalesce(data, ''))))) || encode(coalesce(data, '')))))"""


@query(f"SELECT DISTINCT session_id, type, lower(hex({_HASH})) AS message FROM session_events")
def stream_first_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message once: the stream holds back what is repeated within its delay, a last pass what came again later."""
    once = S.first_deliveries(S.table_stream(spark, table_path(sf_dir, "session_events")))
    return S.drained(once.select("session_id", "type", F.lower(F.hex("data_hash")).alias("message")), "first-deliveries").distinct()


@query("""SELECT session_id, count(*) AS n_events, epoch_us(min(created_at)) AS start_us, epoch_us(max(created_at)) + 1800000000 AS end_us FROM (
  SELECT session_id, created_at, sum(fresh) OVER (PARTITION BY session_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS span FROM (
    SELECT *, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY session_id ORDER BY created_at, id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh
    FROM session_events WHERE created_at IS NOT NULL)) GROUP BY session_id, span""")
def stream_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same spans as `sessions_activity`, as a stream sends them; times in microseconds UTC."""
    spans = S.drained_activity(S.table_stream(spark, table_path(sf_dir, "session_events")))
    micros = lambda c: F.unix_micros(c).alias(f"{c}_us")
    return spans.select("session_id", "n_events", micros("start"), micros("end"))
