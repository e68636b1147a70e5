"""Sessions, clients and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Minutes a session lives without activity, by default and at most.
TTL_DEFAULT, TTL_MOST = 120, 10_080


def expiry() -> Column:
    """expires_at, or where it is missing last_activity plus the session's minutes (default 120, at most a week)."""
    minutes = F.least(F.coalesce(F.col("ttl_minutes"), F.lit(TTL_DEFAULT)), F.lit(TTL_MOST))
    return F.coalesce(F.col("expires_at"), F.col("last_activity") + F.make_dt_interval(mins=minutes))


def with_labels(sessions: DataFrame, labels: DataFrame) -> DataFrame:
    """Sessions with a map of their labels, null where they have none; of repeated keys the smallest value counts."""
    own = labels.where("label_key is not null").groupBy("session_id", "label_key").agg(F.min("label_value").alias("label_value"))
    maps = own.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label_key", "label_value")))).alias("labels"))
    return sessions.join(maps, sessions["id"] == maps["session_id"], "left").drop("session_id")


def labelled(labels: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Ids of the sessions that have all of the wanted pairs (relational division); none wanted: all in labels."""
    if not wanted:
        return labels.select("session_id").distinct()
    pair = reduce(lambda a, b: a | b, [(F.col("label_key") == k) & (F.col("label_value") == v) for k, v in wanted.items()])
    return labels.where(pair).groupBy("session_id").agg(F.count_distinct("label_key").alias("n")).where(F.col("n") == len(wanted)).select("session_id")


def clients(sessions: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """Clients with their number of sessions and last activity; registered ones without a session keep 0."""
    known = registered if registered is not None else sessions.select("namespace", "client").distinct()
    by = sessions.groupBy("namespace", "client").agg(F.count("id").alias("n_sessions"), F.max("last_activity").alias("last_activity"))
    return known.join(by, ["namespace", "client"], "left").fillna(0, ["n_sessions"])


def expired(sessions: DataFrame, at: Column) -> DataFrame:
    return sessions.withColumn("expiry", expiry()).where(F.col("expiry") < at)


def cascade(sessions: DataFrame, labels: DataFrame, events: DataFrame) -> DataFrame:
    """What deleting each client would take along: its sessions, their labels and their events."""
    n_labels = labels.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_labels"))
    n_events = events.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_events"))
    joined = sessions.select(F.col("id").alias("session_id"), "namespace", "client").join(n_labels, "session_id", "left").join(n_events, "session_id", "left")
    zero = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c)
    return joined.groupBy("namespace", "client").agg(F.count(F.lit(1)).alias("n_sessions"), zero("n_labels"), zero("n_events"))


def touched(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """last_activity of sessions, moved forward (never back) by their events."""
    seen = events.groupBy("session_id").agg(F.max("received_at").alias("seen"))
    joined = sessions.join(seen, sessions["id"] == seen["session_id"], "left")
    return joined.withColumn("last_activity", F.greatest("last_activity", "seen")).drop("session_id", "seen")


def activity_spans(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Spans of activity of each session: events with less than `gap` between them; rows without a time have none."""
    timed = events.where("created_at is not null").select("session_id", F.col("created_at").cast("timestamp").alias("at"))
    spans = timed.groupBy("session_id", F.session_window("at", gap).alias("span")).agg(F.count(F.lit(1)).alias("n_events"))
    return spans.select("session_id", "n_events", F.unix_micros("span.start").alias("start_us"), F.unix_micros("span.end").alias("end_us"))
