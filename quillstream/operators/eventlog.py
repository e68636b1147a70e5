"""Reads of the session event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.wire import event_wire_size
from quillstream.operators.delivery import event_hash
from quillstream.operators.numbering import beyond_first, numbered

#: Limits of the event log.
READ_DEFAULT, READ_MOST, SNAPSHOT_ROWS, SNAPSHOT_BYTES, RECENT_HASHES, KEPT_EVENTS = 100, 1000, 512, 2048, 5, 1000
#: Events of a batch, characters of a type.
BATCH_MOST, TYPE_MOST = 100, 64


def in_namespace(df: DataFrame, sessions: DataFrame, namespace: str | None) -> DataFrame:
    """Rows whose session belongs to a namespace (any if None); of other namespaces none, without an error."""
    own = sessions if namespace is None else sessions.where(F.col("namespace") == namespace)
    return df.join(own.select(F.col("id").alias("session_id")), "session_id", "left_semi")


def read_events(events: DataFrame, sessions: DataFrame, namespace: str | None = None, types: list[str] | None = None, max_priority: int | None = None, limit: int = READ_DEFAULT) -> DataFrame:
    """The first `limit` events of each session: urgent first, then newest, then smallest id; nulls last.

    types: all if empty.  max_priority: the largest number that comes in
    (1 is the most urgent); rows without a priority don't.
    """
    if max_priority is not None and not 1 <= max_priority <= 4:
        raise ValueError("max_priority must lie between 1 and 4")
    if not 1 <= limit <= READ_MOST:
        raise ValueError(f"limit must lie between 1 and {READ_MOST}")
    kept = in_namespace(events, sessions, namespace)
    if types:
        kept = kept.where(F.col("type").isin(types))
    if max_priority is not None:
        kept = kept.where(F.col("priority") <= max_priority)
    order = Window.partitionBy("session_id").orderBy(F.col("priority").asc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col("id"))
    return kept.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def snapshots(events: DataFrame, budget_bytes: int = SNAPSHOT_BYTES) -> DataFrame:
    """Per session the longest prefix of its foremost 512 events that fits a byte budget.

    It stops at the first event that doesn't fit; a first event of priority 1
    comes in even alone over budget.  Adds position, wire_bytes and used_bytes.
    """
    order = Window.partitionBy("session_id").orderBy(F.col("priority").asc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col("id"))
    first = events.withColumn("position", F.row_number().over(order)).where(F.col("position") <= SNAPSHOT_ROWS)
    sized = first.withColumn("wire_bytes", event_wire_size(*(F.col(c) for c in ("id", "type", "priority", "data", "created_at"))))
    running = Window.partitionBy("session_id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = sized.withColumn("used_bytes", F.sum("wire_bytes").over(running))
    return used.where((F.col("used_bytes") <= budget_bytes) | ((F.col("position") == 1) & F.col("priority").eqNullSafe(1)))


def snapshot_summaries(events: DataFrame, budget_bytes: int = SNAPSHOT_BYTES) -> DataFrame:
    """One row per session: events in the snapshot, bytes used, whether any was left out."""
    kept = snapshots(events, budget_bytes).groupBy("session_id").agg(F.count(F.lit(1)).alias("event_count"), F.max("used_bytes").alias("byte_budget_used"))
    total = events.groupBy("session_id").agg(F.least(F.count(F.lit(1)), F.lit(SNAPSHOT_ROWS)).alias("offered"))
    joined = total.join(kept, "session_id", "left").fillna(0, ["event_count", "byte_budget_used"])
    return joined.withColumn("budget_exceeded", F.col("event_count") < F.col("offered")).drop("offered")


def without_recent_repeats(events: DataFrame, last: int = RECENT_HASHES, stretch: int = 10_000) -> DataFrame:
    """Events whose hash isn't among those of the `last` events before them in their session (by id).

    Events are numbered in their session and looked at in stretches, to each of
    which the last events of the one before are added; the columns that aren't
    needed for that come back by id, which must be unique.
    """
    keys = events.select("session_id", "id", F.coalesce(F.col("data_hash"), event_hash()).alias("__hash"))
    rows = numbered(keys, ["session_id"], F.coalesce(F.expr("id div 65536"), F.lit(-1)), ["id"], "__no")
    at = (F.col("__no") - 1) / stretch
    again = F.when((F.col("__no") - 1) % stretch >= stretch - last, F.array(F.floor(at), F.floor(at) + 1)).otherwise(F.array(F.floor(at)))
    placed = rows.withColumn("__at", F.explode(again))
    before = Window.partitionBy("session_id", "__at").orderBy("__no").rowsBetween(-last, -1)
    fresh = placed.withColumn("__recent", F.collect_list("__hash").over(before)).where((F.floor(at) == F.col("__at")) & ~F.array_contains("__recent", F.col("__hash")))
    if set(events.columns) <= {"id", "session_id"}:
        return fresh.select(*events.columns)
    return events.join(fresh.select("id"), "id", "left_semi")


def evicted(events: DataFrame, keep: int = KEPT_EVENTS) -> DataFrame:
    """(session_id, id) of the events beyond `keep` per session: the least urgent and oldest go first; id must be unique."""
    keys = events.select("session_id", "id", "priority", "created_at")
    hours = F.expr("timestampdiff(HOUR, cast(created_at as timestamp_ntz), timestamp_ntz'2100-01-01 00:00:00')")
    code = F.struct(F.coalesce(F.col("priority").cast("long"), F.lit(2**40)).alias("p"), F.coalesce(hours, F.lit(2**40)).alias("h"))
    order = [F.col("priority").asc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col("id")]
    return beyond_first(keys, ["session_id"], code, order, keep).select("session_id", "id")


def checked_batches(events: DataFrame, sessions: DataFrame, most: int = BATCH_MOST) -> DataFrame:
    """Per batch its events and faults by kind; it is accepted as a whole or not at all.

    Faults: an unknown session, a priority that isn't 1 to 4, a type of no or
    more than 64 characters, data that isn't JSON (none at all is fine); and a
    batch of more than `most` events.  A null batch_id is a batch of its own.
    """
    fault = lambda good: F.sum((~F.coalesce(good, F.lit(False))).cast("int"))
    known = sessions.select(F.col("id").alias("session_id")).distinct().withColumn("__known", F.lit(True))
    by = events.select("batch_id", "session_id", "priority", "type", "data").join(known, "session_id", "left").groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_events"), fault(F.col("__known")).alias("n_unknown"), fault(F.col("priority").between(1, 4)).alias("n_priority"),
        fault(F.length(F.coalesce("type", F.lit(""))).between(1, TYPE_MOST)).alias("n_type"),
        fault((F.coalesce("data", F.lit("")) == "") | F.call_function("try_parse_json", F.col("data")).isNotNull()).alias("n_data"),
    )
    return by.withColumn("accepted", (F.col("n_events") <= most) & (F.col("n_unknown") + F.col("n_priority") + F.col("n_type") + F.col("n_data") == 0))


def accepted_events(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """The events of the batches that are accepted."""
    taken = checked_batches(events, sessions).where("accepted").select(F.col("batch_id").alias("__batch"))
    return events.join(taken, F.col("batch_id").eqNullSafe(F.col("__batch")), "left_semi")


def event_hashes(events: DataFrame) -> DataFrame:
    """The hash that type and data of each event yield, and whether the stored one differs."""
    return events.select("id", F.lower(F.hex(event_hash())).alias("hash"), (F.col("data_hash").isNotNull() & (F.col("data_hash") != event_hash())).alias("differs"))
