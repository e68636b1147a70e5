"""Conversations from message rows, by keyed streaming state.

Message rows are read as a stream.  A stateless step turns each row into a
digest of its links and its message (no text is kept in state).  Digests are
appended to the keyed state of their session (a list in RocksDB, which no batch
reads or writes anew) under an event-time watermark on arrival time.  A session
closes by a timer when the watermark has passed its last arrival by
`idle_timeout`; then its records are put together, and if it is sound its turns
come out in order.  Late rows join their session as long as it is open.

A bounded input is closed by a last row far in the future, written once all
files have been taken; a live stream needs none.  Three kinds of session leave
a mark in the output in place of their turns: those with rows that came after
all state of their time was gone, those that closed more than once, and those
with more than `max_state_records` digests, whose state is dropped so that no
session has to fit into one task.  Their digests are taken from the table and
their chains are checked by pointer doubling with joins (`chains_by_doubling`),
so the result is the same however the input is cut into batches.
"""

from __future__ import annotations

import datetime as dt
import json
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillstream.functions.jsontext import UNREADABLE, as_list, loads
from quillstream.sources.tables import shared_dir, written

# Spellings of the two speakers.
SPEAKERS = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "model": "assistant", "bot": "assistant"}
FAR = dt.datetime(2999, 1, 1)
STATE_STORE, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DIGEST = "session_uuid string, uuid string, parent_uuid string, is_turn boolean, speaker string, has_result boolean, readable boolean, arrived timestamp, record_id long"
#: Rows of the stream's output; kind: turn, or the marks closed (one for each time a session closes), large and late (one for each late row).
EMITTED = "kind string, session_uuid string, turn_no int, uuid string, speaker string, record_id long"
OUT = Row(*[f.split()[0] for f in EMITTED.split(", ")])


def _blank_text(block: dict) -> bool:
    kind = block.get("type")
    if kind not in ("text", "thinking"):
        return False
    text = block.get("thinking" if kind == "thinking" else "text")
    return not (isinstance(text, str) and text.strip())


def digest_of(message: str | None, record_type: str | None) -> tuple[bool, str | None, bool, bool]:
    """is_turn, speaker, has_result, readable of a message."""
    body = loads(message)
    if body is UNREADABLE:
        return False, None, False, False
    if not isinstance(body, dict):
        return False, None, False, True
    content = body.get("content")
    if isinstance(content, str):
        blank, results = not content.strip(), False
    else:
        blocks = [b for b in as_list(content) if b is not None]
        blank = all((isinstance(b, dict) and _blank_text(b)) or (isinstance(b, str) and not b.strip()) for b in blocks)
        results = any(isinstance(b, dict) and b.get("type") == "tool_result" for b in blocks)
    role = body.get("role")
    named = role if isinstance(role, str) and role.strip() else record_type or ""
    speaker = SPEAKERS.get(named.strip().lower())
    return not blank, speaker or named.strip().lower(), results, True


def digests(records: DataFrame) -> DataFrame:
    """One digest per row that has a session and a uuid and is no sidechain record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [digest_of(m, t) for m, t in zip(b.column("message").to_pylist(), b.column("record_type").to_pylist(), strict=True)]
            turn, speaker, result, readable = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("session_uuid"), b.column("uuid"), b.column("parent_uuid"), pa.array(turn, pa.bool_()), pa.array(speaker, pa.string()), pa.array(result, pa.bool_()), pa.array(readable, pa.bool_()), b.column("arrived"), b.column("record_id")],
                names=["session_uuid", "uuid", "parent_uuid", "is_turn", "speaker", "has_result", "readable", "arrived", "record_id"],
            )

    kept = records.where("session_uuid is not null and uuid is not null and not coalesce(is_sidechain, false)")
    narrow = kept.select("session_uuid", "uuid", "parent_uuid", "message", "record_type", F.col("ingested_at").cast("timestamp").alias("arrived"), "record_id")
    return narrow.mapInArrow(run, DIGEST)


def first_copies(held: list[list]) -> dict[str, list]:
    """uuid -> its record that arrived first (no arrival: last; then by record_id); held: [uuid, parent, is_turn, speaker, has_result, readable, arrived, record_id]."""
    never = 1 << 62
    records: dict[str, list] = {}
    for row in held:
        known = records.get(row[0])
        if known is None or [never if x is None else x for x in row[6:]] < [never if x is None else x for x in known[6:]]:
            records[row[0]] = row
    return records


def sound_turns(records: dict[str, list]) -> list[tuple[int, str, str, int | None]]:
    """(turn_no, uuid, speaker, record_id) of a sound conversation, else nothing; records as of `first_copies`."""
    child: dict[str, str] = {}
    roots = []
    for uuid, (_, parent, _, _, _, readable, *_) in records.items():
        if not readable:
            return []
        if parent is None:
            roots.append(uuid)
        elif parent not in records or parent in child:
            return []
        else:
            child[parent] = uuid
    if len(roots) != 1:
        return []
    turns, at, walked = [], roots[0], 0
    while at is not None:
        walked += 1
        _, _, is_turn, speaker, has_result, _, _, record = records[at]
        if is_turn:
            turns.append((at, speaker, has_result, record))
        at = child.get(at)
    if walked != len(records) or not turns or turns[0][1] != "user" or turns[-1][1] != "assistant":
        return []
    if any(a[1] == "user" and not a[2] and b[1] != "assistant" for a, b in zip(turns, turns[1:], strict=False)):
        return []
    return [(no, uuid, speaker, record) for no, (uuid, speaker, _, record) in enumerate(turns, 1)]


class Sessions(StatefulProcessor):
    """The keyed state of one session: digests in arrival order, and when the last one came."""

    def __init__(self, idle_ms: int, most: int):
        self.idle_ms, self.most = idle_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.meta = handle.getValueState("meta", "last long, n long")
        self.held = handle.getListState("held", "digests string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        known = self.meta.get()
        last, n = known if known else (0, 0)
        gone = timerValues.getCurrentWatermarkInMs() - self.idle_ms
        taken = []
        for r in rows:
            if known is None and r["arrived_ms"] is not None and r["arrived_ms"] <= gone:
                yield OUT("late", key[0], None, r["uuid"], None, r["record_id"])
                continue
            taken.append([r["uuid"], r["parent_uuid"], r["is_turn"], r["speaker"], r["has_result"], r["readable"], r["arrived_ms"], r["record_id"]])
            last = max(last, r["arrived_ms"] or 0)
        if not taken:
            return
        n += len(taken)
        if n <= self.most:
            self.held.appendValue((json.dumps(taken),))
        elif n - len(taken) <= self.most:
            self.held.clear()
        self.meta.update((last, n))
        if known is None:
            self.handle.registerTimer(max(last + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        last, n = self.meta.get()
        if last + self.idle_ms > timerValues.getCurrentWatermarkInMs():  # rows came since the timer was set
            self.handle.registerTimer(last + self.idle_ms)
            return
        yield OUT("closed" if n <= self.most else "large", key[0], None, None, None, None)
        if n <= self.most:
            for no, uuid, speaker, record in sound_turns(first_copies([d for (chunk,) in self.held.get() for d in json.loads(chunk)])):
                yield OUT("turn", key[0], no, uuid, speaker, record)
            self.held.clear()
        self.meta.clear()


def _streamed(spark: SparkSession, path: str, idle_timeout: str, lateness: str, max_state_records: int, bytes_per_trigger: int, files_per_trigger: int | None, work: str) -> DataFrame:
    """Run the stream over all files at path, then close all sessions; the rows of its output."""
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema)
    reader = reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader.option("maxBytesPerTrigger", bytes_per_trigger)
    digest_schema = digests(table).schema
    closing, out = f"{work}/closing", f"{work}/out"
    nothing = spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in digest_schema])
    nothing.write.parquet(closing)
    # A file stream reads folders; as a pattern, the path may also be one file.
    live = digests(reader.parquet(f"{path[:-1]}[{path[-1]}]"))
    stream = live.unionByName(spark.readStream.schema(digest_schema).parquet(closing)).withWatermark("arrived", lateness)
    idle_ms = int(pd.Timedelta(idle_timeout).total_seconds() * 1000)
    # The processor sees arrival as a number: it decides itself what is late.
    open_rows = stream.where(F.coalesce(F.col("arrived") < F.lit(FAR - dt.timedelta(days=1)), F.lit(True))).withColumn("arrived_ms", F.unix_millis("arrived")).drop("arrived")
    closed = open_rows.groupBy("session_uuid").transformWithState(Sessions(idle_ms, max_state_records), EMITTED, "Append", "EventTime")
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        for last in (False, True):
            if last:
                end = spark.range(1).select(*[(F.lit(FAR) if f.name == "arrived" else F.lit(None)).cast(f.dataType).alias(f.name) for f in digest_schema])
                end.coalesce(1).write.mode("append").parquet(closing)
            query = closed.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{work}/checkpoint").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)
    schema = spark.range(0).select(*[F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in EMITTED.split(", ")]).schema
    return spark.read.schema(schema).parquet(out)


def chains_by_doubling(records: DataFrame) -> DataFrame:
    """Turns of sound conversations of any length; records: digests (session_uuid, uuid, ...), of which the first copies count.

    Every record points at its parent; in each round a pointer jumps over the
    record it points at, so that after log2(n) rounds all of a chain point past
    the root and know their depth.  Turns are numbered by counts per run of
    65,536 depths, so that no window holds a whole session.
    """
    spark = records.sparkSession
    arrival = F.struct(F.col("arrived").isNull(), "arrived", F.col("record_id").isNull(), "record_id")
    facts = ["parent_uuid", "is_turn", "speaker", "has_result", "readable", "record_id"]
    first = records.groupBy("session_uuid", "uuid").agg(F.min_by(F.struct(*facts), arrival).alias("first"))
    records = written(first.select("session_uuid", "uuid", "first.*"), "chain-records")
    sums = records.groupBy("session_uuid").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("parent_uuid").isNull().cast("int")).alias("roots"), F.sum((~F.col("readable")).cast("int")).alias("cut")
    )
    parents = records.where("parent_uuid is not null").groupBy("session_uuid", F.col("parent_uuid").alias("uuid")).agg(F.count(F.lit(1)).alias("kids"))
    forked = parents.where("kids > 1").select("session_uuid")
    orphaned = parents.join(records, ["session_uuid", "uuid"], "left_anti").select("session_uuid")
    good = sums.where("roots = 1 and cut = 0").join(forked.union(orphaned), "session_uuid", "left_anti").select("session_uuid", "n")
    at = written(records.join(good, "session_uuid").select("session_uuid", "uuid", F.col("parent_uuid").alias("up"), F.when(F.col("parent_uuid").isNull(), 0).otherwise(1).cast("long").alias("depth")), "chain-depth")
    longest = at.groupBy("session_uuid").count().agg(F.max("count")).first()[0] or 0
    for _ in range(math.ceil(math.log2(longest + 1)) + 1 if longest else 0):
        over = at.select("session_uuid", F.col("uuid").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        jumped = at.join(over, ["session_uuid", "up"], "left")
        at = written(jumped.select("session_uuid", "uuid", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth")), "chain-depth")
    looped = at.where("up is not null").select("session_uuid").distinct()
    turns = records.where("is_turn").join(at.join(looped, "session_uuid", "left_anti"), ["session_uuid", "uuid"]).withColumn("run", F.expr("depth div 65536"))
    before = Window.partitionBy("session_uuid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = turns.groupBy("session_uuid", "run").agg(F.count(F.lit(1)).alias("k")).withColumn("base", F.coalesce(F.sum("k").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("session_uuid", "run").orderBy("depth"))
    numbered = written(turns.withColumn("within", within).join(starts, ["session_uuid", "run"]).select("session_uuid", (F.col("base") + F.col("within")).cast("int").alias("turn_no"), "uuid", "speaker", "has_result", "record_id"), "chain-turns")
    follow = numbered.select("session_uuid", (F.col("turn_no") - 1).alias("turn_no"), F.col("speaker").alias("next"))
    paired = numbered.join(follow, ["session_uuid", "turn_no"], "left")
    wrong = (
        ((F.col("turn_no") == 1) & ~F.col("speaker").eqNullSafe("user"))
        | (F.col("next").isNull() & ~F.col("speaker").eqNullSafe("assistant"))
        | (F.col("speaker").eqNullSafe("user") & ~F.col("has_result") & ~F.col("next").eqNullSafe("assistant"))
    )
    unsound = paired.where(wrong).select("session_uuid").distinct()
    return numbered.join(unsound, "session_uuid", "left_anti").select("session_uuid", "turn_no", "uuid", "speaker", "record_id")


def sound_conversations(
    spark: SparkSession, path: str, idle_timeout: str = "14 days", lateness: str = "1 day", max_state_records: int = 200_000, bytes_per_trigger: int = 1 << 30, files_per_trigger: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """All sound conversations of the record table at path, and how its sessions came through the stream.

    The first has (session_uuid, turn_no, uuid, speaker, record_id), the second
    (session_uuid, n_closed, n_late, large), a row for every session of the
    stream.  Rows without session_uuid or uuid and sidechain rows are set aside;
    repeated uuids of a session are one record, whose first arrival counts (no
    ingested_at: the last; ties by record_id).  Rows without ingested_at are
    never late and don't move the watermark.  Batches take `bytes_per_trigger`
    (or a number of files) in the order in which the files were written.
    Broken, empty and unanswered conversations and empty tables give no rows.
    Extra columns don't matter.
    """
    emitted = _streamed(spark, path, idle_timeout, lateness, max_state_records, bytes_per_trigger, files_per_trigger, shared_dir(spark, "conversations"))
    turns = emitted.where("kind = 'turn'").select("session_uuid", "turn_no", "uuid", "speaker", "record_id")
    count = lambda kind: F.sum((F.col("kind") == kind).cast("int"))
    sessions = written(emitted.where("kind <> 'turn'").groupBy("session_uuid").agg(count("closed").alias("n_closed"), count("late").alias("n_late"), (count("large") > 0).alias("large")), "session-ends")
    again = sessions.where("large or n_late > 0 or n_closed > 1").select("session_uuid")
    if again.isEmpty():
        return turns, sessions
    whole = digests(spark.read.parquet(path)).join(again, "session_uuid", "left_semi")
    return turns.join(again, "session_uuid", "left_anti").unionByName(chains_by_doubling(whole)), sessions


def conversation_texts(turns: DataFrame, records: DataFrame) -> DataFrame:
    """Turns with the text of the messages of their own records: the blocks' texts, line by line; record_id must be unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for message in b.column("message").to_pylist():
                body = loads(message)
                content = body.get("content") if isinstance(body, dict) else None
                texts.append("\n".join(x for x in ((c if isinstance(c, str) else c.get("text") if isinstance(c, dict) and isinstance(c.get("text"), str) else "") for c in as_list(content)) if x))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("session_uuid", "turn_no", "uuid", "speaker")), pa.array(texts, pa.string())], names=["session_uuid", "turn_no", "uuid", "speaker", "text"])

    return turns.join(records.where("message is not null").select("record_id", "message"), "record_id").select("session_uuid", "turn_no", "uuid", "speaker", "message").mapInArrow(run, "session_uuid string, turn_no int, uuid string, speaker string, text string")
