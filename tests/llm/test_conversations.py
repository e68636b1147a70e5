import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quillstream.llm import conversations as C

SCHEMA = "record_id long, session_uuid string, record_type string, uuid string, parent_uuid string, is_sidechain boolean, ingested_at timestamp_ntz, message string, turn_no int, arrived string"
AT = dt.datetime(2026, 1, 1)


def said(role, content):
    return json.dumps({"role": role, "content": content})


class Table:
    def __init__(self):
        self.rows = []

    def add(self, session, uuid, parent, message=None, kind="user", side=None, day=0):
        at = None if day is None else AT + dt.timedelta(days=day, seconds=len(self.rows))
        self.rows.append((len(self.rows), session, kind, uuid, parent, side, at, message, 3, "x"))

    def chain(self, session, *messages):
        for k, m in enumerate(messages):
            self.add(session, f"u{k}", f"u{k - 1}" if k else None, m)


def build():
    t = Table()
    t.chain("good", said("user", "hi"), None, said("assistant", [{"type": "text", "text": "yes"}]), said(" Human", "more"), said("ai", "ok"))
    t.rows.reverse()
    t.chain("good2", json.dumps(said("user", "hi")), said("assistant", [None, {"type": "tool_use", "id": "x"}]), said("user", {"type": "tool_result"}), said("assistant", "done"))
    t.add("good2", "u1", "u0", said("assistant", [{"type": "tool_use", "id": "x"}]), day=3)
    t.add("good2", "side", "u0", said("user", "aside"), side=True)
    t.add("good2", None, None, "{")
    t.add("role", "a", None, '{"content": "hi"}', kind="user")
    t.add("role", "b", "a", '{"content": "yes"}', kind="assistant", day=None)
    t.chain("unanswered", said("user", "hi"), said("user", "hello"), said("assistant", "yes"))
    t.chain("open", said("user", "hi"), said("assistant", "yes"), said("user", "and"))
    t.chain("starts", said("assistant", "yes"))
    t.chain("blank", said("user", " "), said("assistant", [{"type": "text", "text": ""}, {"type": "thinking", "thinking": " "}, None]))
    t.chain("cut", said("user", "hi"), said("assistant", "yes")[:-3])
    t.chain("fork", said("user", "hi"), said("assistant", "yes"))
    t.add("fork", "x", "u0", said("assistant", "other"))
    t.add("orphan", "a", "gone", said("user", "hi"))
    t.add("two", "a", None, said("user", "hi"))
    t.add("two", "b", None, said("assistant", "yes"))
    t.chain("loop", said("user", "hi"), said("assistant", "yes"))
    t.add("loop", "x", "y")
    t.add("loop", "y", "x")
    t.add(None, "a", None, said("user", "hi"))
    return t.rows


WANT = {("good", 1, "u0"), ("good", 2, "u2"), ("good", 3, "u3"), ("good", 4, "u4"), ("good2", 1, "u0"), ("good2", 2, "u1"), ("good2", 3, "u2"), ("good2", 4, "u3"), ("role", 1, "a"), ("role", 2, "b")}


def stored(spark, tmp_path, rows, files=1):
    path = str(tmp_path / "records.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.parquet(path)
    return path


@pytest.mark.parametrize("limit", [200_000, 3])
def test_sound_ones_only(spark, tmp_path, limit):
    got, sessions = C.sound_conversations(spark, stored(spark, tmp_path, build()), max_state_records=limit)
    assert {(r.session_uuid, r.turn_no, r.uuid) for r in got.collect()} == WANT
    assert sessions.where("large").count() == (3 if limit == 3 else 0)  # good, good2 and loop


def test_late_files_in_later_batches(spark, tmp_path):
    # Files in order of arrival: a session's records lie in several of them.
    rows = sorted(build(), key=lambda r: (r[6] is not None, r[6]) if r[6] else (False, AT))
    path = str(tmp_path / "records.parquet")
    for k in range(0, len(rows), 8):
        spark.createDataFrame(rows[k : k + 8], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    got, _ = C.sound_conversations(spark, path, files_per_trigger=1)
    assert {(r.session_uuid, r.turn_no, r.uuid) for r in got.collect()} == WANT


def test_rows_behind_the_watermark_and_sessions_that_go_on(spark, tmp_path):
    t = Table()
    t.chain("late", said("user", "hi"), said("assistant", "yes"))
    t.rows = t.rows[::-1]
    last = t.rows.pop()  # its first record comes in a file after all state of its time is gone
    t.add("resumed", "a", None, said("user", "hi"))
    t.add("resumed", "b", "a", said("assistant", "yes"))
    t.add("resumed", "c", "b", said("user", "more"), day=60)
    t.add("resumed", "d", "c", said("assistant", "ok"), day=60)
    t.add("far", "a", None, said("user", "hi"), day=30)
    t.add("far", "b", "a", said("user", "hi"), day=31)
    path = str(tmp_path / "records.parquet")
    for part in (t.rows[:3], t.rows[5:6], t.rows[6:], t.rows[3:5], [last]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    got, sessions = C.sound_conversations(spark, path, files_per_trigger=1)
    assert {(r.session_uuid, r.turn_no, r.uuid) for r in got.collect()} == {("late", 1, "u0"), ("late", 2, "u1"), ("resumed", 1, "a"), ("resumed", 2, "b"), ("resumed", 3, "c"), ("resumed", 4, "d")}
    ends = {r.session_uuid: r for r in sessions.collect()}
    assert (ends["late"].n_late, ends["resumed"].n_closed, ends["far"].n_closed) == (1, 2, 1)


@pytest.mark.parametrize("limit", [200_000, 1])
def test_first_arrival_of_a_repeated_uuid_counts(spark, tmp_path, limit):
    t = Table()
    t.add("s", "b", "a", said("assistant", "late copy"), day=2)
    t.add("s", "b", "a", said("assistant", "no arrival"), day=None)
    t.add("s", "a", None, said("user", "hi"))
    t.add("s", "b", "a", said("assistant", "first"), day=1)
    path = stored(spark, tmp_path, t.rows, 3)
    turns, _ = C.sound_conversations(spark, path, max_state_records=limit)
    assert [(r.turn_no, r.text) for r in C.conversation_texts(turns, spark.read.parquet(path)).orderBy("turn_no").collect()] == [(1, "hi"), (2, "first")]


def test_long_chain_by_doubling(spark):
    n = 300
    rows = [("s", f"u{k}", f"u{k - 1}" if k else None, True, "assistant" if k % 2 else "user", False, True) for k in range(n)]
    df = spark.createDataFrame(rows, "session_uuid string, uuid string, parent_uuid string, is_turn boolean, speaker string, has_result boolean, readable boolean")
    df = df.withColumns({"arrived": F.lit(None).cast("timestamp"), "record_id": F.monotonically_increasing_id()})
    got = C.chains_by_doubling(df.union(df))
    assert {(r.turn_no, r.uuid) for r in got.collect()} == {(k + 1, f"u{k}") for k in range(n)}


def test_texts(spark, tmp_path):
    path = stored(spark, tmp_path, build())
    texts = C.conversation_texts(C.sound_conversations(spark, path)[0], spark.read.parquet(path)).where("session_uuid = 'good'").orderBy("turn_no")
    assert [(r.speaker, r.text) for r in texts.collect()] == [("user", "hi"), ("assistant", "yes"), ("user", "more"), ("assistant", "ok")]


def test_empty_table(spark, tmp_path):
    assert C.sound_conversations(spark, stored(spark, tmp_path, []))[0].count() == 0


def test_one_file_as_path(spark, tmp_path):
    path = stored(spark, tmp_path, build())
    single = next((tmp_path / "records.parquet").glob("*.parquet"))
    assert C.sound_conversations(spark, str(single))[0].count() == len(WANT)
    assert spark.read.parquet(path).where(F.col("session_uuid").isNull()).count() == 1
