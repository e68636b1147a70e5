import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quillstream.functions.wire import event_wire_size, json_string_size
from quillstream.operators import capture, eventlog, numbering, sessions, transcripts
from quillstream.streaming import events as streams

EVENTS = "id long, session_id long, type string, priority int, data string, data_hash binary, created_at timestamp_ntz, received_at timestamp_ntz"
AT = dt.datetime(2026, 1, 2, 3, 4, 5)


def go_size(r):
    body = json.dumps({"id": r[0], "type": r[2], "priority": r[3], "data": 0, "created_at": ""}, ensure_ascii=False, separators=(",", ":"))
    data = json.dumps(json.loads(r[4] or "{}"), ensure_ascii=False, separators=(",", ":"))
    stamp = r[6].strftime("%Y-%m-%dT%H:%M:%S") + (f".{r[6].microsecond:06d}".rstrip("0") if r[6].microsecond else "") + "Z"
    extra = sum((body + data).count(c) for c in "<>&") * 5
    return len(body.encode()) - 1 + len(data.encode()) + len(stamp) + extra


def test_wire_sizes(spark):
    rows = [(1, 1, "t", 1, '{"a": "x  y <&>", "b" : [1, 2]}', None, AT.replace(microsecond=120_000), AT), (12, 1, 'q"ü\n', 4, None, None, AT, AT), (3, 1, "t", 2, "", None, AT, AT)]
    df = spark.createDataFrame(rows, EVENTS).orderBy("id")
    got = {r.id: r.n for r in df.select("id", event_wire_size(*(F.col(c) for c in ("id", "type", "priority", "data", "created_at"))).alias("n")).collect()}
    assert got == {r[0]: go_size(r) for r in rows}
    assert spark.range(1).select(json_string_size(F.lit("a \x01"))).first()[0] == 2 + 1 + 6 + 6


def test_snapshot_prefix_and_urgent_first(spark):
    big = json.dumps({"x": "y" * 3000})
    rows = [(1, 1, "t", 1, big, None, AT, AT), (2, 1, "t", 2, "{}", None, AT, AT), (3, 2, "t", 2, big, None, AT, AT), (4, 2, "t", 3, "{}", None, AT, AT), (5, 3, "t", 2, "{}", None, AT, AT), (6, 3, "t", None, None, None, None, AT)]
    df = spark.createDataFrame(rows, EVENTS)
    assert sorted(r.id for r in eventlog.snapshots(df).collect()) == [1, 5, 6]
    got = {r.session_id: (r.event_count, r.budget_exceeded) for r in eventlog.snapshot_summaries(df).collect()}
    assert got == {1: (1, True), 2: (0, True), 3: (2, False)}
    assert eventlog.snapshots(df.limit(0)).count() == 0


def test_reads_are_checked_and_isolated(spark):
    df = spark.createDataFrame([(1, 1, "t", 1, "{}", None, AT, AT), (2, 2, "t", 3, "{}", None, AT, AT)], EVENTS)
    own = spark.createDataFrame([(1, "a"), (2, "b")], "id long, namespace string")
    assert [r.id for r in eventlog.read_events(df, own, "a").collect()] == [1]
    assert eventlog.read_events(df, own, "none").count() == 0
    with pytest.raises(ValueError):
        eventlog.read_events(df, own, max_priority=5)
    with pytest.raises(ValueError):
        eventlog.read_events(df, own, limit=0)


def test_repeats_and_eviction(spark):
    rows = [(k, 1, "t", 1 + k % 4, json.dumps({"k": k % 4}), None, AT + dt.timedelta(seconds=k), AT) for k in range(20)]
    df = spark.createDataFrame(rows, EVENTS)
    assert sorted(r.id for r in eventlog.without_recent_repeats(df).collect()) == [0, 1, 2, 3]
    gone = [r.id for r in eventlog.evicted(df, 15).collect()]
    assert sorted(gone) == [3, 7, 11, 15, 19]


def test_numbers_repeats_and_eviction_across_buckets(spark):
    rows = [(k * 40_000, 1 + k // 30, "t", None if k % 7 == 0 else 1 + k % 3, json.dumps({"k": k % 6}), None, None if k % 5 == 0 else AT + dt.timedelta(minutes=k % 11), AT) for k in range(60)]
    df = spark.createDataFrame(rows, EVENTS)
    whole = sorted(r.id for r in eventlog.without_recent_repeats(df).collect())
    assert sorted(r.id for r in eventlog.without_recent_repeats(df, stretch=7).collect()) == whole
    want = []
    for s in (1, 2):
        recent = []
        for r in sorted(r for r in rows if r[1] == s):
            if r[4] not in recent[-5:]:
                want.append(r[0])
            recent.append(r[4])
    assert whole == sorted(want)
    late = dt.datetime(2100, 1, 1)
    order = lambda r: (r[3] is None, r[3] or 0, r[6] is None, late - (r[6] or AT), r[0])
    for keep in (1, 9, 10, 29, 30, 31):
        gone = [r[0] for s in (1, 2) for r in sorted((r for r in rows if r[1] == s), key=order)[keep:]]
        assert sorted(r.id for r in eventlog.evicted(df, keep).collect()) == sorted(gone)
    same = numbering.numbered(df.select("id", "session_id").union(df.where("id = 0").select("id", F.lit(None).cast("long"))), ["session_id"], F.expr("id div 65536"), ["id"], "no")
    assert sorted((r.session_id or 0, r.no) for r in same.collect()) == [(0, 1), *((s, n) for s in (1, 2) for n in range(1, 31))]


def test_batches_are_taken_whole(spark):
    good = (1, "t", 1, "{}")
    rows = [(k, 1, *good[1:], 7) for k in range(100)] + [(200 + k, 1, *good[1:], 8) for k in range(101)]
    rows += [(400, 1, "t", 1, "{}", 9), (401, 2, "t", 1, "{}", 9), (402, 1, "t", None, None, 10), (403, 1, "", 5, "{", 10), (404, 1, "x" * 65, 4, "", 10), (405, 1, "t", 4, "", None)]
    events = spark.createDataFrame(rows, "id long, session_id long, type string, priority int, data string, batch_id long")
    known = spark.createDataFrame([(1,)], "id long")
    got = {r.batch_id: tuple(r)[1:] for r in eventlog.checked_batches(events, known).collect()}
    assert got == {7: (100, 0, 0, 0, 0, True), 8: (101, 0, 0, 0, 0, False), 9: (2, 1, 0, 0, 0, False), 10: (3, 0, 2, 2, 1, False), None: (1, 0, 0, 0, 0, True)}
    assert {r.id for r in eventlog.accepted_events(events, known).collect()} == {*range(100), 405}


def test_segments_rereads_and_states(spark):
    use = lambda n, t: json.dumps({"model": "m", "content": [{"type": "tool_use", "id": f"{n}{t}", "name": n, "input": {"file_path": t}}]})
    rows = [(1, "s", "assistant", "a", use("Read", "x"), None), (2, "s", "system", "b", None, None), (3, "s", "assistant", "c", use("Read", "x"), None), (4, "s", "assistant", "d", use("Read", "y"), None), (5, "t", "user", "a", json.dumps({"content": "Permission denied by user"}), json.dumps({"type": "hook_result", "addedNames": []})), (6, None, "odd", None, None, None)]
    records = spark.createDataFrame(rows, "record_id long, session_uuid string, record_type string, uuid string, message string, attachment string").withColumn("is_sidechain", F.lit(False))
    segments = transcripts.segments(records)
    assert sorted((r.record_id, r.segment) for r in segments.collect()) == [(1, 0), (2, 1), (3, 1), (4, 1), (5, 0), (6, 0)]
    again = transcripts.rereads(transcripts.calls(records), segments)
    assert sorted((r.record_id, r.reread) for r in again.collect()) == [(1, False), (3, True), (4, False)]
    states = {r.session_uuid: tuple(r)[1:] for r in transcripts.state_flags(records).collect()}
    assert states == {"s": (True, False, False, False, "m"), "t": (False, True, True, True, None), None: (False, False, False, False, None)}
    assert [(r.what, r.kind, r.n) for r in transcripts.unknown_shapes(records).collect()] == [("record", "odd", 1)]
    assert transcripts.known_only(records.where("record_id < 6")).count() == 5
    with pytest.raises(Exception, match="unknown record type: odd"):
        transcripts.known_only(records).collect()


def test_usage_of_wrapped_messages(spark):
    said = lambda i, n: json.dumps({"id": i, "usage": {"output_tokens": n, "input_tokens": 2 * n}})
    rows = [(1, "s", said("a", 1)), (2, "s", json.dumps(said("b", 10))), (3, "s", json.dumps(json.dumps(said("c", 100)))), (4, "s", said("a", 7)), (5, "s", said("d", 9)[:-2]), (6, "s", '"plain"'), (7, "s", None)]
    got = transcripts.usage(spark.createDataFrame(rows, "record_id long, session_uuid string, message string")).first()
    assert (got.n_messages, got.output_tokens, got.input_tokens) == (3, 111, 222)


def test_labels_and_clients(spark):
    s = spark.createDataFrame([(1, "n", "c", AT, 10, None), (2, "n", "d", AT, None, None), (3, "m", "c", AT, 20_000, AT)], "id long, namespace string, client string, last_activity timestamp_ntz, ttl_minutes int, expires_at timestamp_ntz")
    labels = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "x"), (2, "a", "w"), (9, None, None)], "session_id long, label_key string, label_value string")
    assert {r.id: r.labels for r in sessions.with_labels(s, labels).collect()} == {1: {"a": "x", "b": "y"}, 2: {"a": "w"}, 3: None}
    assert [r.session_id for r in sessions.labelled(labels, {"a": "x", "b": "y"}).collect()] == [1]
    assert sorted(r.session_id for r in sessions.labelled(labels, {}).collect()) == [1, 2, 9]
    known = spark.createDataFrame([("n", "c"), ("n", "new")], "namespace string, client string")
    assert {r.client: r.n_sessions for r in sessions.clients(s, known).collect()} == {"c": 1, "new": 0}
    assert [r.id for r in sessions.expired(s, F.expr("timestamp_ntz'2026-01-02 03:30:00'")).collect()] == [1, 3]


@pytest.mark.parametrize(
    ("command", "mode", "latest", "history"),
    [
        ("cat src/a.go", "replace", "ctx:v1:file:read:ws:src/a.go", None),
        ("cat ../x", "coexist", None, "ctx:v1:shell:ws:cat#7"),
        ("cat *.go", "coexist", None, "ctx:v1:shell:ws:cat#7"),
        ("tail -n 40 a", "coexist", None, "ctx:v1:shell:ws:tail#7"),
        ("ls", "replace", "ctx:v1:file:list:ws", None),
        ("grep 'a b:c' src", "replace", "ctx:v1:search:grep:ws:a%20b%3Ac:src", None),
        ("git diff", "dual", "ctx:v1:vcs:git:ws:diff:HEAD", "ctx:v1:vcs:git:ws:diff:HEAD#7"),
        ("git status", "dual", "ctx:v1:vcs:git:ws:status", "ctx:v1:vcs:git:ws:status#7"),
        ("git push", "coexist", None, "ctx:v1:shell:ws:git#7"),
        ("A=b env make x", "coexist", None, "ctx:v1:shell:ws:make#7"),
        ("cat a | wc", "coexist", None, "ctx:v1:shell:ws:sh#7"),
        ("cat /work/ws/b/../a", "replace", "ctx:v1:file:read:ws:a", None),
        ("cat /etc/x", "coexist", None, "ctx:v1:shell:ws:cat#7"),
    ],
)
def test_labels_of_commands(spark, command, mode, latest, history):
    df = spark.createDataFrame([(command, "/work/ws", "/work/ws", "ws", 7)], "command string, cwd string, root string, workspace string, seq long")
    got = capture.plans(df).first()
    assert (got.mode, got.latest_source, got.history_source) == (mode, latest, history)


def test_long_labels_blank_commands_and_secrets(spark):
    rows = [("cat " + "d/" * 150 + "x", "/w", "/w", "w", 1), ("cat a", None, None, "w" * 300, 1), ("  ", "/w", "/w", "w", 1), (None, None, None, None, None)]
    got = capture.plans(spark.createDataFrame(rows, "command string, cwd string, root string, workspace string, seq long")).collect()
    assert len(got) == 2 and all(len(g.latest_source) <= 200 for g in got)
    text = spark.createDataFrame([("curl --token=abc -H Authorization: Bearer xyz\x00" + "é" * 400,)], "s string").select(capture.trace_tail(F.col("s"))).first()[0]
    assert len(text.encode()) <= 512 and "�" not in text
    assert spark.range(1).select(capture.redacted(F.lit("--token=abc Bearer xyz"))).first()[0] == "--token=<redacted> Bearer <redacted>"
    parts = spark.range(1).select(capture.parsed_labels(F.lit("a:b#12@abcdef")).alias("p")).first().p
    assert (parts.base, parts.seq, parts.token) == ("a:b", 12, "abcdef")


@pytest.mark.parametrize(
    ("command", "programs"),
    [
        ("cat a.txt", ["cat"]), ("cat a | wc -l", ["cat", "wc"]), ("make && ./run.sh; /usr/bin/env X=1 go test", ["make", "run.sh", "go"]), ("A=b", []), ("", []), ("  ", []),
        ("grep 'a|b;c' x || echo \"d && e\"", ["grep", "echo"]), ("go build 2>&1 | tee log", ["go", "tee"]), ("a |& b", ["a", "b"]), ("echo a\\|b", ["echo"]), ("one\ntwo", ["one", "two"]), (None, None),
    ],
)
def test_programs_of_segments(spark, command, programs):
    got = spark.createDataFrame([(command,)], "c string").select(capture.programs(F.col("c")).alias("p"), capture.invokes(F.col("c"), "TEE").alias("t")).first()
    assert got.p == programs and (got.t or False) == ("tee" in (programs or []))


def test_small_scalars_of_captures(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(capture.encoded(F.lit("a:b#c@d e%f\t\x7fé"))) == "a%3Ab%23c%40d%20e%25f%09%7Fé"
    assert one(capture.single_line(F.lit(" a\n\t b  c "))) == "a b c"
    assert one(capture.safe_session_id(F.lit("ab-1_"))) == "ab-1_" and one(capture.safe_session_id(F.lit("../A"))) == hashlib.sha256(b"../A").hexdigest()
    assert one(capture.redacted(F.lit("authorization: Bearer abc -token x --api_key=y"))) == "authorization: Bearer <redacted> -token=<redacted> --api_key=<redacted>"


def test_long_failures_are_cut_between_characters(spark):
    text = "h" * 4095 + "é" * 10_000 + "t" * 1_000
    rows = spark.createDataFrame([(text, True), (text, False), ("x" * 16_384, True), ("short", False)], "p string, failed boolean")
    got = [r.s for r in rows.select(capture.shown(F.col("p"), F.col("failed")).alias("s")).collect()]
    assert got[0].startswith("h" * 4095 + "\n[") and got[0].endswith("é" * 5_644 + "t" * 1_000) and "8711 bytes left out" in got[0] and "\ufffd" not in got[0]
    assert got[1:] == [None, "x" * 16_384, "short"]


@pytest.mark.parametrize("shift", [0, 1, 2])
def test_trace_tails_are_cut_between_characters(spark, shift):
    text = spark.createDataFrame([("x" * shift + "猫" * 400,)], "s string").select(capture.trace_tail(F.col("s"))).first()[0]
    assert text == "猫" * 170


def test_workspaces_that_end_alike(spark):
    rows = [("/b/app", 5), ("/a/app/", 2), ("/a/app/", 9), ("/c/x", 1), (None, 3), ("", 4)]
    got = {r.path: r.workspace for r in capture.workspace_ids(spark.createDataFrame(rows, "p string, at long"), "p", "at").collect()}
    assert got == {"/a/app/": "app", "/b/app": "app-" + hashlib.sha256(b"/b/app").hexdigest()[:8], "/c/x": "x"}


def test_inventory_is_cut_at_whole_lines(spark):
    rows = [("s", "a" * 500, 1), ("s", "b" * 500, 2), ("s", "c", 3), ("s", "c", 4), (None, "d", 1), *[("t", f"e{k}", k) for k in range(30)]]
    got = capture.inventory(spark.createDataFrame(rows, "g string, c string, at long"), "g", "c", "at").collect()
    assert sorted((r.g or "", r.position, r.source[:3]) for r in got if r.g != "t") == [("", 1, "d"), ("s", 1, "c"), ("s", 2, "bbb")]
    assert sorted(r.last for r in got if r.g == "t") == list(range(10, 30))


def test_payloads_and_line_ranges(spark):
    rows = [("a\n", "e", "inline"), ("a", "e", "inline"), (None, "e", "inline"), ("a", " \n", "inline"), ("x" * 5000, None, "compact")]
    df = spark.createDataFrame(rows, "o string, e string, want string").withColumn("p", capture.payload(F.col("o"), F.col("e")))
    assert [r.p for r in df.collect()][:4] == ["[stdout]\na\n\n[stderr]\ne", "[stdout]\na\n\n[stderr]\ne", "[stderr]\ne", "a"]
    assert df.where(capture.presentation(F.col("p"), F.lit(False)) != F.col("want")).count() == 0
    text = F.lit("1\n2\n\n4")
    got = spark.range(1).select(capture.line_range(text, 2, 3), capture.line_range(text, 4), capture.line_range(text, 5), capture.line_range(text, 0, 1), capture.line_range(text)).first()
    assert tuple(got) == ("2\n\n", "4", None, "1\n", "1\n2\n\n4")


def test_transcript_habits(spark):
    def use(k, name, path):
        return json.dumps({"id": f"m{k // 2}", "usage": {"output_tokens": 5}, "content": [{"type": "tool_use", "id": f"t{k}", "name": name, "input": {"path": path}}]})

    rows = [(k, "s", f"u{k}", False, use(k, n, p), None) for k, (n, p) in enumerate([("Read", "a"), ("Edit", "a"), ("Read", "a"), ("Edit", "b"), ("Grep", "x"), ("Grep", "b")])]
    df = spark.createDataFrame(rows, "record_id long, session_uuid string, uuid string, is_sidechain boolean, message string, attachment string")
    got = transcripts.habits(transcripts.calls(df)).first()
    assert (got.n_calls, got.read_before_edit, got.probe_loops) == (6, 1, 2)
    assert transcripts.usage(df).first().output_tokens == 15
    cells = spark.createDataFrame([("t", "raw", 10), ("t", "x", 6), ("u", "x", 3), ("v", "raw", 0), ("v", "x", 1)], "task string, arm string, value long")
    verdict = transcripts.arm_verdicts(transcripts.arm_ratios(cells)).first()
    assert (verdict.median_ratio, verdict.verdict, verdict.needs_more) == (0.6, "viable", True)


def test_bytes_of_string_results(spark):
    def message(*blocks):
        return json.dumps({"content": list(blocks)})

    uses = [{"type": "tool_use", "id": f"t{k}", "name": "Read", "input": {}} for k in range(4)]
    results = [{"type": "tool_result", "tool_use_id": f"t{k}", "content": c} for k, c in enumerate(["größe", [{"type": "text", "text": "abc"}, "de"], None])]
    rows = [(1, "s", "a", False, message(*uses), None), (2, "s", "b", False, message(*results), None)]
    df = spark.createDataFrame(rows, "record_id long, session_uuid string, uuid string, is_sidechain boolean, message string, attachment string")
    assert [r.n_bytes for r in transcripts.calls(df).orderBy("call_no").collect()] == [7, 5, 0, None]


def test_streams(spark, tmp_path):
    # Ten copies of one message; some have its hash, from the others it follows.
    digest = hashlib.sha256(b"".join(len(x).to_bytes(8, "big") + x for x in (b"t", b"{}"))).digest()
    rows = [(k, 1, "t", 1, "{}", digest if k % 2 else None, AT + dt.timedelta(minutes=k * 20), AT + dt.timedelta(minutes=k * 20)) for k in range(10)]
    path = str(tmp_path / "e.parquet")
    spark.createDataFrame(rows, EVENTS).repartition(3).write.parquet(path)
    once = streams.drained(streams.first_deliveries(streams.table_stream(spark, path, 1)).select("id"), "t")
    assert once.count() == 1
    daily = streams.drained(streams.daily_counts(streams.table_stream(spark, path, 1)), "t", "complete")
    assert [tuple(r) for r in daily.select("type", "day", "n_events").collect()] == [("t", "2026-01-02", 10)]
    folder = tmp_path / "spool"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"epoch": 2, "session_id": 1, "type": "a", "priority": 1, "data": "{}"}\n{"epoch": 1, "session_id": 1, "type": "b", "priority": 1}\n{"epoch": 2, "type": "c", "priority": 9}\n')
    assert [r.type for r in streams.drained(streams.spooled(spark, str(folder), 2), "t").collect()] == ["a"]


def test_streams_take_all_of_a_bounded_table(spark, tmp_path):
    from quillstream.plans import streams as plans

    rows = [(k, 1 + k % 2, "t", 1, json.dumps({"k": k // 4}), None, AT + dt.timedelta(minutes=k * 20), AT) for k in range(10)]
    df = spark.createDataFrame(rows, EVENTS)
    df.repartition(3).write.parquet(str(tmp_path / "session_events.parquet"))
    want = sessions.activity_spans(df).collect()
    got = plans.stream_activity(spark, str(tmp_path)).select("session_id", "n_events", "start_us", "end_us").collect()
    assert want and sorted(got) == sorted(want)
    assert plans.stream_first_deliveries(spark, str(tmp_path)).count() == 6
