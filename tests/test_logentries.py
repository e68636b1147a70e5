import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillstream.operators import logentries as L
from quillstream.operators.earley import Grammar

AT = dt.datetime(2026, 5, 6, 7, 8, 9)


def ms(*a):
    return int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp() * 1000)


def found(text, kind="entry"):
    return [e[1:] for e in L.entries(text, AT) if e[0] == kind]


def test_earley_prefers_the_higher_weight():
    g = Grammar("S", [("S", "A B", 0), ("S", "B", 1), ("A", "x", 0), ("A", "A x", 0), ("B", "x", 0), ("B", "x x", 5), ("S", "REST", -1)])
    assert g.parse(("x", "x", "x"))[0] == 5
    assert g.parse(("x",))[0] == 1
    assert g.parse(("y", "z"))[0] == -1
    assert g.parse(()) is None


@pytest.mark.parametrize(
    ("line", "time", "level", "component"),
    [
        ("2026-05-06 01:02:03,456 - app.core - WARNING - hello", ms(2026, 5, 6, 1, 2, 3) + 456, "warn", "app.core"),
        ("E0506 01:02:03.456789   17 file.go:9] hello", ms(2026, 5, 6, 1, 2, 3) + 456, "error", "file.go"),
        ("[rank 3] 2026-05-06T01:02:03.456Z hello", ms(2026, 5, 6, 1, 2, 3) + 456, "", "rank 3"),
        ("[rank 3] 2026-05-06T01:02:03.456Z CRITICAL hello", ms(2026, 5, 6, 1, 2, 3) + 456, "fatal", "rank 3"),
        ("2026-05-06 01:02:03.456   ERR 12 --- [pool-1] a.b.C : hello", ms(2026, 5, 6, 1, 2, 3) + 456, "error", "a.b.C"),
        ('time=2026-05-06T01:02:03.456-05:00 level=inf component=x msg="hello" n=1', ms(2026, 5, 6, 6, 2, 3) + 456, "info", "x"),
        ('time=2026-05-06T01:02:03.456+02:00 level=dbg msg="a component=y" component=x', ms(2026, 5, 5, 23, 2, 3) + 456, "debug", "x"),
        ("May  6 01:02:03 host prog-a[12]: warning: hello", ms(2026, 5, 6, 1, 2, 3), "warn", "prog-a"),
        ("May  6 01:02:03 host prog-a[12]: hello", ms(2026, 5, 6, 1, 2, 3), "", "prog-a"),
        ("[1778029323.456789] (EE) part: hello", 1778029323456, "error", "part"),
        ("2026/05/06 01:02:03 main.go:12: hello", ms(2026, 5, 6, 1, 2, 3), "", "main.go"),
        ("svc-1  | 2026-05-06T01:02:03Z PANIC hello", ms(2026, 5, 6, 1, 2, 3), "fatal", "svc-1"),
        ("01:02:03.456 INF   [part] hello", ms(2026, 5, 6, 1, 2, 3) + 456, "info", "part"),
        ("\x1b[36m01:02:03.456\x1b[0m \x1b[33mWRN\x1b[0m [part] hello\r", ms(2026, 5, 6, 1, 2, 3) + 456, "warn", "part"),
        ('{"level": 50, "time": 1778029323456, "name": "a.b", "msg": "x"}', 1778029323456, "error", "a.b"),
        ('{"ts":"2026-05-06T01:02:03.456Z","lvl":"trc","logger":"a","message":"x"}', ms(2026, 5, 6, 1, 2, 3) + 456, "trace", "a"),
    ],
)
def test_layouts(line, time, level, component):
    assert [(e[0], e[1], *e[2:5]) for e in found(line)] == [(1, 1, time, level, component)]


def test_earley_shares_prefixes_and_takes_lists_of_any_length():
    g = Grammar("S", [("S", "L END", 0), ("S", "L REST", -1), ("L", "x", 0.5), ("L", "L , SOLID", 0.5)])
    tokens = ["x"] + [",", "y"] * 3_000
    assert g.parse([*tokens, "END"])[0] == 0.5 * 3_001
    assert g.parse([*tokens, "WS"])[0] == 0.5 * 3_001 - 1
    assert g.parse(["y"]) is None
    assert g.n_prefixes <= 201


@pytest.mark.parametrize("before", [0, 4, 20, 3_000])
def test_time_after_any_number_of_pairs(before):
    line = " ".join(f"key{k}=v.{k}" for k in range(before)) + ' time=2026-05-06T01:02:03.456Z some words level=warn n=1 component="a b"' + " x=y" * 500
    assert [(e[0], e[1], *e[2:5]) for e in found(line.strip())] == [(1, 1, ms(2026, 5, 6, 1, 2, 3) + 456, "warn", "a b")]


def test_json_of_any_depth_and_rest():
    deep = '{"a": ' + "[" * 3_000 + "]" * 3_000 + ', "time": "2026-05-06T01:02:03Z", "level": 40, "logger": "x\\ty"} tail'
    assert [(e[0], e[1], *e[2:5]) for e in found(deep)] == [(1, 1, ms(2026, 5, 6, 1, 2, 3), "warn", "x\ty")]
    assert found('{"a": 1, "time": null}') == [] and found("{") == [] and found("{}") == []


def test_entries_over_several_lines():
    text = "reading\n01:02:03.456 ERR [a] first\nTraceback (most recent call last):\n  File x\n\nKeyError: 'a'\n\n01:02:04.000 INF [b] second\n"
    assert [(e[0], e[1], e[4]) for e in found(text)] == [(2, 6, "a"), (8, 8, "b")]
    assert [(e[0], e[1]) for e in found(text, "unparsed")] == [(1, 1)]


def test_json_over_several_lines_and_cut():
    text = '{\n  "time": "2026-05-06T01:02:03Z",\n  "severity": "INFO",\n  "component": "c",\n  "attrs": {\n    "time": "no"\n  }\n}\n{\n  "time": "2026-05-06T01:02:04Z",\n  "sever'
    assert [(e[0], e[1], e[3], e[4]) for e in found(text)] == [(1, 8, "info", "c"), (9, 11, "", "")]


@pytest.mark.parametrize(
    "text",
    [
        "time,ms,state\n2026-04-26 15:00:00,19,ok\n2026-04-26 16:00:00,20,ok",
        "-rw-r--r-- 1 app app  85528 Apr 20 00:18 cache.rs",
        "commit e89b958f34e4a1356c183176533aad7160a4cc17\nAuthor: a <b@c>\nDate:   Wed Apr 26 05:12:10 2026 +0000\n\n    2026-04-26 15:00:00 text",
        "ok   a/b 7.812s",
        "report.py:867:call(queue)",
        "==> a.sql <==\n$ tail -n 40 x\nstarting 4 lanes",
        "",
        "\n \r\n",
    ],
)
def test_other_things_are_no_entries(text):
    assert found(text) == []


def test_listing_after_entries_belongs_to_none():
    text = "01:02:03.456 ERR [a] first\n-rw-r--r-- 1 app app  85528 Apr 20 00:18 cache.rs\n    more"
    assert [(e[0], e[1]) for e in found(text)] == [(1, 1)]
    assert [(e[0], e[1]) for e in found(text, "unparsed")] == [(2, 3)]


def test_on_spark_with_nulls_repeats_and_extra_columns(spark):
    rows = [(1, AT, "01:02:03.456 ERR [a] x", None, "k", 9), (1, AT, "01:02:03.456 ERR [a] x", "", "k", 9), (2, None, None, "01:02:03.456 ERR [a] x", "k", 9), (None, None, "2026-05-06 01:02:03,456 - a - INFO - x", "y" * 200_000, "k", 9)]
    df = spark.createDataFrame(rows, "event_id long, observed_at timestamp_ntz, stdout string, stderr string, stream string, first_line int")
    got = L.log_entries(df)
    assert sorted((r.event_id or 0, r.stream, r.ts_ms or 0) for r in got.collect()) == [(0, "stdout", ms(2026, 5, 6, 1, 2, 3) + 456), (1, "stdout", ms(2026, 5, 6, 1, 2, 3) + 456), (1, "stdout", ms(2026, 5, 6, 1, 2, 3) + 456), (2, "stderr", 0)]
    assert L.log_entries(df.where(F.lit(False))).count() == 0
    assert [(r.first_line, r.last_line) for r in L.unparsed_spans(df).collect()] == [(1, 1)]
