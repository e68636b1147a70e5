import json

from pyspark.sql import functions as F

from quillstream.functions.jsontext import UNREADABLE, loads
from quillstream.operators import variants as V


def kids(message=None, attachment=None):
    dump = lambda x: x if x is None or isinstance(x, str) else json.dumps(x)
    return [(k["child"], k["pos"], k["sub_pos"], k["kind"]) for k in V.children(dump(message), dump(attachment)) if k["child"] in V.CASES]


def test_wrapped_and_unreadable():
    assert loads('"{\\"a\\": 1}"') == {"a": 1}
    assert loads('{"a": ') is UNREADABLE
    assert loads('"plain"') == "plain"
    assert loads("[" * 100_000) is UNREADABLE
    assert kids('{"content": "cut') == []


def test_blocks_and_parts():
    message = {"content": [None, {"type": "text", "text": "a"}, {"text": "b"}, "c", {"type": "tool_result", "content": [None, {"type": "image"}, {"type": None}]}, {"type": "tool_result", "content": "no part"}, {"type": "tool_result", "content": {"type": "text"}}]}
    assert kids(message) == [
        ("block", 1, -1, "text"), ("block", 2, -1, ""), ("block", 3, -1, "text"), ("block", 4, -1, "tool_result"), ("part", 4, 1, "image"), ("part", 4, 2, ""),
        ("block", 5, -1, "tool_result"), ("block", 6, -1, "tool_result"), ("part", 6, 0, "text"),
    ]
    assert kids(json.dumps(json.dumps({"content": "x"}))) == [("block", 0, -1, "text")]
    assert kids({"content": {"type": "thinking"}}) == [("block", 0, -1, "thinking")]
    assert kids({"content": None}) == kids({}) == kids("[1]") == kids("3") == []


def test_names():
    assert kids(None, {"addedNames": ["a", None, "b"], "servers": [{"addedNames": ["c"]}, None, {"addedNames": "d"}, {}]}) == [("name", 0, -1, "a"), ("name", 2, -1, "b"), ("name", 0, 0, "c"), ("name", 2, 0, "d")]
    assert kids(None, {"addedNames": "a", "servers": {"addedNames": ["b"]}}) == [("name", 0, -1, "a"), ("name", 0, 0, "b")]


def test_automaton_states():
    assert V.state_of({"type": "text", "text": "a"}) == "text"
    assert V.state_of({"type": "text", "text": 3}) == "object"
    assert V.state_of({"type": "image", "source": {"type": "base64", "data": "x"}}) == "media"
    assert V.state_of([None, "a"]) == "list:string"
    assert V.state_of([1, "a"]) == "list"
    assert V.state_of({"name": "s", "addedNames": ["x"]}) == "server"


def test_elements_are_routed_by_place_and_state():
    rows = list(V.elements(json.dumps({"content": [None, 3, {"type": "text", "text": 3}]}), json.dumps({"addedNames": ["a", None, {"b": 1}], "servers": [None, "x", {"name": "s", "addedNames": ["c"]}]})))
    assert [r and (r["child"], r["parent"], r["pos"], r["sub_pos"], r["variant"]) for r in rows] == [
        None, ("block", "", 1, -1, "object"), ("block", "", 2, -1, "object"), ("name", "", 0, -1, "name"), None, ("name", "", 2, -1, "object"),
        None, ("server", "", 1, -1, "server"), ("server", "", 2, -1, "server"), ("name", "server", 2, 0, "name"),
    ]
    assert rows[-1]["server"] == "s"


def test_tables_keep_links(spark):
    use = {"content": [{"type": "tool_use", "id": "t", "name": "Read", "input": {"path": "é"}}]}
    result = {"content": [{"type": "tool_result", "tool_use_id": "t", "is_error": True, "content": [{"type": "text", "text": "x" * 100_000}]}]}
    rows = [(1, "s", json.dumps(use), None, "k"), (1, "s", json.dumps(use), None, "k"), (2, "s", json.dumps(result), "{", "k"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "record_id long, session_uuid string, message string, attachment string, kind string")
    flat = V.flat_children(df)
    assert flat.count() == 4
    tables = V.variant_tables(df)
    assert tables["tool_use"].select("record_id", "input").distinct().collect() == [(1, '{"path":"é"}')]
    assert tables["text"].select(F.length("text")).collect() == [(100_000,)]
    calls = V.tool_calls(df.dropDuplicates()).collect()
    assert [(c.tool_id, c.result_record_id, c.is_error) for c in calls] == [("t", 2, True)]
    assert V.child_rows(tables).count() == 4 and tables["media"].count() == 0
    assert V.child_rows(V.variant_tables(df.where(F.lit(False)))).count() == 0
    assert V.first_copies(df.withColumn("uuid", F.lit("u"))).where("session_uuid is not null").collect() == [("s", 1, json.dumps(use))]
