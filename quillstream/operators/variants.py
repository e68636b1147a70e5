"""Nested records into related flat tables, routed by the shape of their objects.

A bottom-up tree automaton classifies every element: the states of an object's
members, with the value of its tag, decide the state of the object, and the
state with the place it stands in decides the variant.  Each variant has a
table of its own with typed columns; all of them share the columns that link an
element to its record and to the element it lies in (`COMMON`): a part lies in
the block, a name of a server in the server with the same record_id and pos.

The automaton runs inside `mapInArrow`, one record at a time; nothing is
shuffled.  Its rows are written once, each into the folder of its variant, so a
table is read without the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.functions.jsontext import as_list, compact, loads
from quillstream.sources.tables import shared_dir

# ---- the automaton -----------------------------------------------------------------

#: Transitions for objects, tried in order: variant, tag value (None: any), members and the states each may have.
TRANSITIONS: list[tuple[str, str | None, dict[str, frozenset[str]]]] = [
    ("text", "text", {"text": frozenset(["string", "null"])}),
    ("thinking", "thinking", {}),
    ("tool_use", "tool_use", {"name": frozenset(["string", "null"])}),
    ("tool_result", "tool_result", {"tool_use_id": frozenset(["string", "null"])}),
    ("media", "image", {"source": frozenset(["base64", "object", "null"])}),
    ("media", "document", {"source": frozenset(["base64", "object", "null"])}),
    ("reference", "tool_reference", {}),
    ("base64", "base64", {"data": frozenset(["string", "null"])}),
    ("text", None, {"text": frozenset(["string"])}),
    ("server", None, {"addedNames": frozenset(["list", "list:string", "string", "null"]), "name": frozenset(["string", "null"])}),
    ("object", None, {}),
]


def state_of(value: object) -> str:
    """State of a value: that of its shape, found from the leaves up."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, list):
        inner = {state_of(x) for x in value} - {"null"}
        return f"list:{inner.pop()}" if len(inner) == 1 else "list"
    tag = value.get("type")
    states: dict[str, str] = {}
    for variant, wanted, members in TRANSITIONS:
        if wanted is not None and wanted != tag:
            continue
        for m in members:
            if m not in states:
                states[m] = state_of(value.get(m))
        if all(states[m] in allowed for m, allowed in members.items()) and (wanted is not None or not members or any(m in value for m in members)):
            return variant
    return "object"


#: The variant of an element by the place it stands in and its state; `*`: any other state.  None: no row.
ROUTES: dict[str, dict[str, str | None]] = {
    "content": {"string": "text", "text": "text", "thinking": "thinking", "tool_use": "tool_use", "tool_result": "tool_result", "media": "media", "reference": "reference", "null": None, "*": "object"},
    "servers": {"server": "server", "object": "server", "text": "server", "null": None, "*": "server"},
    "addedNames": {"string": "name", "null": None, "*": "object"},
}


def variant_of(place: str, value: object) -> str | None:
    routes = ROUTES[place]
    state = state_of(value)
    return routes[state] if state in routes else routes["*"]


# ---- children of a record ----------------------------------------------------------

COLUMNS = {
    "record_id": pa.int64(), "child": pa.string(), "parent": pa.string(), "pos": pa.int32(), "sub_pos": pa.int32(), "kind": pa.string(), "variant": pa.string(),
    "text": pa.string(), "tool_id": pa.string(), "name": pa.string(), "input": pa.string(), "is_error": pa.bool_(), "media_type": pa.string(), "server": pa.string(), "body": pa.string(),
}
SPARK = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean"}
SCHEMA = ", ".join(f"{k} {SPARK[t]}" for k, t in COLUMNS.items())
#: Typed columns of each variant beside the common ones.
VARIANT_COLUMNS = {
    "text": ["text"], "thinking": ["text"], "tool_use": ["tool_id", "name", "input"], "tool_result": ["tool_id", "is_error", "text"],
    "media": ["media_type"], "reference": ["name"], "name": ["name", "server"], "server": ["name"], "object": ["body"],
}
COMMON = ["record_id", "child", "parent", "pos", "sub_pos", "kind", "variant"]
#: Kinds of children that are asked for; servers are rows only for what lies in them.
CASES = ["block", "part", "name"]


def _string(value: object) -> str | None:
    return value if isinstance(value, str) or value is None else compact(value)


def _row(child: str, parent: str, pos: int, sub: int, place: str, value: object) -> dict | None:
    """The row of an element, with the typed columns of its variant; None for null."""
    variant = variant_of(place, value)
    if variant is None:
        return None
    members = value if isinstance(value, dict) else {}
    kind = _string(value) if place == "addedNames" else "text" if isinstance(value, str) else _string(members.get("type")) or ""
    row = {"child": child, "parent": parent, "pos": pos, "sub_pos": sub, "kind": kind, "variant": variant}
    if variant == "text":
        row["text"] = value if isinstance(value, str) else members.get("text")
    elif variant == "thinking":
        row["text"] = _string(members.get("thinking", members.get("text")))
    elif variant == "tool_use":
        row |= {"tool_id": _string(members.get("id")), "name": members.get("name"), "input": compact(members["input"]) if members.get("input") is not None else None}
    elif variant == "tool_result":
        row |= {"tool_id": members.get("tool_use_id"), "is_error": members.get("is_error") is True}
        if isinstance(members.get("content"), str):  # other content gives parts
            row["text"] = members["content"]
    elif variant == "media":
        source = members.get("source")
        row["media_type"] = _string(source.get("media_type")) if isinstance(source, dict) else None
    elif variant == "reference":
        row["name"] = _string(members.get("tool_name", members.get("name")))
    elif variant == "name":
        row["name"] = value
    elif variant == "server":
        row["name"] = _string(members.get("name"))
    else:
        row["body"] = compact(value)
    return row


def elements(message: str | None, attachment: str | None) -> Iterator[dict | None]:
    """Rows of the blocks, parts, servers and names of a record, None for nulls; unreadable JSON has none."""
    body = loads(message)
    if isinstance(body, dict):
        for pos, block in enumerate(as_list(body.get("content"))):
            yield _row("block", "", pos, -1, "content", block)
            if isinstance(block, dict) and block.get("type") == "tool_result" and isinstance(block.get("content"), (list, dict)):
                for sub, part in enumerate(as_list(block["content"])):
                    yield _row("part", "block", pos, sub, "content", part)
    body = loads(attachment)
    if isinstance(body, dict):
        for pos, name in enumerate(as_list(body.get("addedNames"))):
            yield _row("name", "", pos, -1, "addedNames", name)
        for pos, server in enumerate(as_list(body.get("servers"))):
            row = _row("server", "", pos, -1, "servers", server)
            yield row
            if isinstance(server, dict):
                for sub, name in enumerate(as_list(server.get("addedNames"))):
                    inner = _row("name", "server", pos, sub, "addedNames", name)
                    yield inner and inner | {"server": row["name"]}


def children(message: str | None, attachment: str | None) -> Iterator[dict]:
    return (row for row in elements(message, attachment) if row is not None)


def flat_children(records: DataFrame) -> DataFrame:
    """All elements of rows (record_id, message, attachment, ...), with the common columns and those of all variants.

    Null, blank and unreadable JSON has no children; null elements keep their
    place but give no row; repeated rows give their children each; a null
    record_id stays null.  Other columns of the input don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(list(COLUMNS.items()))
        for batch in batches:
            rows = [
                {"record_id": record, **child}
                for record, message, attachment in zip(*(batch.column(c).to_pylist() for c in ("record_id", "message", "attachment")), strict=True)
                for child in children(message, attachment)
            ]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in COLUMNS.items()], schema=schema)

    return records.select("record_id", "message", "attachment").where("message is not null or attachment is not null").mapInArrow(run, SCHEMA)


def variant_tables(records: DataFrame) -> dict[str, DataFrame]:
    """The table of each variant: common columns and its typed ones, from one pass over the records."""
    spark = records.sparkSession
    path = shared_dir(spark, "variants")
    flat = flat_children(records)
    flat.withColumn("__folder", F.col("variant")).write.partitionBy("__folder").parquet(path)
    read = lambda v: spark.read.schema(flat.schema).option("pathGlobFilter", "*.parquet").parquet(path + "/*").where(F.col("variant") == v)
    return {v: read(v).select(*COMMON, *columns) for v, columns in VARIANT_COLUMNS.items()}


def child_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """The common columns of all variants' tables: blocks, parts and names, whatever their shape."""
    return reduce(DataFrame.unionByName, [t.select(*COMMON) for t in tables.values()]).where(F.col("child").isin(CASES))


def first_copies(records: DataFrame) -> DataFrame:
    """(session_uuid, record_id, message) of the first copy, by record_id, of each record that has a uuid."""
    once = records.where("uuid is not null").groupBy("session_uuid", "uuid").agg(F.min_by(F.struct("record_id", "message"), "record_id").alias("r"))
    return once.select("session_uuid", "r.*")


def tool_calls(records: DataFrame) -> DataFrame:
    """Tool uses with their results: the two variant tables joined on tool_id within the session.

    records: (record_id, session_uuid, message, ...), each record once (see
    `first_copies`); repeated rows pair with each other.  A use without a result
    keeps nulls; a null tool_id has no partner.
    """
    tables = variant_tables(records.select("record_id", "message", F.lit(None).cast("string").alias("attachment")))
    session = records.select("record_id", "session_uuid")
    uses = tables["tool_use"].join(session, "record_id").select("session_uuid", "record_id", "pos", "tool_id", "name", "input")
    results = tables["tool_result"].join(session, "record_id")
    results = results.select("session_uuid", "tool_id", F.col("record_id").alias("result_record_id"), F.col("pos").alias("result_pos"), "is_error")
    return uses.join(results, ["session_uuid", "tool_id"], "left")
