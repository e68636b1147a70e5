"""Measures over transcripts: calls, bytes, tokens, habits, and how arms compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.operators.numbering import numbered, running
from quillstream.operators.variants import first_copies, variant_tables

# Tools by shape, gates of ratios.
SHAPES = {"read": ["Read", "PullPage"], "edit": ["Edit", "MultiEdit"], "write": ["Write"], "grep": ["Grep", "Glob"], "list": ["LS", "ListJobs"], "command": ["Bash"], "search": ["Search"]}
GATES = [(1.0, "failing"), (0.75, "no_gain"), (0.5, "viable")]
NEAR_GATE = 0.15
# Types of records; what a result says of a call that was denied.
RECORD_TYPES = ["assistant", "user", "attachment", "queue-operation", "last-prompt", "ai-title", "system", "summary"]
DENIED = r"(?i)\b(permission denied|was denied|was rejected|not allowed)\b"


def shape_of(name: Column) -> Column:
    base = F.regexp_replace(name, r"\d+$", "")
    return F.coalesce(*[F.when(base.isin(tools), F.lit(s)) for s, tools in SHAPES.items()], F.lit("other"))


def calls(records: DataFrame) -> DataFrame:
    """Tool uses of each session in order, with shape, target, bytes served and error; a repeated record counts once.

    The order is that of arrival (record_id, place in the message).
    """
    once = first_copies(records.where("not coalesce(is_sidechain, false)"))
    tables = variant_tables(once.withColumn("attachment", F.lit(None).cast("string")))
    owner = once.select("record_id", "session_uuid")
    uses = tables["tool_use"].join(owner, "record_id")
    results = tables["tool_result"].join(owner, "record_id").select("session_uuid", "tool_id", "record_id", "pos", "is_error")
    texts = tables["text"].where("child = 'part'").select("record_id", "pos", "text").unionByName(tables["tool_result"].where("child = 'block'").select("record_id", "pos", "text"))
    body = texts.groupBy("record_id", "pos").agg(F.sum(F.octet_length("text")).alias("n_bytes"))
    served = results.join(body, ["record_id", "pos"], "left")
    last = served.groupBy("session_uuid", "tool_id").agg(F.max_by(F.struct(F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"), "is_error"), F.struct("record_id", "pos")).alias("last"))
    joined = uses.join(last, ["session_uuid", "tool_id"], "left")
    target = F.coalesce(F.get_json_object("input", "$.file_path"), F.get_json_object("input", "$.path"), F.regexp_replace(F.get_json_object("input", "$.command"), r"\s+", " "), F.lit(""))
    cut = joined.select("session_uuid", "record_id", "pos", "sub_pos", "name", shape_of(F.col("name")).alias("shape"), target.alias("target"), F.col("last.n_bytes").alias("n_bytes"), F.coalesce("last.is_error", F.lit(False)).alias("is_error"))
    rows = numbered(cut, ["session_uuid"], F.expr("record_id div 65536"), ["record_id", "pos", "sub_pos"], "call_no")
    return rows.select("session_uuid", "record_id", F.col("call_no").cast("int").alias("call_no"), "name", "shape", "target", "n_bytes", "is_error")


def habits(calls_: DataFrame) -> DataFrame:
    """Per session: reads right before edits of the same target, and looks at targets edited within the last three calls."""
    touches = calls_.where(F.col("shape").isin("read", "edit", "write") & (F.col("target") != ""))
    earlier = F.lag("shape").over(Window.partitionBy("session_uuid", "target").orderBy("call_no"))
    pairs = touches.withColumn("earlier", earlier).groupBy("session_uuid").agg(F.sum(((F.col("shape") == "edit") & F.col("earlier").eqNullSafe("read")).cast("int")).alias("read_before_edit"))
    back = Window.partitionBy("session_uuid").orderBy("call_no").rowsBetween(-3, -1)
    edited = F.collect_set(F.when(F.col("shape").isin("edit", "write") & (F.col("target") != ""), F.col("target"))).over(back)
    loops = calls_.withColumn("edited", edited).groupBy("session_uuid").agg(F.count(F.lit(1)).alias("n_calls"), F.sum((F.col("shape").isin("read", "grep") & F.array_contains("edited", F.col("target"))).cast("int")).alias("probe_loops"))
    return loops.join(pairs, "session_uuid", "left").fillna(0, ["read_before_edit"])


def segments(records: DataFrame) -> DataFrame:
    """(session_uuid, record_id, segment): how many boundaries (system records) of its session came before a record."""
    marked = records.select("session_uuid", "record_id", (F.col("record_type").eqNullSafe("system")).cast("long").alias("__edge"))
    return running(marked, ["session_uuid"], F.expr("record_id div 65536"), ["record_id"], "__edge", "segment").drop("__edge")


def rereads(calls_: DataFrame, segments_: DataFrame) -> DataFrame:
    """Calls with their segment, and whether a read or a command looks at what was looked at in an earlier segment of the session."""
    placed = calls_.join(segments_.select("record_id", "segment"), "record_id")
    looks = F.col("shape").isin("read", "command") & (F.col("target") != "")
    first = placed.where(looks).groupBy("session_uuid", "target").agg(F.min("segment").alias("first_segment"))
    joined = placed.join(first, ["session_uuid", "target"], "left")
    return joined.withColumn("reread", looks & F.coalesce(F.col("first_segment") < F.col("segment"), F.lit(False))).drop("first_segment")


def state_flags(records: DataFrame) -> DataFrame:
    """Per session: whether any record is a boundary, comes from a hook, adds tools, or tells of a denial; and the first model named."""
    said, attached = F.col("message"), F.col("attachment")
    kind = F.get_json_object("attachment", "$.type")
    denied = F.coalesce(said.rlike(DENIED), F.lit(False))
    model = F.get_json_object("message", "$.model")
    any_ = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    return records.groupBy("session_uuid").agg(
        any_(F.col("record_type") == "system").alias("any_boundary"), any_(kind == "hook_result").alias("any_hook"), any_(attached.contains('"addedNames"')).alias("any_added"),
        any_(denied).alias("any_denied"), F.min_by(model, F.when(F.coalesce(model, F.lit("")) != "", F.col("record_id"))).alias("model"),
    )


def unknown_shapes(records: DataFrame) -> DataFrame:
    """(what, kind, n): record types and kinds of blocks that aren't known; a strict reader refuses a transcript with any."""
    types = records.where(~F.coalesce("record_type", F.lit("")).isin(*RECORD_TYPES)).groupBy(F.lit("record").alias("what"), F.coalesce("record_type", F.lit("")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    tables = variant_tables(records.select("record_id", "message", F.lit(None).cast("string").alias("attachment")))
    blocks = tables["object"].where("child in ('block', 'part')").groupBy(F.col("child").alias("what"), "kind").agg(F.count(F.lit(1)).alias("n"))
    return types.unionByName(blocks)


def known_only(records: DataFrame) -> DataFrame:
    """The records as they are; a run over them fails at a record whose type isn't known."""
    kind = F.coalesce("record_type", F.lit(""))
    return records.withColumn("record_type", F.when(kind.isin(*RECORD_TYPES), F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("unknown record type: "), kind)).cast("string")))


def unwrapped(message: Column) -> Column:
    """What a JSON string holds, if it holds JSON; else the message itself."""
    inner = F.call_function("try_variant_get", F.call_function("try_parse_json", message), F.lit("$"), F.lit("string"))
    return F.when(message.rlike(r'^\s*"') & F.call_function("try_parse_json", inner).isNotNull(), inner).otherwise(message)


def usage(records: DataFrame) -> DataFrame:
    """Tokens per session; each message id counts once, with the first record that has it.  A wrapped JSON string counts as what it wraps."""
    told = records.where("message is not null and try_parse_json(message) is not null").withColumn("message", unwrapped(unwrapped(F.col("message"))))
    body = told.select("session_uuid", "record_id", *[F.get_json_object("message", f"$.{p}").alias(n) for p, n in (("id", "message_id"), ("usage.output_tokens", "output"), ("usage.input_tokens", "input"))])
    first = body.where("message_id is not null").groupBy("session_uuid", "message_id").agg(F.min_by(F.struct("output", "input"), "record_id").alias("u"))
    number = lambda c: F.sum(F.coalesce(F.col(c).try_cast("long"), F.lit(0)))
    return first.groupBy("session_uuid").agg(F.count(F.lit(1)).alias("n_messages"), number("u.output").alias("output_tokens"), number("u.input").alias("input_tokens"))


def verdict(ratio: Column) -> Column:
    return F.coalesce(*[F.when(ratio > at, F.lit(name)) for at, name in GATES], F.when(ratio.isNotNull(), F.lit("success")), F.lit("inconclusive"))


def arm_ratios(cells: DataFrame, baseline: str = "raw") -> DataFrame:
    """Mean of `value` per (task, arm) and its ratio to the baseline arm of the task; no ratio without a baseline above 0."""
    means = cells.groupBy("task", "arm").agg(F.avg("value").alias("mean_value"), F.count("value").alias("n_cells"))
    base = means.where(F.col("arm") == baseline).select("task", F.col("mean_value").alias("base_value"))
    ratio = F.when(F.col("base_value") > 0, F.col("mean_value") / F.col("base_value"))
    joined = means.join(base, "task", "left").withColumn("ratio", ratio)
    near = F.coalesce(F.least(*[F.abs(F.col("ratio") - at) for at, _ in GATES]) <= NEAR_GATE, F.lit(False))
    return joined.withColumn("needs_more", near & (F.col("arm") != baseline))


def arm_verdicts(ratios: DataFrame, baseline: str = "raw") -> DataFrame:
    """Median ratio of each arm over its tasks, and the verdict."""
    by = ratios.where(F.col("arm") != baseline).groupBy("arm").agg(F.median("ratio").alias("median_ratio"), F.count("ratio").alias("n_tasks"), F.max("needs_more").alias("needs_more"))
    return by.withColumn("verdict", verdict(F.col("median_ratio")))


def decomposition(cells: DataFrame, calls_: DataFrame) -> DataFrame:
    """Per task and arm of cells (session_uuid, task, arm): their number and means of calls, bytes per call and share of errors; 0 where there are no calls."""
    made = calls_.groupBy("session_uuid").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("n_bytes", F.lit(0))).alias("bytes"), F.sum(F.col("is_error").cast("int")).alias("errors"))
    joined = cells.groupBy("task", "arm", "session_uuid").agg(F.count(F.lit(1)).alias("times")).join(made, "session_uuid", "left").fillna(0, ["n", "bytes", "errors"])
    per_call = lambda c: F.round(F.avg(F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(0.0)), 6)
    return joined.groupBy("task", "arm").agg(
        F.count(F.lit(1)).alias("n_cells"), F.round(F.avg("n"), 6).alias("mean_calls"), per_call("bytes").alias("mean_bytes_per_call"), per_call("errors").alias("mean_error_rate")
    )
