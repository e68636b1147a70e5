"""Queries of transcript measures and of how arms compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators import transcripts as T
from quillstream.plans.core_problems import nested_sql, read_sql
from quillstream.plans.registry import query
from quillstream.sources.tables import read_table

_USAGE = f"""SELECT session_uuid, count(*) AS n_messages, sum(coalesce(output, 0))::BIGINT AS output_tokens, sum(coalesce(input, 0))::BIGINT AS input_tokens FROM (
  SELECT session_uuid, message_id, arg_min(coalesce(output, 0), record_id) AS output, arg_min(coalesce(input, 0), record_id) AS input FROM (
    SELECT session_uuid, record_id, j ->> '$.id' AS message_id, TRY_CAST(j ->> '$.usage.output_tokens' AS BIGINT) AS output,
    TRY_CAST(j ->> '$.usage.input_tokens' AS BIGINT) AS input FROM ({read_sql('message', 'SELECT session_uuid, record_id, message FROM transcript_records')}) WHERE json_type(j) = 'OBJECT')
    WHERE message_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1"""
_CELLS = f"""SELECT s.namespace AS task, a.label_value AS arm, u.output_tokens AS value FROM ({_USAGE}) u
  JOIN session_labels h ON h.label_key = 'harness_session' AND h.label_value = u.session_uuid
  JOIN session_labels a ON a.label_key = 'arm' AND a.session_id = h.session_id JOIN sessions s ON s.id = h.session_id"""
_MEANS = f"SELECT task, arm, avg(value) AS mean_value, count(value) AS n_cells FROM ({_CELLS}) GROUP BY 1, 2"
_RATIOS = f"""SELECT m.task, m.arm, m.mean_value, m.n_cells, CASE WHEN b.mean_value > 0 THEN m.mean_value / b.mean_value END AS ratio FROM ({_MEANS}) m
  LEFT JOIN ({_MEANS}) b ON b.task = m.task AND b.arm = 'raw'"""
_NEAR = "(arm <> 'raw' AND coalesce(least(abs(ratio - 1.0), abs(ratio - 0.75), abs(ratio - 0.5)) <= 0.15, false))"


_MAIN = """SELECT record_id, session_uuid, message, NULL::VARCHAR AS attachment FROM transcript_records
  WHERE uuid IS NOT NULL AND NOT coalesce(is_sidechain, false) QUALIFY row_number() OVER (PARTITION BY session_uuid, uuid ORDER BY record_id) = 1"""
_SHAPE = f"CASE {' '.join('WHEN base IN (' + ', '.join(repr(t) for t in tools) + f') THEN {shape!r}' for shape, tools in T.SHAPES.items())} ELSE 'other' END"
_TAGGED = "'thinking', 'tool_use', 'tool_result', 'image', 'document', 'tool_reference', 'base64'"
_CALLS = f"""WITH nested AS (SELECT n.*, m.session_uuid FROM ({nested_sql(_MAIN)}) n JOIN ({_MAIN}) m USING (record_id)),
  uses AS (SELECT session_uuid, record_id, pos, sub_pos, b ->> '$.id' AS tool_id, b ->> '$.name' AS name, json_extract(b, '$.input') AS i FROM nested WHERE kind = 'tool_use'),
  texts AS (SELECT record_id, pos, CASE WHEN child = 'part' AND json_type(b) = 'VARCHAR' THEN b ->> '$' WHEN child = 'part' AND json_type(b, '$.text') = 'VARCHAR' AND kind NOT IN ({_TAGGED}) THEN b ->> '$.text'
    WHEN child = 'block' AND kind = 'tool_result' AND json_type(b, '$.content') = 'VARCHAR' THEN b ->> '$.content' END AS t FROM nested),
  sizes AS (SELECT record_id, pos, sum(octet_length(encode(t))) AS n_bytes FROM texts GROUP BY 1, 2),
  results AS (SELECT session_uuid, b ->> '$.tool_use_id' AS tool_id, record_id, pos, coalesce(json_type(b, '$.is_error') = 'BOOLEAN' AND b ->> '$.is_error' = 'true', false) AS is_error FROM nested WHERE kind = 'tool_result'),
  last AS (SELECT session_uuid, tool_id, coalesce(n_bytes, 0)::BIGINT AS n_bytes, is_error FROM results LEFT JOIN sizes USING (record_id, pos)
    QUALIFY row_number() OVER (PARTITION BY session_uuid, tool_id ORDER BY record_id DESC, pos DESC) = 1),
  calls AS (SELECT session_uuid, record_id, CAST(row_number() OVER (PARTITION BY session_uuid ORDER BY record_id, pos, sub_pos) AS INTEGER) AS call_no, name,
    {_SHAPE} AS shape, target, n_bytes, is_error FROM (SELECT u.*, l.n_bytes, coalesce(l.is_error, false) AS is_error, regexp_replace(name, '[0-9]+$', '') AS base,
      coalesce(i ->> '$.file_path', i ->> '$.path', regexp_replace(i ->> '$.command', '\\s+', ' ', 'g'), '') AS target FROM uses u LEFT JOIN last l USING (session_uuid, tool_id))),
  segments AS (SELECT session_uuid, record_id, sum(CASE WHEN record_type = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY session_uuid ORDER BY record_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM transcript_records)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "transcript_records")


@query(f"{_CALLS} SELECT * FROM calls")
def transcript_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.calls(_records(spark, sf_dir))


@query(f"""{_CALLS} SELECT shape, count(*) AS n_calls, sum(coalesce(n_bytes, 0))::BIGINT AS n_bytes, sum(CASE WHEN is_error THEN 1 ELSE 0 END)::BIGINT AS n_errors,
  round(sum(coalesce(n_bytes, 0)) / count(*), 6) AS bytes_per_call FROM calls GROUP BY 1""")
def transcript_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = T.calls(_records(spark, sf_dir)).groupBy("shape").agg(F.count(F.lit(1)).alias("n_calls"), F.sum(F.coalesce("n_bytes", F.lit(0))).alias("n_bytes"), F.sum(F.col("is_error").cast("int")).alias("n_errors"))
    return by.withColumn("bytes_per_call", F.round(F.when(F.col("n_calls") > 0, F.col("n_bytes") / F.col("n_calls")).otherwise(0.0), 6))


@query(f"""{_CALLS}, pairs AS (SELECT session_uuid, sum(CASE WHEN shape = 'edit' AND earlier = 'read' THEN 1 ELSE 0 END)::BIGINT AS n FROM (
    SELECT *, lag(shape) OVER (PARTITION BY session_uuid, target ORDER BY call_no) AS earlier FROM calls WHERE shape IN ('read', 'edit', 'write') AND target <> '') GROUP BY 1)
  SELECT session_uuid, n_calls, probe_loops, coalesce(n, 0) AS read_before_edit FROM (SELECT session_uuid, count(*) AS n_calls,
    sum(CASE WHEN shape IN ('read', 'grep') AND coalesce(list_contains(edited, target), false) THEN 1 ELSE 0 END)::BIGINT AS probe_loops FROM (
    SELECT *, list(CASE WHEN shape IN ('edit', 'write') AND target <> '' THEN target END) OVER (PARTITION BY session_uuid ORDER BY call_no ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS edited FROM calls) GROUP BY 1)
  LEFT JOIN pairs USING (session_uuid)""")
def transcript_habits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.habits(T.calls(_records(spark, sf_dir)))


@query(f"""{_CALLS} SELECT session_uuid, max(segment) + 1 AS n_segments, coalesce(max(n_rereads), 0) AS n_rereads FROM segments LEFT JOIN (
  SELECT session_uuid, count(*) AS n_rereads FROM (SELECT session_uuid, segment, min(segment) OVER (PARTITION BY session_uuid, target) AS first_segment FROM calls JOIN segments USING (session_uuid, record_id)
    WHERE shape IN ('read', 'command') AND target <> '') WHERE first_segment < segment GROUP BY 1) USING (session_uuid) GROUP BY 1""")
def transcript_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per session: stretches between boundaries, and looks at what was looked at before the last boundary."""
    records = _records(spark, sf_dir)
    segments = T.segments(records)
    again = T.rereads(T.calls(records), segments).where("reread").groupBy("session_uuid").agg(F.count(F.lit(1)).alias("n_rereads"))
    by = segments.groupBy("session_uuid").agg((F.max("segment") + 1).alias("n_segments"))
    return by.join(again, "session_uuid", "left").fillna(0, ["n_rereads"])


@query(r"""SELECT session_uuid, bool_or(coalesce(record_type = 'system', false)) AS any_boundary, bool_or(coalesce(kind = 'hook_result', false)) AS any_hook, bool_or(coalesce(contains(attachment, '"addedNames"'), false)) AS any_added,
  bool_or(coalesce(regexp_matches(message, '(?i)\b(permission denied|was denied|was rejected|not allowed)\b'), false)) AS any_denied, arg_min(model, record_id) FILTER (WHERE coalesce(model, '') <> '') AS model
  FROM (SELECT *, CASE WHEN json_valid(attachment) THEN json_extract_string(attachment, '$.type') END AS kind, CASE WHEN json_valid(message) THEN json_extract_string(message, '$.model') END AS model FROM transcript_records) GROUP BY 1""")
def transcript_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.state_flags(_records(spark, sf_dir))


@query("SELECT 'record' AS what, coalesce(record_type, '') AS kind, count(*) AS n FROM transcript_records WHERE coalesce(record_type, '') NOT IN ({}) GROUP BY 2".format(", ".join(repr(t) for t in T.RECORD_TYPES)))
def transcript_unknown_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.unknown_shapes(_records(spark, sf_dir)).where("what = 'record'")


@query(_USAGE)
def transcript_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.usage(_records(spark, sf_dir))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "session_labels")
    harness = labels.where("label_key = 'harness_session'").select("session_id", F.col("label_value").alias("session_uuid"))
    arms = labels.where("label_key = 'arm'").select("session_id", F.col("label_value").alias("arm"))
    tasks = read_table(spark, sf_dir, "sessions").select(F.col("id").alias("session_id"), F.col("namespace").alias("task"))
    return T.usage(_records(spark, sf_dir)).join(harness, "session_uuid").join(arms, "session_id").join(tasks, "session_id").select("task", "arm", F.col("output_tokens").alias("value"))


@query(f"SELECT task, arm, round(mean_value, 6) AS mean_value, n_cells, round(ratio, 6) AS ratio, {_NEAR} AS needs_more FROM ({_RATIOS})")
def arms_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.arm_ratios(_cells(spark, sf_dir)).select("task", "arm", F.round("mean_value", 6).alias("mean_value"), "n_cells", F.round("ratio", 6).alias("ratio"), "needs_more")


@query(f"""SELECT arm, round(m, 6) AS median_ratio, n_tasks, needs_more, CASE WHEN m IS NULL THEN 'inconclusive' WHEN m > 1.0 THEN 'failing' WHEN m > 0.75 THEN 'no_gain' WHEN m > 0.5 THEN 'viable' ELSE 'success' END AS verdict
  FROM (SELECT arm, median(ratio) AS m, count(ratio) AS n_tasks, bool_or({_NEAR}) AS needs_more FROM ({_RATIOS}) WHERE arm <> 'raw' GROUP BY 1)""")
def arms_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.arm_verdicts(T.arm_ratios(_cells(spark, sf_dir))).withColumn("median_ratio", F.round("median_ratio", 6))


@query("""SELECT session_uuid, arg_min(cwd, record_id) FILTER (WHERE cwd IS NOT NULL) AS cwd, arg_min(cli_version, record_id) FILTER (WHERE cli_version IS NOT NULL) AS cli_version,
  count(*) AS n_records, count(DISTINCT uuid) AS n_uuids, bool_or(coalesce(is_sidechain, false)) AS any_sidechain FROM transcript_records GROUP BY 1""")
def transcript_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("record_id"))).alias(c)
    return _records(spark, sf_dir).groupBy("session_uuid").agg(first("cwd"), first("cli_version"), F.count(F.lit(1)).alias("n_records"), F.count_distinct("uuid").alias("n_uuids"), F.bool_or(F.coalesce("is_sidechain", F.lit(False))).alias("any_sidechain"))


@query("""SELECT s.client, coalesce(t.label_value, '') AS arm, count(DISTINCT e.session_id) AS n_sessions, count(*) AS n_errors, round(count(*) / count(DISTINCT e.session_id), 6) AS errors_per_session
  FROM session_events e JOIN sessions s ON s.id = e.session_id LEFT JOIN session_labels t ON t.session_id = s.id AND t.label_key = 'arm' WHERE e.type = 'error_observed' GROUP BY 1, 2""")
def outcomes_by_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = read_table(spark, sf_dir, "session_labels").where("label_key = 'arm'").select("session_id", F.col("label_value").alias("arm"))
    sessions = read_table(spark, sf_dir, "sessions").select(F.col("id").alias("session_id"), "client")
    errors = read_table(spark, sf_dir, "session_events").where("type = 'error_observed'").select("session_id")
    by = errors.join(sessions, "session_id").join(arms, "session_id", "left").groupBy("client", F.coalesce("arm", F.lit("")).alias("arm"))
    out = by.agg(F.count_distinct("session_id").alias("n_sessions"), F.count(F.lit(1)).alias("n_errors"))
    return out.withColumn("errors_per_session", F.round(F.col("n_errors") / F.col("n_sessions"), 6))


@query(f"""{_CALLS}, arms AS (SELECT h.label_value AS session_uuid, a.label_value AS arm, s.namespace AS task FROM session_labels h JOIN session_labels a ON a.session_id = h.session_id AND a.label_key = 'arm'
    JOIN sessions s ON s.id = h.session_id WHERE h.label_key = 'harness_session'),
  cells AS (SELECT task, arm, session_uuid, count(c.call_no) AS n, sum(coalesce(n_bytes, 0)) AS bytes, sum(CASE WHEN is_error THEN 1 ELSE 0 END) AS errors FROM arms LEFT JOIN calls c USING (session_uuid) GROUP BY 1, 2, 3)
  SELECT task, arm, count(*) AS n_cells, round(avg(n), 6) AS mean_calls, round(avg(CASE WHEN n > 0 THEN bytes / n ELSE 0 END), 6) AS mean_bytes_per_call, round(avg(CASE WHEN n > 0 THEN errors / n ELSE 0 END), 6) AS mean_error_rate
  FROM cells GROUP BY 1, 2""")
def arms_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cost of a cell is made of, as means per task and arm: calls, bytes per call, share of errors (0 where there are no calls)."""
    labels = read_table(spark, sf_dir, "session_labels")
    harness = labels.where("label_key = 'harness_session'").select("session_id", F.col("label_value").alias("session_uuid"))
    arms = labels.where("label_key = 'arm'").select("session_id", F.col("label_value").alias("arm"))
    tasks = read_table(spark, sf_dir, "sessions").select(F.col("id").alias("session_id"), F.col("namespace").alias("task"))
    cells = harness.join(arms, "session_id").join(tasks, "session_id").select("session_uuid", "task", "arm")
    return T.decomposition(cells, T.calls(_records(spark, sf_dir)))
