"""Queries of the general problems: log entries, repeated deliveries, nested records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators.delivery import deduplicated_events
from quillstream.operators.logentries import log_entries, unparsed_spans
from quillstream.operators.variants import child_rows, first_copies, tool_calls, variant_tables
from quillstream.sources.tables import read_table, table_path


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = log_entries(read_table(spark, sf_dir, "observe_events"))
    return found.select("event_id", "stream", "first_line", "last_line", "ts_ms", "level", "component")


def p2_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_entries(read_table(spark, sf_dir, "observe_events"))


def p2_unparsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unparsed_spans(read_table(spark, sf_dir, "observe_events"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated_events(spark, table_path(sf_dir, "session_events"), ["id"], deleted=True)


def p4_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated_events(spark, table_path(sf_dir, "session_events"), ["id", "session_id", "type", "priority", "data", "batch_id"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return child_rows(variant_tables(read_table(spark, sf_dir, "transcript_records"))).select("record_id", "child", "pos", "sub_pos", "kind")


def p5_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the variants' tables by child and kind of object."""
    rows = child_rows(variant_tables(read_table(spark, sf_dir, "transcript_records")))
    kind = F.when(F.col("child") == "name", "").otherwise(F.col("kind")).alias("kind")
    return rows.groupBy("variant", "child", kind).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("record_id").alias("n_records"))


def p5_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by server, over the parent links: a name of a server points to the server's row."""
    tables = variant_tables(read_table(spark, sf_dir, "transcript_records").select("record_id", F.lit(None).cast("string").alias("message"), "attachment"))
    servers = tables["server"].select("record_id", "pos", F.coalesce("name", F.lit("")).alias("server_name"))
    names = tables["name"].where("parent = 'server'").select("record_id", "pos", "name")
    return names.join(servers, ["record_id", "pos"]).groupBy("server_name").agg(F.count(F.lit(1)).alias("n_names"), F.count_distinct("name").alias("n_distinct"))


def p5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = tool_calls(first_copies(read_table(spark, sf_dir, "transcript_records")))
    return calls.groupBy("name").agg(F.count(F.lit(1)).alias("n_uses"), F.count("result_pos").alias("n_results"), F.sum(F.coalesce(F.col("is_error"), F.lit(False)).cast("int")).alias("n_errors"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_entries, p2_unparsed, p4_found, p4_kept, p5_found, p5_variants, p5_names, p5_tool_calls)}

_NUMBERED = """
    SELECT *, row_number() OVER (PARTITION BY session_id, type, coalesce(data_hash,
      unhex(sha256(unhex(printf('%016X', octet_length(encode(coalesce(type, ''))))) || encode(coalesce(type, ''))
      || unhex(printf('%016X', octet_length(encode(coalesce(data, ''))))) || encode(coalesce(data, '')))))
      ORDER BY id) AS copy_no FROM session_events"""
_UNWRAPPED = "CASE WHEN json_type({0}) = 'VARCHAR' AND regexp_matches({0} ->> '$', '^\\s*[{{\\[\"]') THEN CASE WHEN json_valid({0} ->> '$') THEN ({0} ->> '$')::JSON END ELSE {0} END"
_LIST = "CASE json_type({0}) WHEN 'ARRAY' THEN json_extract({0}, '$[*]') WHEN 'NULL' THEN [] ELSE [{0}] END"
_TEXT = "CASE WHEN json_type({0}) = 'VARCHAR' THEN {0} ->> '$' ELSE CAST({0} AS VARCHAR) END"
_TYPE = "CASE WHEN json_type({0}) = 'VARCHAR' THEN 'text' WHEN json_type({0}) <> 'OBJECT' OR coalesce(json_type({0}, '$.type'), 'NULL') = 'NULL' THEN '' ELSE {0} ->> '$.type' END"


def read_sql(column: str, source: str) -> str:
    """JSON of a column; what is wrapped as a string, once or twice, counts as what it wraps."""
    first = f"SELECT *, CASE WHEN json_valid({column}) THEN {column}::JSON END AS j0 FROM ({source})"
    return f"SELECT * EXCLUDE (j0, j1), {_UNWRAPPED.format('j1')} AS j FROM (SELECT *, {_UNWRAPPED.format('j0')} AS j1 FROM ({first}))"


def _spread(value: str, name: str, source: str) -> str:
    """One row per element that isn't null of a list (of a lone value: one), with its place as <name>_pos."""
    held = f"SELECT *, {_LIST.format(value)} AS held FROM ({source})"
    return f"SELECT * FROM (SELECT * EXCLUDE (held), unnest(range(len(held))) AS {name}_pos, unnest(held) AS {name} FROM ({held})) WHERE json_type({name}) <> 'NULL'"


def nested_sql(records: str) -> str:
    """(record_id, child, pos, sub_pos, kind, b) of blocks, parts and names of rows (record_id, message, attachment, ...)."""
    said = f"SELECT *, json_extract(j, '$.content') AS c FROM ({read_sql('message', records)}) WHERE json_type(j) = 'OBJECT'"
    blocks = _spread("c", "b", said)
    results = f"SELECT *, json_extract(b, '$.content') AS pc FROM ({blocks}) WHERE json_type(b) = 'OBJECT' AND b ->> '$.type' = 'tool_result' AND json_type(b, '$.content') IN ('ARRAY', 'OBJECT')"
    parts = _spread("pc", "p", results)
    attached = f"SELECT * FROM ({read_sql('attachment', records)}) WHERE json_type(j) = 'OBJECT'"
    names = _spread("n", "e", f"SELECT *, json_extract(j, '$.addedNames') AS n FROM ({attached})")
    servers = _spread("s", "v", f"SELECT *, json_extract(j, '$.servers') AS s FROM ({attached})")
    inner = _spread("n", "e", f"SELECT *, json_extract(v, '$.addedNames') AS n FROM ({servers}) WHERE json_type(v) = 'OBJECT'")
    return f"""SELECT record_id, 'block' AS child, CAST(b_pos AS INTEGER) AS pos, -1 AS sub_pos, {_TYPE.format('b')} AS kind, b FROM ({blocks}) UNION ALL
      SELECT record_id, 'part', CAST(b_pos AS INTEGER), CAST(p_pos AS INTEGER), {_TYPE.format('p')}, p FROM ({parts}) UNION ALL
      SELECT record_id, 'name', CAST(e_pos AS INTEGER), -1, {_TEXT.format('e')}, e FROM ({names}) UNION ALL
      SELECT record_id, 'name', CAST(v_pos AS INTEGER), CAST(e_pos AS INTEGER), {_TEXT.format('e')}, v FROM ({inner})"""


_FIRST = """SELECT record_id, session_uuid, message, NULL::VARCHAR AS attachment FROM transcript_records
  WHERE uuid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_uuid, uuid ORDER BY record_id) = 1"""
_CALLS = f"SELECT n.*, f.session_uuid FROM ({nested_sql(_FIRST)}) n JOIN ({_FIRST}) f USING (record_id)"
_USES = f"SELECT session_uuid, record_id, pos, b ->> '$.id' AS tool_id, b ->> '$.name' AS name FROM ({_CALLS}) WHERE child IN ('block', 'part') AND kind = 'tool_use'"
_RESULTS = f"""SELECT session_uuid, pos, b ->> '$.tool_use_id' AS tool_id, coalesce(json_type(b, '$.is_error') = 'BOOLEAN' AND b ->> '$.is_error' = 'true', false) AS is_error
  FROM ({_CALLS}) WHERE child IN ('block', 'part') AND kind = 'tool_result'"""
_NAMED = nested_sql("SELECT record_id, NULL::VARCHAR AS message, attachment FROM transcript_records")
ORACLES: dict[str, str] = {
    "p5_found": f"SELECT record_id, child, pos, sub_pos, kind FROM ({nested_sql('SELECT record_id, message, attachment FROM transcript_records')})",
    "p5_names": f"SELECT coalesce(b ->> '$.name', '') AS server_name, count(*) AS n_names, count(DISTINCT kind) AS n_distinct FROM ({_NAMED}) WHERE child = 'name' AND sub_pos >= 0 GROUP BY 1",
    "p5_tool_calls": f"""SELECT u.name, count(*) AS n_uses, count(r.pos) AS n_results, sum(CASE WHEN r.is_error THEN 1 ELSE 0 END)::BIGINT AS n_errors
      FROM ({_USES}) u LEFT JOIN ({_RESULTS}) r USING (session_uuid, tool_id) GROUP BY 1""",
    "p4_found": f"SELECT id FROM ({_NUMBERED}) WHERE copy_no > 1",
    "p4_kept": f"SELECT id, session_id, type, priority, data, batch_id FROM ({_NUMBERED}) WHERE copy_no = 1",
}
