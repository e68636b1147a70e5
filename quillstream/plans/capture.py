"""Queries of labels and events that follow from observed commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators import capture
from quillstream.operators.numbering import numbered
from quillstream.plans.registry import query
from quillstream.sources.tables import read_table


def _invocations(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Commands with their number in the session and further columns (not the streams themselves: they are sorted along)."""
    seen = read_table(spark, sf_dir, "observe_events").select("event_id", "session_uuid", "observed_at", "command", "cwd", *more)
    day = F.coalesce(F.expr("timestampdiff(DAY, timestamp_ntz'1970-01-01 00:00:00', cast(observed_at as timestamp_ntz))"), F.lit(-(2**40)))
    rows = numbered(seen, ["session_uuid"], day, ["observed_at", "event_id"], "seq")
    return rows.withColumns({"root": F.col("cwd"), "workspace": F.regexp_extract(F.coalesce("cwd", F.lit("")), "([^/]*)/*$", 1)})


_SEQ = "row_number() OVER (PARTITION BY session_uuid ORDER BY observed_at, event_id)"


@query(f"""SELECT event_id, mode, CASE WHEN mode = 'replace' THEN 'ctx:v1:file:' || verb || ':' || ws || target END AS latest_source,
  CASE WHEN mode = 'coexist' THEN 'ctx:v1:shell:' || ws || prog || '#' || seq END AS history_source FROM (
  SELECT event_id, {_SEQ} AS seq, split_part(command, ' ', 1) AS prog, CASE WHEN cwd IS NULL THEN '' ELSE regexp_extract(cwd, '([^/]*)/*$', 1) || ':' END AS ws, 'read' AS verb,
  CASE WHEN split_part(command, ' ', 1) IN ('cat', 'head', 'tail', 'less', 'more', 'bat') AND command NOT LIKE '% -%' THEN 'replace' ELSE 'coexist' END AS mode,
  array_to_string(list_filter(string_split(command, ' ')[2:], lambda x: x NOT LIKE '-%'), ':') AS target
  FROM observe_events WHERE length(trim(command)) > 0)""")
def capture_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.plans(_invocations(spark, sf_dir)).select("event_id", "mode", "latest_source", "history_source")


@query()
def capture_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = capture.plans(_invocations(spark, sf_dir, F.col("exit_code"), F.col("interrupted"), capture.trace_tail(F.coalesce("stderr", F.lit(""))).alias("trace")))
    return capture.events(planned).select("event_id", "type", "priority", "command", "exit_code", "trace_snippet", "latest_source", "history_source")


@query("""SELECT session_uuid, count(*) AS n_calls, sum(CASE WHEN exit_code <> 0 THEN 1 ELSE 0 END)::BIGINT AS n_failed,
  sum(octet_length(encode(coalesce(stdout, ''))) + octet_length(encode(coalesce(stderr, ''))))::BIGINT AS n_bytes FROM observe_events GROUP BY 1""")
def capture_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = read_table(spark, sf_dir, "observe_events")
    size = F.octet_length(F.coalesce("stdout", F.lit(""))) + F.octet_length(F.coalesce("stderr", F.lit("")))
    return seen.groupBy("session_uuid").agg(F.count(F.lit(1)).alias("n_calls"), F.sum(F.when(F.col("exit_code") != 0, 1).otherwise(0)).alias("n_failed"), F.sum(size).alias("n_bytes"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(label, '@[a-z2-7]{6}$', ''), '#\d+$', '') AS base, split_part(label, ':', 3) AS domain, len(string_split(label, ':')) AS n_segments,
  TRY_CAST(nullif(regexp_extract(regexp_replace(label, '@[a-z2-7]{6}$', ''), '#(\d+)$', 1), '') AS BIGINT) AS seq, nullif(regexp_extract(label, '@([a-z2-7]{6})$', 1), '') AS token FROM documents WHERE label IS NOT NULL""")
def labels_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").where("label is not null").withColumn("parts", F.split("label", ":"))
    told = docs.withColumn("told", capture.parsed_labels(F.col("label")))
    return told.select("doc_id", "told.base", F.coalesce(F.get("parts", F.lit(2)), F.lit("")).alias("domain"), F.size("parts").cast("long").alias("n_segments"), "told.seq", "told.token")


@query("""SELECT session_uuid, item AS source, last_id, CAST(position AS INTEGER) AS position FROM (SELECT *, sum(octet_length(encode(coalesce(item, ''))) + 8) OVER (PARTITION BY session_uuid ORDER BY position) AS used FROM (
  SELECT session_uuid, item, last_id, row_number() OVER (PARTITION BY session_uuid ORDER BY last_id DESC, item) AS position FROM (
  SELECT session_uuid, command AS item, max(event_id) AS last_id FROM observe_events GROUP BY 1, 2) QUALIFY position <= 20)) WHERE used <= 965""")
def capture_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commands of each session that were seen last, as many as an inventory shows."""
    return capture.inventory(read_table(spark, sf_dir, "observe_events"), "session_uuid", "command", "event_id").withColumnRenamed("last", "last_id")


@query(r"""SELECT program, count(*) AS n_runs, count(DISTINCT event_id) AS n_commands FROM (SELECT event_id, regexp_replace(list_filter(string_split(trim(part), ' '), lambda x: x <> '' AND NOT regexp_matches(x, '^[A-Za-z_][A-Za-z0-9_]*=') AND x <> 'env')[1], '^.*/', '') AS program
  FROM (SELECT event_id, unnest(string_split_regex(command, '\|\||&&|[|;\n]')) AS part FROM observe_events)) WHERE program IS NOT NULL GROUP BY 1""")
def capture_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs by the segments of command lines that run them."""
    runs = read_table(spark, sf_dir, "observe_events").select("event_id", F.explode(capture.programs(F.col("command"))).alias("program"))
    return runs.groupBy("program").agg(F.count(F.lit(1)).alias("n_runs"), F.count_distinct("event_id").alias("n_commands"))


@query("""SELECT path, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY first_id, path) = 1 THEN base ELSE base || '-' || substr(sha256(path), 1, 8) END AS workspace FROM (
  SELECT cwd AS path, min(event_id) AS first_id, regexp_extract(cwd, '([^/]*)/*$', 1) AS base FROM observe_events WHERE coalesce(cwd, '') <> '' GROUP BY 1)""")
def capture_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.workspace_ids(read_table(spark, sf_dir, "observe_events"), "cwd", "event_id")


_PAYLOAD = r"""CASE WHEN length(regexp_replace(coalesce(stderr, ''), '\s+', '', 'g')) > 0 AND coalesce(stdout, '') <> ''
  THEN '[stdout]' || chr(10) || stdout || CASE WHEN suffix(stdout, chr(10)) THEN chr(10) ELSE chr(10) || chr(10) END || '[stderr]' || chr(10) || stderr
  WHEN length(regexp_replace(coalesce(stderr, ''), '\s+', '', 'g')) > 0 THEN '[stderr]' || chr(10) || stderr ELSE coalesce(stdout, '') END"""


@query(f"""SELECT event_id, octet_length(encode(p)) AS n_bytes, md5(p) AS digest, CASE WHEN octet_length(encode(p)) <= 4096 THEN 'inline'
  WHEN failed AND octet_length(encode(p)) <= 16384 THEN 'failure' WHEN failed THEN 'failure_cut' ELSE 'compact' END AS shown,
  CASE WHEN octet_length(encode(p)) <= 4096 OR failed AND octet_length(encode(p)) <= 16384 THEN octet_length(encode(p)) WHEN failed AND length(p) = octet_length(encode(p))
    THEN 16384 + length('[' || (length(p) - 16384) || ' bytes left out]') + 1 + CASE WHEN p[4096] = chr(10) THEN 0 ELSE 1 END END AS n_shown
  FROM (SELECT event_id, coalesce(exit_code <> 0, false) AS failed, {_PAYLOAD} AS p FROM observe_events)""")
def capture_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = read_table(spark, sf_dir, "observe_events").withColumn("p", capture.payload(F.col("stdout"), F.col("stderr")))
    failed = F.coalesce(F.col("exit_code") != 0, F.lit(False))
    return seen.select(
        "event_id", F.octet_length("p").cast("long").alias("n_bytes"), F.md5("p").alias("digest"), capture.presentation(F.col("p"), failed).alias("shown"),
        F.octet_length(F.when((capture.presentation(F.col("p"), failed) != "failure_cut") | (F.length("p") == F.octet_length("p")), capture.shown(F.col("p"), failed))).cast("long").alias("n_shown"),
    )


@query(r"""SELECT doc_id, CASE WHEN len(ls) >= 3 THEN md5(array_to_string(ls[3:8], '')) END AS digest FROM (SELECT doc_id, regexp_extract_all(text, '([^\n]*\n|[^\n]+)') AS ls FROM documents WHERE text IS NOT NULL)""")
def documents_line_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.md5(capture.line_range(F.col("text"), 3, 8)).alias("digest"))
