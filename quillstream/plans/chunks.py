"""Queries of chunking and of reading chunks in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators import chunking as C
from quillstream.operators import inorder
from quillstream.plans.registry import query
from quillstream.sources.tables import read_table, spread, written

_ANCHOR = C.ANCHOR.replace("'", "''")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents")).withColumnRenamed("format_hint", "format")


@query(r"""SELECT doc_id, CAST(p AS INTEGER) AS p, octet_length(encode(body)) AS n_bytes, substr(trim(split_part(body, chr(10), 1), ' ' || chr(9) || chr(160) || chr(13)), 1, 60) AS title FROM (
  SELECT doc_id, unnest(range(len(ps))) AS p, unnest(list_transform(ps, lambda x: regexp_replace(x, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g'))) AS body FROM (
    SELECT doc_id, regexp_split_to_array(text, '\n[ \t]*\n') AS ps FROM documents WHERE text IS NOT NULL)) WHERE length(body) > 0""")
def chunks_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = C.paragraphs(_docs(spark, sf_dir))
    return parts.select("doc_id", "p", F.octet_length("body").cast("long").alias("n_bytes"), F.substring(C.trim_blank(C.first_line(F.col("body"))), 1, C.TITLE).alias("title"))


@query(rf"""SELECT doc_id, CAST(run AS BIGINT) AS run, count(*) AS n_lines, sum(octet_length(encode(line)) + 1)::BIGINT - 1 AS n_bytes FROM (
  SELECT doc_id, line_no, line, sum(CASE WHEN regexp_matches(substr(line, 1, 80), '^.{{0,48}}?({_ANCHOR})') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))) GROUP BY 1, 2""")
def chunks_log_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = C.log_lines(_docs(spark, sf_dir))
    return runs.groupBy("doc_id", "run").agg(F.count(F.lit(1)).alias("n_lines"), (F.sum(F.octet_length("line") + 1) - 1).alias("n_bytes"))


@query()
def chunks_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunks(_docs(spark, sf_dir))


@query()
def chunks_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.summaries(_docs(spark, sf_dir))


@query()
def chunks_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a summary lists of each document: its first sections with previews."""
    return C.sections(_docs(spark, sf_dir))


@query()
def chunks_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.detected(_docs(spark, sf_dir).where("text is not null").withColumn("format", F.lit(None).cast("string")))
    return found.join(_docs(spark, sf_dir).select("doc_id", F.col("format").alias("hint")), "doc_id").groupBy("hint", "effective").agg(F.count(F.lit(1)).alias("n_docs"))


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = written(C.chunks(_docs(spark, sf_dir)), "chunks")
    return cut.join(_docs(spark, sf_dir).select("doc_id", "label"), "doc_id")


@query()
def inorder_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inorder.all_pages(_cut(spark, sf_dir), 4096).where("snippet is not null").drop("n_chunks")


@query()
def inorder_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inorder.all_cursors(inorder.all_pages(_cut(spark, sf_dir), 4096))
