"""Queries of the operators in this subpackage, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.conversations import conversation_texts, sound_conversations
from quillstream.llm.leakage import leaked_items, leaked_pairs
from quillstream.llm.mixing import mixture, mixture_shares, token_counts, with_texts
from quillstream.llm.sentences import sentence_units
from quillstream.llm.topn import foremost_events
from quillstream.sources.tables import read_table, table_path, written


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sound_conversations(spark, table_path(sf_dir, "transcript_records"))[0].select("session_uuid", "turn_no", "uuid")


def p1_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, _ = sound_conversations(spark, table_path(sf_dir, "transcript_records"))
    return conversation_texts(turns, read_table(spark, sf_dir, "transcript_records"))


def p1_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the stream by what became of them: how often they closed, with late rows, too large for one task's state, sound."""
    turns, sessions = sound_conversations(spark, table_path(sf_dir, "transcript_records"))
    sound = turns.select("session_uuid").distinct().withColumn("sound", F.lit(True))
    joined = sessions.join(sound, "session_uuid", "left").withColumn("sound", F.coalesce("sound", F.lit(False)))
    return joined.groupBy("n_closed", (F.col("n_late") > 0).alias("late"), "large", "sound").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n_late").alias("n_late_rows"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "session_events").select("session_id", "priority", "created_at", "id")
    return foremost_events(events).select("session_id", "rank_no", "id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_pairs(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "eval_items")
    return leaked_items(leaked_pairs(read_table(spark, sf_dir, "documents"), items), items)


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


def p7_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture with its text."""
    docs = read_table(spark, sf_dir, "documents")
    return with_texts(mixture(spark, docs, read_table(spark, sf_dir, "mix_targets")), docs)


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mixture, sizes of the documents and targets."""
    docs, targets = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets")
    sizes = written(token_counts(docs), "token-counts")
    return written(mixture(spark, docs, targets, sizes=sizes), "mixture"), sizes, targets


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, sizes, targets = _mixed(spark, sf_dir)
    return mixture_shares(mixed, sizes, targets)


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every target source: its share but for what its cap forbids, its repeats, its blocks each in one slot.

    SQL can't count tokens, so its twin states what has to come out.
    """
    mixed, sizes, targets = _mixed(spark, sf_dir)
    report = mixture_shares(mixed, sizes, targets)
    slots = mixed.groupBy("source", "slot").agg(F.sum("n_tokens").alias("n")).groupBy("source").agg(F.sum((F.col("n") == 2_048).cast("int")).alias("n_full"), F.max("n").alias("most"))
    joined = report.join(slots, "source", "left").fillna(0, ["n_full", "most"])
    due = F.least("wanted_tokens", F.col("source_tokens") * F.col("max_repeats"))
    return joined.select(
        "source", (F.col("n_tokens") == due).alias("takes_its_due"), (F.col("most_repeats") <= F.col("max_repeats")).alias("repeats_allowed"),
        ((F.col("most") <= 2_048) & (F.col("n_full") >= F.col("n_slots") - 1) & (F.col("n_slots") == F.ceil(F.col("n_tokens") / 2_048))).alias("blocks_placed"),
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_units(read_table(spark, sf_dir, "documents"))


def p8_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence units and their mean length per source and language label."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", F.lower(F.trim("lang")).alias("lang"))
    units = p8_found(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("char_end") - F.col("char_start")).alias("chars"))
    by = docs.join(units, "doc_id").groupBy("source", "lang").agg(F.sum("n").alias("n_units"), F.sum("chars").alias("n_chars"))
    return by.withColumn("mean_chars", F.round(F.col("n_chars") / F.col("n_units"), 3))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_texts, p1_sessions, p3_found, p6_found, p6_items, p7_mixture, p7_texts, p7_shares, p7_checks, p8_found, p8_lengths)}

ORACLES: dict[str, str] = {
    "p3_found": """
        SELECT session_id, CAST(rank_no AS INTEGER) AS rank_no, id FROM (
          SELECT session_id, id, row_number() OVER (PARTITION BY session_id
            ORDER BY priority ASC NULLS LAST, created_at DESC NULLS LAST, id ASC NULLS LAST) AS rank_no
          FROM session_events) WHERE rank_no <= 5""",
    "p7_checks": "SELECT DISTINCT source, true AS takes_its_due, true AS repeats_allowed, true AS blocks_placed FROM mix_targets",
}
