"""Streams of session events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators.delivery import event_hash
from quillstream.sources.tables import shared_dir


FAR = dt.datetime(2999, 1, 1)


def table_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet table (a folder or one file) as a stream of its files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def hashed(events: DataFrame) -> DataFrame:
    """Events with the hash of type and data where none is stored."""
    return events.withColumn("data_hash", F.coalesce("data_hash", event_hash()))


def first_deliveries(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """A stream without repeats of (session_id, type, data_hash) that arrive within `delay` of each other.

    State is kept for `delay` only; a missing hash is that of type and data.  A
    repeat that comes later than `delay` passes: a pass over what was written
    takes it out where that matters.
    """
    timed = hashed(events).withColumn("arrived", F.col("received_at").cast("timestamp")).withWatermark("arrived", delay)
    return timed.dropDuplicatesWithinWatermark(["session_id", "type", "data_hash"]).drop("arrived")


def activity(events: DataFrame, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """Spans of activity per session, each sent once it is closed."""
    timed = events.where("created_at is not null").withColumn("at", F.col("created_at").cast("timestamp")).withWatermark("at", delay)
    spans = timed.groupBy("session_id", F.session_window("at", gap).alias("span")).agg(F.count(F.lit(1)).alias("n_events"))
    return spans.select("session_id", "n_events", F.col("span.start").alias("start"), F.col("span.end").alias("end"))


def daily_counts(events: DataFrame) -> DataFrame:
    """Events by type and day of arrival, kept up to date."""
    day = F.window(F.col("received_at").cast("timestamp"), "1 day")
    return events.groupBy("type", day.alias("day")).agg(F.count(F.lit(1)).alias("n_events"), F.max("priority").alias("lowest")).select("type", F.date_format("day.start", "yyyy-MM-dd").alias("day"), "n_events", "lowest")


def drained(stream: DataFrame, what: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there; its rows (complete: those of the last batch)."""
    return _drain(stream, shared_dir(stream.sparkSession, what), mode)


def _drain(stream: DataFrame, work: str, mode: str = "append") -> DataFrame:
    """As `drained`, in the folder `work`; a further run there goes on where the last one ended.

    Each batch overwrites its own folder, so that a batch which is run again
    after a failure leaves its rows once.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work}/out/batch={number}")

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None:
        return spark.createDataFrame([], stream.schema)
    path = f"{work}/out/batch={query.lastProgress['batchId']}" if mode == "complete" else f"{work}/out/*"
    return spark.read.schema(stream.schema).parquet(path)


def drained_activity(events: DataFrame) -> DataFrame:
    """All spans of activity of a bounded stream: once it has been taken, a row far in the future closes the open ones."""
    spark = events.sparkSession
    work = shared_dir(spark, "activity")
    events = events.select("session_id", "created_at")
    nothing = spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema])
    nothing.write.parquet(f"{work}/closing")
    spans = activity(events.unionByName(spark.readStream.schema(nothing.schema).parquet(f"{work}/closing")))
    _drain(spans, work)
    end = spark.range(1).select(*[(F.lit(FAR) if f.name == "created_at" else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema])
    end.coalesce(1).write.mode("append").parquet(f"{work}/closing")
    return _drain(spans, work).where(F.col("start") < F.lit(FAR - dt.timedelta(days=1)))


def spooled(spark: SparkSession, folder: str, epoch: int) -> DataFrame:
    """Spooled JSON lines {epoch, session_id, type, priority, data} of the current epoch; those of others are left out."""
    lines = spark.readStream.schema("epoch long, session_id long, type string, priority int, data string").json(folder)
    return lines.where((F.col("epoch") == epoch) & F.col("priority").between(1, 4)).drop("epoch")
