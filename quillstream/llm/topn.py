"""First N rows of every group, by histogram thresholds and an exact rank.

For each group a histogram of a coarse, order-preserving code of the sort keys
is built with map-side partial counts.  Walking it from the front gives the
first bucket at which at least N rows have been seen; rows behind that bucket
can't be among the first N and are filtered out.  The rest is ranked exactly on
all keys.  Every group of N rows or more has a threshold.  The thresholds are a
table: as long as it is small it is broadcast, so that rows are dropped where
they are read and only survivors are shuffled; beyond that both sides are
shuffled by group, which is the partitioning that the rank needs anyway.
The final rank keeps at most N rows of a group per map task before the shuffle
(WindowGroupLimit), so that ties inside one bucket don't gather in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.operators.textindex import small
from quillstream.sources.tables import written


@dataclass(frozen=True)
class SortKey:
    """A sort column; bucket: a coarse long in the same order (larger comes later), null for null."""

    name: str
    ascending: bool = True
    bucket: Column | None = None

    def order(self) -> Column:
        c = F.col(self.name)
        return c.asc_nulls_last() if self.ascending else c.desc_nulls_last()


def first_n_per_group(df: DataFrame, group: list[str], keys: list[SortKey], n: int, rank_col: str = "rank_no") -> DataFrame:
    """The first n rows of each group by keys (nulls last in each), ranked from 1.

    Null group values form a group of their own.  Repeated rows all count.
    Rows equal in every key get their ranks in no fixed order: give a unique
    last key.  n < 1 and empty tables give no rows.  A group with fewer than n
    rows comes out whole.  All columns of df are kept; its names mustn't begin
    with `__top_`.
    """
    if n < 1:
        return df.withColumn(rank_col, F.lit(0)).where(F.lit(False))
    codes = []
    for key in keys:
        if key.bucket is None:
            break
        codes.append(F.coalesce(key.bucket.cast("long"), F.lit(2**62)))
    work = df
    if codes:
        coded = df.withColumn("__top_code", F.struct(*[c.alias(f"c{i}") for i, c in enumerate(codes)]))
        hist = coded.groupBy(*group, "__top_code").agg(F.count(F.lit(1)).alias("__top_n"))
        walk = Window.partitionBy(*group).orderBy("__top_code").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        seen = hist.withColumn("__top_seen", F.sum("__top_n").over(walk)).where(F.col("__top_seen") >= n)
        limits = seen.groupBy(*[F.col(g).alias(f"__top_g{i}") for i, g in enumerate(group)]).agg(F.min("__top_code").alias("__top_limit"))
        limits = small(written(limits, "top-limits"))
        same = [F.col(g).eqNullSafe(F.col(f"__top_g{i}")) for i, g in enumerate(group)]
        kept = coded.join(limits, on=same, how="left").where(F.col("__top_limit").isNull() | (F.col("__top_code") <= F.col("__top_limit")))
        work = kept.drop("__top_code", "__top_limit", *[f"__top_g{i}" for i in range(len(group))])
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*[k.order() for k in keys]))
    return work.withColumn(rank_col, rank).where(F.col(rank_col) <= n)


def foremost_events(events: DataFrame, n: int = 5, bucket_seconds: int = 21_600) -> DataFrame:
    """The n foremost events of each session: priority, newest created_at, smallest id."""
    age = F.expr("timestampdiff(SECOND, cast(created_at as timestamp_ntz), timestamp_ntz'2100-01-01 00:00:00')")
    return first_n_per_group(
        events,
        ["session_id"],
        [SortKey("priority", True, F.col("priority")), SortKey("created_at", False, F.floor(age / bucket_seconds)), SortKey("id")],
        n,
    )
