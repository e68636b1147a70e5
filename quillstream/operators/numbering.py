"""Numbers and stretches of rows in large groups, in steps that no task has to do for a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, group: list[str], bucket: Column, order: list[str | Column], value: str, name: str) -> DataFrame:
    """Adds the sum of `value` over the rows of a group up to each row, by `order`; bucket: a coarse value in the same order, not null.

    Sums run within buckets, and the sums of the buckets before are added, so a
    task sorts a bucket of a group, never a group.  Null group values form a
    group; a null value counts as 0.
    """
    work = df.withColumn("__bucket", bucket)
    sums = work.groupBy(*group, "__bucket").agg(F.coalesce(F.sum(value), F.lit(0)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).select(*[F.col(g).alias(f"__g{k}") for k, g in enumerate(group)], F.col("__bucket").alias("__b"), "__base")
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__g{k}")) for k, g in enumerate(group)], F.col("__bucket") == F.col("__b"))
    inside = Window.partitionBy(*group, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = work.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(bases, same)
    return summed.withColumn(name, F.col("__base") + F.col("__inside")).drop("__bucket", "__b", "__base", "__inside", *[f"__g{k}" for k in range(len(group))])


def numbered(df: DataFrame, group: list[str], bucket: Column, order: list[str | Column], name: str) -> DataFrame:
    """Adds the number (from 1) of each row in its group by `order`, as `running` takes it."""
    return running(df.withColumn("__one", F.lit(1)), group, bucket, order, "__one", name).drop("__one")


def beyond_first(df: DataFrame, group: list[str], code: Column, order: list[Column], keep: int) -> DataFrame:
    """Rows of each group that aren't among its first `keep` by `order`; code: coarse, in the same order, not null.

    A histogram of codes per group gives the code at which the first `keep`
    rows end.  Rows behind it are beyond without a look; only rows at it are
    ranked, of which each task passes on `keep` at most (a group limit).  The
    rows need a unique last key in `order`.
    """
    work = df.withColumn("__code", code)
    hist = work.groupBy(*group, "__code").agg(F.count(F.lit(1)).alias("__n"))
    so_far = Window.partitionBy(*group).orderBy("__code").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = hist.withColumn("__seen", F.sum("__n").over(so_far)).where(F.col("__seen") >= keep)
    limits = seen.groupBy(*[F.col(g).alias(f"__g{k}") for k, g in enumerate(group)]).agg(F.min(F.struct("__code", (F.col("__seen") - F.col("__n")).alias("before"))).alias("__limit"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__g{k}")) for k, g in enumerate(group)])
    late = work.join(limits, same).where(F.col("__code") >= F.col("__limit.__code"))
    behind = late.where(F.col("__code") > F.col("__limit.__code")).select(*df.columns)
    border = late.where(F.col("__code") == F.col("__limit.__code"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    first = border.withColumn("__rank", rank).where(F.col("__rank") <= keep).where(F.col("__rank") + F.col("__limit.before") <= keep)
    keys = [c for c in df.columns]
    rest = border.select(*keys).exceptAll(first.select(*keys))
    return behind.unionByName(rest)
