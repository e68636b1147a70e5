"""Exactly one copy of messages that were delivered at least once.

Three steps, of which only the first shuffles, and only narrow rows:

1. `losing_positions`: identifier, delivery order and place in the file (file
   and row index of the scan) are read once and written as numbers; a partial
   aggregate finds the winner of every identifier that has several copies.  Only
   rows whose identifier may be one of those meet the winners: a bitmap of their
   hashes, of fixed size, sorts out the others before the second shuffle.
2. `deletion_vectors`: positions of the losers as one bitmap per 32,768 rows of
   a file, built by Spark's bitmap aggregate.
3. `apply_deletion_vectors`: the wide rows are scanned and matched with the
   bitmaps by file and bucket.  A bitmap table has rows / 8 bytes at most; files
   are taken in groups by their hash, as many as keep the bitmaps of a group
   near `broadcast_bytes`, so that the wide rows are never shuffled, whatever
   the size of the table, and no file or row is named in the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.sources.tables import written

BITMAP_ROWS = 32_768
BITMAP_BYTES = 4_096
#: Bits of the bitmap of repeated identifiers.
SIEVE_BITS = 1 << 27


def event_hash(type_col: str = "type", data_col: str = "data") -> Column:
    """SHA-256 over both values in UTF-8, each after its length as 8 bytes, big end first; null counts as empty."""

    def framed(name: str) -> Column:
        raw = F.encode(F.coalesce(F.col(name), F.lit("")), "UTF-8")
        return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw).cast("long")), 16, "0")), raw)

    return F.unhex(F.sha2(F.concat(framed(type_col), framed(data_col)), 256))


def _placed(df: DataFrame) -> DataFrame:
    """df with the file of each row, as a hash of its path, and its place there."""
    return df.withColumns({"__file": F.xxhash64("_metadata.file_path"), "__row": F.col("_metadata.row_index")})


def _bit(bits: Column, position: Column) -> Column:
    """Whether a bit of a bitmap is set."""
    byte = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce((F.call_function("shiftright", byte, (position % 8).cast("int")).bitwiseAND(1)) == 1, F.lit(False))


def losing_positions(scan: DataFrame, identifier: dict[str, Column], order: str) -> DataFrame:
    """File and row index of all copies but the first by `order` (then by place) of each identifier.

    scan: a DataFrame straight from a parquet scan.  identifier: the columns
    that make the identifier, which is compared by a hash of 128 bits; null is a
    value like any other.  Rows with a null `order` come after all others.
    Copies with equal order: the first by file (in the order of the hashes of
    their paths) and row index stays.  Empty tables give no rows.
    """
    parts = [x for c in identifier.values() for x in (c.isNull(), c)]
    place = F.struct(F.col(order).isNull().alias("late"), F.col(order).alias("at"), F.col("__file").alias("file"), F.col("__row").alias("row"))
    narrow = written(_placed(scan).select(F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(7), *parts).alias("k2"), place.alias("place")), "deliveries")
    several = narrow.groupBy("k1", "k2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    several = written(several.select("k1", "k2", "first"), "repeated")
    bit = F.pmod(F.col("k1"), F.lit(SIEVE_BITS)) + 1
    sieve = several.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    maybe = narrow.withColumns({"bucket": F.bitmap_bucket_number(bit), "position": F.bitmap_bit_position(bit)}).join(F.broadcast(sieve), "bucket").where(_bit(F.col("bits"), F.col("position")))
    return maybe.select("k1", "k2", "place").join(several, ["k1", "k2"]).where("place > first").select(F.col("place.file").alias("file"), F.col("place.row").alias("row"))


def deletion_vectors(positions: DataFrame) -> DataFrame:
    """(file, bucket, bits): one bitmap per file and 32,768 rows that have a deleted row."""
    at = F.col("row") + 1
    return (
        positions.groupBy("file", F.bitmap_bucket_number(at).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    )


def apply_deletion_vectors(spark: SparkSession, path: str, vectors: DataFrame, columns: list[str] | None = None, deleted: bool = False, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Rows of the parquet table at `path` that the vectors leave (or, with deleted=True, drop)."""
    scan = spark.read.parquet(path)
    columns = columns or scan.columns
    groups = max(1, -(-vectors.count() // max(1, broadcast_bytes // BITMAP_BYTES)))
    position = F.bitmap_bit_position(F.col("__row") + 1)

    def part(own: DataFrame, held: DataFrame) -> DataFrame:
        held = held.select(F.col("file").alias("__vf"), F.col("bucket").alias("__vb"), F.col("bits").alias("__bits"))
        same = (F.col("__file") == F.col("__vf")) & (F.bitmap_bucket_number(F.col("__row") + 1) == F.col("__vb"))
        hit = own.join(F.broadcast(held), same, "inner" if deleted else "left")
        gone = _bit(F.col("__bits"), position)
        return hit.where(gone if deleted else ~gone).select(*columns)

    if groups == 1:
        return part(_placed(scan), vectors)
    # A condition on the path alone: files of other groups aren't read.
    group = lambda file: F.pmod(file, F.lit(groups))
    return reduce(DataFrame.unionByName, [part(_placed(scan).where(group(F.xxhash64("_metadata.file_path")) == g), vectors.where(group(F.col("file")) == g)) for g in range(groups)])


def deduplicated_events(spark: SparkSession, path: str, columns: list[str] | None = None, deleted: bool = False) -> DataFrame:
    """session_events with one row of each (session_id, type, data_hash), that with the smallest id.

    A missing data_hash is computed from type and data.  deleted=True gives the
    dropped rows instead.
    """
    scan = spark.read.parquet(path)
    key = {"session_id": F.col("session_id"), "type": F.col("type"), "hash": F.coalesce(F.col("data_hash"), event_hash())}
    vectors = written(deletion_vectors(losing_positions(scan, key, "id")), "deletion-vectors")
    return apply_deletion_vectors(spark, path, vectors, columns, deleted)
