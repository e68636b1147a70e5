"""Table access and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def run_dir(spark: SparkSession) -> str:
    """The folder of this application below spark.checkpoint.dir, which all executors share.

    Only where the setting is missing and the session is a local one (tests) a
    temporary folder of this machine takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if spark.sparkContext.applicationId not in _local:
            _local[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="quillstream-")
        root = _local[spark.sparkContext.applicationId]
    return f"{root.rstrip('/')}/quillstream-{spark.sparkContext.applicationId}"


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder for `what` in the folder of this application."""
    return f"{run_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"


def clean_up(spark: SparkSession) -> None:
    """Remove what this application wrote to cut lineages; DataFrames that read it can't be used afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, what: str, *by: str) -> DataFrame:
    """Cut the lineage: write df into the shared folder, partitioned by columns if any, and read it back."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its scan would use less than half of them (one small file); else as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def utc_micros(name: str) -> Column:
    """Microseconds since 1970 of a zone-less or zoned time column."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({name} as timestamp_ntz))")
