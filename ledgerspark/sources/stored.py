"""Tables that jobs keep between runs: merges that rewrite only the partitions that a delta touches, and an idempotent mirror."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Partitions of a stored table, by a hash of its key.
BUCKETS = 256


def bucket(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(folder) and len(fs.listStatus(folder)) > 0


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def merge_stored(path: str, delta: DataFrame, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> None:
    """Merge a delta into the table at path (made if it is not there). Only the partitions that hold keys of the delta are read and rewritten.

    merge(base, delta) has to give the rows of base's columns and may look at no other keys. Spark moves the new partitions into place when the whole job has ended, so
    a job that fails leaves the table as it was. One writer at a time. keys: of both tables, not null.
    """
    spark = delta.sparkSession
    if not exists(spark, path):
        # what the merge makes of a delta on an empty table
        base = spark.createDataFrame([], delta.schema)
    else:
        touched = [r[0] for r in delta.select(bucket(keys, buckets).alias("b")).distinct().collect()]  # `buckets` numbers at most
        base = spark.read.parquet(path).filter(F.col("bucket").isin(touched)).drop("bucket") if touched else None
    if base is None:
        return
    out = merge(base, delta).withColumn("bucket", bucket(keys, buckets))
    out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write_mirror(tables: dict[str, DataFrame], path: str) -> None:
    """SNK-04: put the rows of some runs into a shared store, a folder a table and a partition a run: a run that is written again takes the place of its rows, other runs stay, and a job that fails leaves none."""
    for name, df in tables.items():
        df.repartition("run_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/{name}")
