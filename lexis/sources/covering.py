"""Covering copies: tables written once more in hash buckets of a key, of which a batch of keys reads only its own.

The bucket is a partition column. The buckets of a batch, of which there are no more than the copy has, are broadcast,
and Spark's dynamic partition pruning leaves out the files of all others at run time.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

#: Rows for which a copy gets another bucket; it has no fewer than LEAST and no more than MOST buckets.
ROWS, LEAST, MOST = 100_000, 8, 4096
#: A table of fewer rows is read whole sooner than the buckets of a batch are found.
WORTH = 50_000


def buckets_for(rows: int) -> int:
    """A power of two."""
    n = LEAST
    while n < MOST and n * ROWS < rows:
        n *= 2
    return n


def bucket_of(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


@dataclass
class Copy:
    """A table in buckets of `key`, with its partition column `bucket`."""

    frame: DataFrame
    key: str
    buckets: int

    def near(self, wanted: DataFrame, column: str, settled: bool = False) -> DataFrame:
        """The rows in the buckets of the keys that the batch has in `column`: all rows with such a key, and others.

        Keys that come with the request are met at run time. Keys that a search has found are `settled`: their buckets, at
        most as many numbers as the copy has, are asked for at once and become a filter on partitions. Otherwise each step of
        a search would stand twice in the plan of the next one, and a search of six steps 64 times.
        """
        if settled:
            buckets = [r[0] for r in wanted.where(F.col(column).isNotNull()).select(bucket_of(column, self.buckets)).distinct().collect()]
            return self.frame.where(F.col("bucket").isin(buckets)).drop("bucket")
        of_batch = wanted.select(bucket_of(column, self.buckets).alias("bucket")).where("bucket >= 0").distinct()
        return self.frame.join(F.broadcast(of_batch), "bucket", "left_semi").drop("bucket")  # at most `buckets` small rows


def asked_for(wanted: DataFrame, column: str) -> Callable[[Column], Column] | None:
    """Of a table without copy: which keys are in a bucket with one that the batch has in `column`; None, if most are.

    Only numbers of buckets, MOST / 2 at most, come to the driver, however many keys are asked for.
    """
    buckets = [r[0] for r in wanted.where(F.col(column).isNotNull()).select(bucket_of(column, MOST)).distinct().limit(MOST // 2 + 1).collect()]
    return (lambda key: bucket_of(key, MOST).isin(buckets)) if 2 * len(buckets) <= MOST else None


def write_copy(df: DataFrame, key: str, path: str, rows: int) -> int:
    """Write df in buckets of `key`; a bucket with a hot key is split over files, small ones share a task."""
    buckets = buckets_for(rows)
    dealt = df.withColumn("bucket", bucket_of(key, buckets)).hint("rebalance", "bucket")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)
    return buckets


def read_copy(spark: SparkSession, path: str, schema: StructType, key: str, buckets: int) -> Copy:
    return Copy(spark.read.schema(StructType(schema.fields).add("bucket", IntegerType())).parquet(path), key, buckets)


def hadoop(spark: SparkSession, path: str):
    """The file system and path objects of a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_manifest(spark: SparkSession, path: str, content: dict) -> None:
    """Replace a small JSON file in one step: readers see the old one or the new one."""
    jvm = spark.sparkContext._jvm
    fs, target = hadoop(spark, path)
    _, fresh = hadoop(spark, f"{path}.new")
    out = fs.create(fresh, True)
    out.write(json.dumps(content).encode())
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(fresh), fs.makeQualified(target), options)


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    fs, at = hadoop(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()
