"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master, where all is one machine, may do without: a temporary
    folder is set then."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[[^-]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = getattr(context, "_lexis_dir", None)
        if path is None:
            path = "file://" + tempfile.mkdtemp(prefix="lexis-")
            context.setCheckpointDir(path)
            context._lexis_dir = path
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def clean() -> None:
        try:
            fs.delete(hadoop, True)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass

    atexit.register(clean)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.

    Later jobs read files that survive the loss of any executor, and read only the columns they use.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._lexis_path = path
    return stored


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised DataFrame that nothing reads any more; others are left alone."""
    if path := getattr(df, "_lexis_path", None):
        hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
