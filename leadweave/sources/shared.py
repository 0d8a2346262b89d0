"""The folder that all executors share, and tables written there between the steps of an operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset and all runs on this machine, as in tests, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Tables of steps that this process has written, by application.
_WRITTEN: dict[str, list[str]] = {}


def step_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table of a step; drop_written() deletes it."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_written(spark: SparkSession) -> int:
    """Deletes the tables that steps of this application have written, and says how many there were.

    For the end of a run, when its results are stored elsewhere: DataFrames that still read a step's table fail afterwards.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(p)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(paths)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a Parquet table: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = step_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
