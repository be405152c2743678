"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir where it is set; else, on a local master, a
    temporary folder; else one in the warehouse, if that is not a folder of one
    machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            found = "file://" + tempfile.mkdtemp(prefix="chapterlake-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_kept"
            if found.startswith(("file:", "/")):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    return f"{folder(spark)}/chapterlake/{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """df, never broadcast for a join: tables that grow with the input pack so
    well that Spark, which goes by the bytes of files, takes them for small, and
    the driver would gather them whole."""
    return df.hint("merge")


def keep(df: DataFrame, **options: str) -> DataFrame:
    """df written as Parquet and read again: later jobs neither repeat its work
    nor lose it with an executor. options are those of the writer. What is kept
    is not broadcast (see spread); a small table asks for it by F.broadcast."""
    path = new_folder(df.sparkSession)
    df.write.options(**options).parquet(path)
    return spread(df.sparkSession.read.schema(df.schema).parquet(path))


def stream_of(df: DataFrame) -> DataFrame:
    """df written as Parquet and read as a stream."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)
