"""Tables written to the folder that the cluster shares (spark.checkpoint.dir) and read again."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="stages-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and all tasks run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


def place(spark: SparkSession, name: str) -> str:
    """A path of its own in the run's shared folder."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again, which cuts lineage and survives lost executors.

    A run's tables lie in one folder, named after the application, that may be deleted when it has ended.
    """
    spark = df.sparkSession
    path = place(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
