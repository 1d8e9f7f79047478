"""Tables of one run in the cluster's shared folder, and their removal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from veilframe.session import ensure_checkpoint_dir


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete one folder that this run wrote."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def remove_checkpoint(checkpointed: DataFrame) -> None:
    """Delete the files of a DataFrame that ``checkpoint()`` returned and nothing reads any more."""
    file = checkpointed._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        remove(checkpointed.sparkSession, file.get())
