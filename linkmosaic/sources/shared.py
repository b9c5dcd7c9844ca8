"""Places that every executor can reach: the checkpoint folder, and tables written there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from linkmosaic.errors import InputError


def shared_dir(spark: SparkSession) -> str:
    """Folder of spark.checkpoint.dir; where it is unset and all runs in one process (tests), one of our own is set.

    On a cluster executors do not share a local folder: there the setting is needed.
    """
    held = spark.conf.get("spark.checkpoint.dir", None)
    if held:
        return held.rstrip("/")
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise InputError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="linkmosaic-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet to the shared folder and reads it back.

    The path is kept on the returned frame so that `discard` can remove the files.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._linkmosaic_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes the files of a materialized table that nothing reads any more."""
    path = getattr(df, "_linkmosaic_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
