"""Intermediate tables in the folder that executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. One is made up only in local mode, where it was left unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found and spark.sparkContext.master.startswith("local"):
        found = tempfile.mkdtemp(prefix="spark-fundloom-")
        spark.sparkContext.setCheckpointDir(found)
    if not found:
        raise RuntimeError("spark.checkpoint.dir must name a folder that the executors share")
    return found


def staged(df: DataFrame) -> DataFrame:
    """df, written and read again: its lineage ends there, and every reader sees the same rows in the same places."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/fundloom-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Deletes staged tables that no plan still to be run reads."""
    for df in tables:
        at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
