"""Intermediate tables in the folder that driver and executors share: ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a temporary folder serves in plain local mode; on a cluster that is an error."""
    context = spark.sparkContext
    given = context.getConf().get("spark.checkpoint.dir")
    if given:
        return given
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="millrace-")
    context.setCheckpointDir(own)
    return own


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, into the reliable checkpoint folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written once as a table in the shared folder, and its path; ``removed`` when done with."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def wide(df: DataFrame) -> DataFrame:
    """``df`` as a side of joins by shuffle only. Spark judges by the size of files what it may broadcast, and stored rows of similar texts take many times that in the driver."""
    return df.hint("merge")


def removed(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
