"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a temporary folder only where none is set and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="treegauge-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table written once: its lineage ends there, and it outlives lost executors."""
    spark = df.sparkSession
    path = f"{folder(spark)}/treegauge/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._treegauge_path = path
    return out


def met(df: DataFrame) -> DataFrame:
    """df for a join that sorts and shuffles it: for rows that multiply on the way, or that a file holds many times smaller.

    Spark weighs a side by its files, whose size says little of such rows, and would send them through the driver.
    """
    return df.hint("merge")


def forget(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_treegauge_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
