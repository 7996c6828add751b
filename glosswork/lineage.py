"""Lineage cuts: tables written in the cluster's shared folder and read back."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary one on a local master; an error on a cluster,
    whose executors could not read each other's files in it."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = tempfile.mkdtemp(prefix="glosswork-")
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def new_path(spark: SparkSession, name: str = "cut") -> str:
    """A path of its own below the shared folder; what is there goes when the driver ends."""
    path = f"{shared_dir(spark)}/glosswork/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df below the shared folder and read it back: lost executors cost no recomputation."""
    spark = df.sparkSession
    path = path or new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path that nothing reads any more; without effect once the session is gone."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the folder is then the cluster's to clear
        pass
