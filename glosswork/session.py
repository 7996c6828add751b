"""Session helpers shared by queries, tests and the bench."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, name: str = "glosswork") -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("GLOSSWORK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Rows of an Arrow batch. A batch of long texts is held by the JVM and by Python at once.
BATCH_ROWS = 1_000


def small_batches(df: DataFrame) -> DataFrame:
    """df, after lowering its session's spark.sql.execution.arrow.maxRecordsPerBatch to BATCH_ROWS where it is larger.

    Spark reads that setting when a plan runs, which is after the operator returned its lazy result, so it stays
    lowered for the session: the operators need it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key, "10000")) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables.

    Texts that come in fewer splits than there are cores (one small file) are dealt over the cores; large inputs are not moved.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("documents", "pages") and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    return df
