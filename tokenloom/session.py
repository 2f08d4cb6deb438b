"""Session factory and scratch tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: list[tuple[SparkSession, str]] = []


def build_session(app: str = "tokenloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect (UTC, AQE, Arrow); `conf` wins."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder shared by all executors for cut lineage.

    The cluster's `spark.checkpoint.dir` is used when set; only where it is unset (tests, one
    machine) a temporary folder is taken and written back into the session's setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tokenloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet in the scratch folder and return the table read back.

    This cuts the lineage at a copy that outlives executors, costs one evaluation (a
    `checkpoint()` evaluates its plan twice) and stays columnar.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tokenloom-{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    _SCRATCH.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def purge_scratch() -> None:
    """Delete the scratch tables written so far; results not yet computed lose their inputs."""
    while _SCRATCH:
        spark, path = _SCRATCH.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended; the folder's owner cleans it
            return


atexit.register(purge_scratch)


def shuffle_width(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def scan_tasks(df: DataFrame) -> int:
    """How many tasks a scan is cut into."""
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def spread(df: DataFrame) -> DataFrame:
    """Repartition a scan that gives fewer tasks than there are cores.

    A table of one small file with one row group is one task. Splitting it costs a shuffle of
    that file, so it is done only where the scan cannot fill the cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if scan_tasks(df) < min(cores, 4) else df


def on_disk_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of `df`."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
