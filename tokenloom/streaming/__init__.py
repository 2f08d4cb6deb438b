"""Run metrics as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_log_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Log files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_losses(log: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(run_id, split, window, mean_loss, n) over event time; rows later than `late` are dropped,
    repeated rows count once, losses that are no numbers do not count."""
    once = log.withWatermark("logged_at", late).dropDuplicatesWithinWatermark(["run_id", "iter", "split", "logged_at"])
    return once.groupBy("run_id", "split", F.window("logged_at", width)).agg(F.avg(F.when(~F.isnan("loss"), F.col("loss"))).alias("mean_loss"), F.count_if(~F.isnan("loss")).alias("n"))
