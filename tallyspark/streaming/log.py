"""The forecast log as a stream: snapshots arrive, the log is revised until its games are played, then frozen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.history import record


def latest(spark: SparkSession, folder: str, schema) -> tuple[DataFrame, int]:
    """The newest version of the log in the folder, and its number; an empty log and -1 before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(f.getPath().getName()[1:]) for f in (fs.listStatus(path) if fs.exists(path) else []) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    if not done:
        return spark.createDataFrame([], schema), -1
    return spark.read.schema(schema).parquet(f"{folder}/v{max(done)}"), max(done)


def run_log(snapshots: DataFrame, played: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Record each arriving batch of snapshots; version N of the log is written by batch N, whole, so a repeated batch writes the same again."""
    schema = snapshots.schema

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        log, version = latest(spark, folder, schema)
        if version >= number:
            return
        record(log, batch, played).drop("action").select(*schema.names).write.mode("overwrite").parquet(f"{folder}/v{number}")

    return snapshots.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
