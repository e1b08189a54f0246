"""Cutting a lineage: what is read often, or grows from round to round, is written to the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_cut(spark: SparkSession) -> None:
    """A folder for checkpoint(): the session's own setting; only a local master gets one made here."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tallyspark-"))


def cut(df: DataFrame) -> DataFrame:
    ensure_cut(df.sparkSession)
    return df.checkpoint()


class Rounds:
    """Tables of a loop, in the same folder: each is read with the size it was written with, so a later round is planned like the first.

    checkpoint() would hand on the estimates of the plan it cuts, which joins
    multiply round by round.  What is two tables of a name old is deleted.
    """

    def __init__(self, spark: SparkSession) -> None:
        ensure_cut(spark)
        self.spark, self.kept = spark, {}
        self.folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/rounds-{uuid.uuid4().hex}"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.kept.setdefault(name, []).append(path)
        while len(self.kept[name]) > 2:
            self.delete(self.kept[name].pop(0))
        return self.spark.read.schema(df.schema).parquet(path)

    def delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
