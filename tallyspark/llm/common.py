"""Small helpers shared by the text operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The held-out fold of labelled rows: these never teach a model.
FOLDS, HELD_OUT = 4, 2
#: Rows whose bytes go through one numpy block; bounds a Python worker's memory.
BLOCK_BYTES = 2_000_000
#: Bytes of an Arrow batch that is sent to a Python worker, unless the session sets another bound.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(str(PurePosixPath(sf_dir) / f"{name}.parquet") if "://" not in sf_dir else f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """True for the fold no model learns from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def batched(df: DataFrame) -> DataFrame:
    """df, after the session was told to bound Arrow batches by bytes: texts differ so much in length that a bound in rows bounds nothing."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, BATCH_BYTES)
    return df


def can_cut(spark: SparkSession) -> None:
    """Make sure checkpoint() has a folder: the session's own; only a local master, as in tests, gets one made here."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tallyspark-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from what was written."""
    can_cut(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As cut(), for wide rows: a Parquet table in the same folder takes a fraction of the room."""
    can_cut(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator, rows: int = 250) -> Iterator:
    """Arrow arrays in runs of at most ``rows``, so that what is made of one run is gone before the next."""
    for batch in batches:
        for a in range(0, len(batch), rows):
            yield batch.slice(a, rows)


def blocks(texts: Iterable[str | None], limit: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """Texts as UTF-8, in runs of about ``limit`` bytes; a longer text is a run of its own."""
    run: list[bytes] = []
    held = 0
    for text in texts:
        raw = (text or "").encode("utf-8", "replace")
        if run and held + len(raw) > limit:
            yield run
            run, held = [], 0
        run.append(raw)
        held += len(raw)
    if run:
        yield run
