"""Toxicity: logistic regression over hashed word n-grams and skip-grams, fitted by FTRL-proximal.

Features are the distinct hashed words and stems, pairs of neighbours and pairs
with one word between.  Each coordinate has its own learning rate, and the L1 term
leaves most weights at zero, so the model is a short table that is broadcast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, held_out, written

BITS = 20
#: The bound of the fitting sample: about SAMPLE labelled rows, and FEATURES features (four bytes each) in all of them. Passes over them.
SAMPLE, FEATURES, EPOCHS = 10_000, 8_000_000, 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.1
THRESHOLD = 0.3
#: A longer word also counts as its first bytes, so that its endings share what they teach.
STEMS = (4, 6)
#: Words hashed at a time, so that a very long text needs no more memory.
WORDS = 200_000
#: Bytes that part words: ASCII other than letters and digits; A-Z become a-z.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b > 127 else 32 for b in range(256))


def features(text: str | None, bits: int = BITS) -> Iterator[np.ndarray]:
    """Hashed features of a text, in runs that overlap by two words."""
    words = (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()
    shift = np.uint64(64 - bits)
    for a in range(0, len(words), WORDS):
        run = words[max(0, a - 2) : a + WORDS]
        w = np.fromiter(map(crc32, run), np.uint64)
        stem = np.fromiter((crc32(x[:n]) + n for n in STEMS for x in run if len(x) > n), np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        one, odd = (w + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
        two = (one[:-1] * np.uint64(31) + w[1:] + np.uint64(7)) * odd
        gap = (one[:-2] * np.uint64(37) + w[2:] + np.uint64(11)) * odd
        yield (np.concatenate([one, stem, two, gap]) >> shift).astype(np.int32)


@dataclass
class Weights:
    """Non-zero weights by hashed feature, as one table of 2**bits floats."""

    table: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        hit: set[int] = set()
        for at in features(text, int(np.log2(len(self.table)))):
            hit.update(at[self.table[at] != 0].tolist())
        z = self.bias + float(self.table[np.fromiter(hit, np.int64)].sum()) if hit else self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def ftrl(rows: list[np.ndarray], labels: list[int], epochs: int = EPOCHS, bits: int = BITS) -> Weights:
    """One row at a time: w = -(z - sign(z) L1) / ((beta + sqrt(n)) / alpha + L2) where |z| > L1, else 0. The bias has no penalty."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    rate = sum(labels) / max(1, len(labels))
    bias = bias0 = float(np.log(max(rate, 1e-3) / max(1 - rate, 1e-3)))
    bias_n = 0.0

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) > L1, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2), 0.0)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at = rows[k]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -30, 30))) - labels[k]
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at] = zi + g - step * w
            n[at] = ni + g * g
            bias_n += g * g
            bias -= 0.05 * g / (1 + np.sqrt(bias_n))
    return Weights(weights(z, n).astype(np.float32), bias if labels else bias0)


def in_order(drawn: DataFrame) -> tuple[list[np.ndarray], list[int]]:
    """The features and labels of drawn (id, y, f), ordered by id, then f.

    They come one part of the table at a time into one array, so neither the
    JVM nor Python of the driver holds them twice; it has other work to do.
    """
    size = drawn.agg(F.coalesce(F.sum(F.length("f")), F.lit(0))).first()[0] // 4
    every, ends, ids, marked = np.empty(size, np.int32), [0], [], []
    for r in drawn.select("id", "y", "f").toLocalIterator():
        ends.append(ends[-1] + len(r["f"]) // 4)
        every[ends[-2] : ends[-1]] = np.frombuffer(r["f"], np.int32)
        ids.append(r["id"])
        marked.append(r["y"])
    rows = [every[a:b] for a, b in zip(ends, ends[1:])]
    again = {i for i, n in Counter(ids).items() if n > 1}
    order = sorted(range(len(ids)), key=lambda k: (ids[k], rows[k].tobytes() if ids[k] in again else b""))
    return [rows[k] for k in order], [marked[k] for k in order]


def fit(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Weights:
    """Learn from labelled rows outside the held-out fold, about ``sample`` of them and twice that at most, each a whole text.

    Where their features are more than FEATURES, a smaller share of the rows
    is drawn, so what comes to the driver is bounded in bytes.  Null labels teach nothing; a repeated id teaches with its largest label.
    Without labelled rows every score is that of the prior (under 0.01).
    """
    marks = labels.filter(~held_out(F.col(id_col))).filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    size = marks.count()
    drawn = marks.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < min(1.0, sample / max(1, size)) * 1_000_000).limit(2 * sample)
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id").limit(2 * sample)

    @F.arrow_udf("binary")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([np.unique(np.concatenate([*features(t.as_py()), np.zeros(0, np.int32)])).tobytes() for t in batch], pa.binary())

    drawn_rows = written(batched(texts).select("id", "y", hashed("text").alias("f")))
    held = drawn_rows.agg(F.coalesce(F.sum(F.length("f") / 4), F.lit(0.0))).first()[0]
    if held > FEATURES:
        drawn_rows = drawn_rows.filter(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(1_000_000)) < FEATURES / held * 1_000_000)
    rows, marked = in_order(drawn_rows)
    return ftrl(rows, [int(y > 0) for y in marked])


def scorer(model: Weights, spark):
    """A column function: text -> score."""
    at = np.flatnonzero(model.table)
    sent = spark.sparkContext.broadcast((len(model.table), at, model.table[at], model.bias))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        size, at, values, bias = sent.value
        table = np.zeros(size, np.float32)
        table[at] = values
        weights = Weights(table, bias)
        for batch in batches:
            yield pa.array([float(weights.score(t.as_py())) for t in batch], pa.float64())

    return score


def score_toxicity(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, model: Weights | None = None) -> DataFrame:
    """(id, held_out, score, predicted): one row for each document.

    Null and empty texts have the score of the bias alone.  A null id counts
    as held out.  Repeated rows stay; other columns are not read.
    """
    model = model or fit(documents, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    found = batched(documents).select(F.col(id_col).alias(id_col), held_out(F.col(id_col)).alias("held_out"), scorer(model, documents.sparkSession)(F.col(text_col)).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score under the threshold, all columns.

    Null and empty texts have the score of the bias alone; a score equal to
    the threshold goes; repeated rows are scored alike; without labels nothing
    goes, and an empty table stays empty.
    """
    model = fit(documents, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    row = F.struct(*documents.columns).alias("row")
    return batched(documents).select(row, scorer(model, documents.sparkSession)(F.col(text_col)).alias("score")).filter(F.col("score") < threshold).select("row.*")
