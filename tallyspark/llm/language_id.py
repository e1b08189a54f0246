"""Language identification by the nearest of several centroids per language.

A text becomes counts of its hashed byte 2- and 3-grams (word edges marked),
weighted by TF-IDF and scaled to length one.  The training rows of a language
are clustered by spherical k-means; a text takes the language of the centroid
with the largest cosine, and is rejected where the cosine is lower than nearly
all training texts of its length reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, blocks, held_out, slices, written

#: Hashed n-gram buckets, centroids per language, and rows a language may teach with (the bound of the fitting sample).
BUCKETS, CLUSTERS, SAMPLE = 4096, 4, 400
#: A text is rejected below SLACK times the LOW quantile of its length class.
LOW, SLACK = 0.005, 0.5
#: Bytes that part words: ASCII other than letters; A-Z become a-z, other bytes stay.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def gram_counts(raws: list[bytes], buckets: int = BUCKETS) -> np.ndarray:
    """Counts of hashed 2- and 3-grams: a float32 row for each text. Runs of other bytes count as one edge."""
    texts = [b" " + b" ".join(words) + b" " if (words := r.translate(WORD_BYTES).split()) else b"" for r in raws]
    out = np.zeros((len(texts), buckets), np.float32)
    flat = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    if len(flat) < 3:
        return out
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    two = flat[:-1] * np.uint32(257) + flat[1:]
    three = two[:-1] * np.uint32(263) + flat[2:]
    for grams, n in ((two, 2), (three, 3)):
        same = rows[: len(grams)] == rows[n - 1 :]
        mixed = (grams * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(16)
        at = rows[: len(grams)][same] * buckets + (mixed[same] % np.uint32(buckets))
        out += np.bincount(at, minlength=out.size).reshape(out.shape).astype(np.float32)
    return out


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def length_class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(1 + counts.sum(1)).astype(int), 15)


@dataclass
class Centroids:
    """CLUSTERS rows of BUCKETS floats a language: 64 KB each, so all languages of the world are under 500 MB, and four are 256 KB."""

    langs: list[str]
    of: np.ndarray
    matrix: np.ndarray
    idf: np.ndarray
    least: np.ndarray

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, cosine, and whether the text is near enough."""
        near = vectors(counts, self.idf) @ self.matrix.T
        best = near.argmax(1)
        cosine = near[np.arange(len(near)), best].clip(0, 1)
        return self.of[best], cosine, cosine >= self.least[length_class(counts)]


def clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from the first row and those least like what is chosen."""
    centres = x[:1]
    while len(centres) < min(k, len(x)):
        centres = np.vstack([centres, x[(x @ centres.T).max(1).argmin()]])
    for _ in range(rounds):
        mine = (x @ centres.T).argmax(1)
        sums = np.stack([x[mine == c].sum(0) if (mine == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def fit(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, k: int = CLUSTERS) -> Centroids | None:
    """Learn from rows outside the held-out fold with a language and a letter in the text; about ``sample`` rows of a language, twice that at most. None without such rows.

    Each language is clustered in a task of its own; only centroids, document
    frequencies by partition, and a cosine for each sampled row come to the driver.
    """
    known = documents.filter(~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return None
    shares = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, sample / n))])
    drawn = known.filter(F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) < shares[F.col("lang")] * 1_000_000).limit(2 * sample * len(sizes))

    @F.arrow_udf("binary")
    def counts_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in slices(batches, 64):
            yield pa.array([np.minimum(row, 65535).astype(np.uint16).tobytes() for run in blocks(batch.to_pylist()) for row in gram_counts(run)], pa.binary())

    rows = written(batched(drawn).select("lang", counts_of("text").alias("counts"), F.xxhash64("id", "text").alias("h")))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(BUCKETS, np.int64)
        for batch in batches:
            x = matrix_of(batch.column(0))
            n, df = n + len(x), df + (x > 0).sum(0)
        yield pa.RecordBatch.from_pydict({"n": [n], "df": [df.tobytes()]})

    parts = batched(rows.select("counts").coalesce(16)).mapInArrow(frequencies, "n bigint, df binary").collect()
    n, df = sum(r["n"] for r in parts), sum((np.frombuffer(r["df"], np.int64) for r in parts), np.zeros(BUCKETS, np.int64))
    if not n:
        return None
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(1)

    def clustered(key: tuple, table: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(table["h"])
        found = clusters(vectors(matrix_of(table["counts"].combine_chunks().take(order)), idf), k)
        return pa.table({"lang": pa.array([key[0].as_py()] * len(found)), "k": pa.array(range(len(found)), pa.int32()), "centroid": pa.array([c.astype(np.float32).tobytes() for c in found], pa.binary())})

    found = sorted(rows.groupBy("lang").applyInArrow(clustered, "lang string, k int, centroid binary").collect(), key=lambda r: (r["lang"], r["k"]))
    langs = sorted({r["lang"] for r in found})
    matrix = np.stack([np.frombuffer(r["centroid"], np.float32) for r in found])
    model = Centroids(langs, np.array([langs.index(r["lang"]) for r in found]), matrix, idf, np.zeros(16))
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch.column(0))
            yield pa.RecordBatch.from_pydict({"long": length_class(x).astype(np.int32), "cosine": sent.value.predict(x)[1].astype(np.float64)})

    near = batched(rows.select("counts")).mapInArrow(nearest, "long int, cosine double").toArrow()
    long, best = near["long"].to_numpy(), near["cosine"].to_numpy()
    low = [np.quantile(best[long <= c], LOW) if (long <= c).any() else 0.0 for c in range(16)]
    return replace(model, least=SLACK * np.minimum.accumulate(np.array(low)[::-1])[::-1])


def matrix_of(counts: pa.Array) -> np.ndarray:
    """Rows of counts from their bytes."""
    rows = [np.frombuffer(c.as_buffer(), np.uint16) for c in counts]
    return np.stack(rows).astype(np.float32) if rows else np.zeros((0, BUCKETS), np.float32)


def predictor(model: Centroids | None, spark):
    """A column function: text -> (lang_pred, score, near)."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double,near:boolean>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        for batch in batches:
            langs, scores, nears = [], [], []
            texts = batch.to_pylist()
            for run in blocks(texts, 1_000_000):
                for part in (run[i : i + 256] for i in range(0, len(run), 256)):
                    if m is None:
                        found = [(-1, 0.0, False)] * len(part)
                    else:
                        found = zip(*m.predict(gram_counts(part)))
                    for i, cosine, near in found:
                        langs.append(None if i < 0 else m.langs[i])
                        scores.append(float(cosine))
                        nears.append(bool(near))
            for i, text in enumerate(texts):
                if langs[i] is None or not text or not any(map(str.isalpha, text)):
                    langs[i], scores[i], nears[i] = "und", 0.0, False
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(nears, pa.bool_())], ["lang_pred", "score", "near"])

    return predict


def identify_languages(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Centroids | None = None) -> DataFrame:
    """(id, held_out, lang_pred, score, near): one row for each document.

    Null texts and texts without a letter are ``und`` with score 0; so is every
    text when no row can teach.  ``near`` is false for these and for texts
    that the distance rejects.  A tie goes to the language that sorts first.
    A null id counts as held out.  Repeated rows stay; other columns are not read.
    """
    model = model or fit(documents, id_col=id_col, text_col=text_col, lang_col=lang_col)
    found = batched(documents).select(F.col(id_col).alias(id_col), held_out(F.col(id_col)).alias("held_out"), predictor(model, documents.sparkSession)(F.col(text_col)).alias("p"))
    return found.select(id_col, "held_out", "p.lang_pred", "p.score", "p.near")


def keep_known_languages(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose text is near a centroid, all columns.

    Null texts and texts without a letter are near none and go; a tie between
    languages stays; repeated rows are judged alike and all stay or go; without
    a language to learn from, and on an empty table, there are no rows.
    """
    model = fit(documents, id_col=id_col, text_col=text_col, lang_col=lang_col)
    row = F.struct(*documents.columns).alias("row")
    return batched(documents).select(row, predictor(model, documents.sparkSession)(F.col(text_col)).alias("p")).filter("p.near").select("row.*")
