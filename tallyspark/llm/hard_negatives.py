"""Hard negatives: for an anchor and a near row of its own label, rows of other labels that score within a band below it.

Scores are inner products of integer vectors, made bit-plane by bit-plane: a
component plus 2^(K-1) is a number of K bits, so a score is a sum over planes
of 2^p times an anchor's product with a matrix of noughts and ones.  Planes are
taken most significant first.  What the planes not yet read can add lies
between two bounds that the anchor alone gives, so every pair has an interval
that halves with each plane; a pair goes as soon as its interval cannot meet
what is asked (to be among the best so far, or to fall into a band and among
the best there).  Once few pairs are left they are carried on one by one.
Scores of pairs that stay are exact.  Vectors too large for that in 64 bits are
multiplied in two halves, which are exact as well.

In Spark a block of anchors meets a block of rows in one task (a stated query
set against all rows, in blocks); tasks keep the best few of each anchor, and
these are ranked over all blocks.  Positives meet only rows of their label.
Blocks are dealt by hashes of row numbers, so no label, no copy and no repeated id makes a block large.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

POSITIVES, NEGATIVES = 5, 3
#: A negative's score is at least LOW and at most HIGH hundredths of the positive's.
LOW, HIGH = 50, 95
SCALE = 256
#: Anchors and rows that meet in one task, and the rows of a step inside it; bounds a task's memory.
ANCHORS, ROWS, STEP = 1024, 2048, 512
#: Pairs are carried on one by one when fewer than this share is left.
SPARSE = 1 / 16
#: Integers stay below this, so that the products of a plane and of a half are exact.
LARGEST = 2**30
#: Bits of the lower half of a large number, and components whose products with halves are summed at once.
HALF, WIDTH = 15, 128


def integer_vectors(embeddings: DataFrame, scale: int = SCALE, repeated: bool = False) -> DataFrame:
    """(vec_id, label, v): floor(scale * x) of each component, of rows that have a label and a vector of finite numbers.

    Rows of one vec_id are one row, the least of (label, v), or if ``repeated``
    each a row of its own; rows without an id take no part.  A component that
    does not fit stops the query, so no score is ever wrong for want of bits.
    """
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")))
    fits = F.forall("embedding", lambda c: F.abs(c.cast("double") * scale) < LARGEST)
    rows = embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(finite)
    v = F.when(fits, x.cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component times {scale} is not below {LARGEST}")).cast("array<int>"))
    rows = rows.select("vec_id", F.col("label").cast("bigint").alias("label"), v.alias("v"))
    return rows if repeated else rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of all pairs of rows of a and b from the upper and lower halves of b; what a long cannot hold is the largest or least long."""
    high, low = np.zeros((len(a), len(b)), np.int64), np.zeros((len(a), len(b)), np.int64)
    for s in range(0, a.shape[1], WIDTH):
        x, y = a[:, s : s + WIDTH].astype(np.float64), b[:, s : s + WIDTH]
        high += (x @ (y >> HALF).T.astype(np.float64)).astype(np.int64)
        low += (x @ (y & (1 << HALF) - 1).T.astype(np.float64)).astype(np.int64)
    high += low >> HALF
    edge, long = 1 << 63 - HALF, np.iinfo(np.int64)
    return np.where(high >= edge, long.max, np.where(high < -edge, long.min, (high << HALF) + (low & (1 << HALF) - 1)))


def surviving(a: np.ndarray, b: np.ndarray, keep: Callable, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of the allowed pairs of rows of a and b that keep(low, high, i) never dropped.

    keep gets bounds of the scores: two matrices with i None, or two vectors with the row of a of each.
    """
    bits = max(1, int(max(-int(b.min()), int(b.max()) + 1)).bit_length() + 1) if b.size else 1
    most = int(np.abs(a).sum(1).max(initial=0))
    if most << (bits + 2) >= 2**63 or most >= 2**53:
        score = products(a, b)
        i, j = np.nonzero(allowed & keep(score, score, None))
        return i, j, score[i, j]
    shifted = (b.astype(np.int64) + (1 << (bits - 1))).astype(np.int64)
    af = a.astype(np.float32 if most < 2**24 else np.float64)
    total = a.sum(1)
    down, up = np.minimum(a, 0).sum(1), np.maximum(a, 0).sum(1)
    score = np.repeat((-total * (1 << (bits - 1)))[:, None], len(b), 1)
    i = j = None
    for p in range(bits - 1, -1, -1):
        rest = (1 << p) - 1
        plane = (shifted >> p & 1).astype(af.dtype)
        if i is None:
            score += (af @ plane.T).astype(np.int64) << p
            alive = allowed & keep(score + rest * down[:, None], score + rest * up[:, None], None)
            if alive.sum() < SPARSE * alive.size:
                i, j = np.nonzero(alive)
                score = score[i, j]
        else:
            score = score + (np.einsum("ij,ij->i", af[i], plane[j]).astype(np.int64) << p)
            stay = keep(score + rest * down[i], score + rest * up[i], i)
            i, j, score = i[stay], j[stay], score[stay]
        if i is not None and not len(i):
            break
    if i is None:
        i, j = np.nonzero(alive)
        score = score[i, j]
    return i, j, score


def best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Positions of the first n of each group: higher scores first, ties by smaller id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    start = np.r_[True, g[1:] != g[:-1]]
    place = np.arange(len(g)) - np.maximum.accumulate(np.where(start, np.arange(len(g)), 0))
    return order[place < n]


def dense(rows: pa.Table, width: int) -> np.ndarray:
    """The column v as a matrix; shorter vectors end in noughts."""
    column = rows["v"].combine_chunks()
    out = np.zeros((len(column), width), np.int64)
    long = np.asarray(column.value_lengths())
    out[np.arange(width)[None, :] < long[:, None]] = np.asarray(column.flatten())
    return out


def matrices(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    width = max(int(np.asarray(t["v"].combine_chunks().value_lengths()).max(initial=0)) for t in (left, right))
    return dense(left, width), dense(right, width)


def numbers(rows: pa.Table, column: str) -> np.ndarray:
    return rows[column].to_numpy().astype(np.int64)


def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
    """(anchor, positive_id, score): the best POSITIVES other rows of a block for each anchor (a row number) of a block."""
    a, b = matrices(left, right)
    asking, rows, others = numbers(left, "row"), numbers(right, "row"), numbers(right, "vec_id")
    floor = np.full(len(asking), np.iinfo(np.int64).min)
    held = [np.empty(0, np.int64)] * 3
    for s in range(0, len(others), STEP):
        part = slice(s, s + STEP)

        def keep(low: np.ndarray, high: np.ndarray, i: np.ndarray | None) -> np.ndarray:
            return high >= (floor[:, None] if i is None else floor[i])

        i, j, score = surviving(a, b[part], keep, asking[:, None] != rows[part][None, :])
        held = [np.concatenate(x) for x in zip(held, (i, others[part][j], score))]
        top = best(held[0], held[2], held[1], POSITIVES)
        held = [x[top] for x in held]
        full = np.bincount(held[0], minlength=len(asking)) >= POSITIVES
        least = np.full(len(asking), np.iinfo(np.int64).max)
        np.minimum.at(least, held[0], held[2])
        floor = np.where(full, least, floor)
    if held[2].max(initial=0) == np.iinfo(np.int64).max:
        raise ValueError("the score of a positive is too large for a long")
    return pa.table({"anchor": asking[held[0]], "positive_id": held[1], "score": held[2]})


def hundredths(x: np.ndarray, n: int) -> np.ndarray:
    """n * x // 100 without a product that a long cannot hold."""
    return x // 100 * n + x % 100 * n // 100


def banded(left: pa.Table, right: pa.Table) -> pa.Table:
    """(anchor, place, anchor_id, positive_id, positive_score, negative_id, score), place being that in the anchor's list of positives: of a block the best NEGATIVES of other labels in the band of each positive."""
    a, b = matrices(left, right)
    ids, others = numbers(left, "vec_id"), numbers(right, "vec_id")
    mine, theirs = numbers(left, "label"), numbers(right, "label")
    asking = numbers(left, "row")
    names = ["anchor", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "score"]
    bands = left["positives"].combine_chunks()
    count = np.asarray(bands.value_lengths())
    flat = bands.flatten()
    row = np.repeat(np.arange(len(ids)), count)
    col = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    positive, reach = np.zeros((len(ids), POSITIVES), np.int64), np.zeros((len(ids), POSITIVES), np.int64)
    positive[row, col], reach[row, col] = np.asarray(flat.field("id")), np.asarray(flat.field("score"))
    # an empty band: no score is below its end and above its start
    low, high = np.ones((len(ids), POSITIVES), np.int64), np.zeros((len(ids), POSITIVES), np.int64)
    low[row, col], high[row, col] = -hundredths(-reach[row, col], LOW), hundredths(reach[row, col], HIGH)
    held = [np.empty(0, np.int64)] * 4
    for s in range(0, len(others), STEP):
        part = slice(s, s + STEP)

        def keep(under: np.ndarray, over: np.ndarray, i: np.ndarray | None) -> np.ndarray:
            at = (lambda m, k: m[:, k, None]) if i is None else (lambda m, k: m[i, k])
            out = np.zeros(under.shape, bool)
            for k in range(POSITIVES):
                out |= (over >= at(low, k)) & (under <= at(high, k))
            return out

        i, j, score = surviving(a, b[part], keep, mine[:, None] != theirs[part][None, :])
        for k in range(POSITIVES):
            fits = (score >= low[i, k]) & (score <= high[i, k])
            held = [np.concatenate(x) for x in zip(held, (i[fits], np.full(fits.sum(), k), others[part][j[fits]], score[fits]))]
        top = best(held[0] * POSITIVES + held[1], held[3], held[2], NEGATIVES)
        held = [x[top] for x in held]
        # what is worse than three found already need not be looked at again
        cell = held[0] * POSITIVES + held[1]
        full = np.bincount(cell, minlength=len(ids) * POSITIVES) >= NEGATIVES
        least = np.full(len(ids) * POSITIVES, np.iinfo(np.int64).max)
        np.minimum.at(least, cell, held[3])
        low = np.where(full.reshape(low.shape), np.maximum(low, np.where(full, least, 0).reshape(low.shape)), low)
    i, k = held[0], held[1]
    return pa.table(dict(zip(names, (asking[i], k, ids[i], positive[i, k], reach[i, k], held[2], held[3]))))


def parts(count: Column, size: int) -> Column:
    """Blocks of about ``size`` for so many rows."""
    return F.ceil(count / F.lit(size)).cast("int")


def block(c: str, n: Column, salt: int) -> Column:
    # an int like the numbers of blocks: keys of two types would be dealt to different tasks
    return F.pmod(F.xxhash64(F.col(c), F.lit(salt)), n).cast("int")


def met(anchors: DataFrame, rows: DataFrame, sizes: DataFrame, on: list[str], work: Callable, schema: str) -> DataFrame:
    """work() on every block of anchors with every block of rows whose columns ``on`` agree; sizes has (on, n_anchors, n_rows)."""
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    blocks = sizes.select(*on, parts(F.col("n_anchors"), ANCHORS).alias("na"), parts(F.col("n_rows"), ROWS).alias("nr")).filter("na > 0 and nr > 0")
    known = lambda df: df.join(blocks, on) if on else df.join(F.broadcast(blocks))  # noqa: E731  one row without on
    left = known(anchors).withColumn("x", block("row", F.col("na"), 1)).withColumn("y", each(F.col("nr")))
    right = known(rows).withColumn("y", block("row", F.col("nr"), 2)).withColumn("x", each(F.col("na")))
    # both sides come from one table: new names keep their columns apart
    left = left.toDF(*left.columns)
    names = [c.split()[0] for c in schema.split(", ")]
    none = {n: pa.array([], pa.int64()) for n in names}
    both = lambda a, b: work(a, b) if a.num_rows and b.num_rows else pa.table(none)
    return left.groupBy(*on, "x", "y").cogroup(right.groupBy(*on, "x", "y")).applyInArrow(both, schema)


def ranked(df: DataFrame, keys: list[str], item: str, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), item)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def mine(vectors: DataFrame, anchors: Column) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of integer vectors; anchors says which rows ask.

    Each of an anchor's first POSITIVES other rows of its label has the first
    NEGATIVES rows of other labels whose score is between LOW and HIGH hundredths
    of its own (so none where that is below zero).  Rows that share an id are
    rows of their own, as anchors and as what is found; a positive's score that
    a long cannot hold stops the query.  Vectors of unlike length
    are compared as if the shorter ended in noughts.  An empty table, one
    label alone, or no anchors: no rows.
    """
    rows = written(vectors.withColumn("asks", anchors).withColumn("row", F.monotonically_increasing_id()))
    asking = rows.filter("asks").drop("asks")
    labelled = rows.groupBy("label").agg(F.count_if("asks").alias("n_anchors"), F.count(F.lit(1)).alias("n_rows"))
    near = met(asking, rows.drop("asks"), labelled, ["label"], lambda a, b: nearest(a, b), "anchor bigint, positive_id bigint, score bigint")
    positives = ranked(near, ["anchor"], "positive_id", POSITIVES).groupBy(F.col("anchor").alias("row")).agg(F.array_sort(F.collect_list(F.struct(F.col("positive_id").alias("id"), "score"))).alias("positives"))
    banding = asking.join(positives, "row")
    # anchors without a positive only make blocks smaller
    sizes = rows.agg(F.count_if("asks").alias("n_anchors"), F.count(F.lit(1)).alias("n_rows"))
    found = met(banding, rows.drop("asks"), sizes, [], lambda a, b: banded(a, b), "anchor bigint, place bigint, anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, score bigint")
    return ranked(found, ["anchor", "place"], "negative_id", NEGATIVES).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))
