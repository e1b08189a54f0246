"""Hard negatives against plain sorting of all scores, and intervals against exact products."""

import math

import numpy as np
import pytest

from tallyspark.llm import hard_negatives as hn
from tallyspark.llm import queries


def brute(rows, asks):
    """rows: {id: (label, vector of ints)}."""
    out = set()
    width = max((len(v) for _, v in rows.values()), default=0)
    full = {k: np.array(list(v) + [0] * (width - len(v)), dtype=object) for k, (_, v) in rows.items()}
    for a in filter(asks, rows):
        score = {k: int(sum(full[a] * full[k])) for k in rows}
        order = sorted(rows, key=lambda k: (-score[k], k))
        for p in [k for k in order if k != a and rows[k][0] == rows[a][0]][:5]:
            fits = [k for k in order if rows[k][0] != rows[a][0] and 50 * score[p] <= 100 * score[k] <= 95 * score[p]][:3]
            out |= {(a, p, n + 1, k, score[p], score[k]) for n, k in enumerate(fits)}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(k, lab, [int(x) for x in v]) for k, (lab, v) in rows.items()], "vec_id bigint, label int, v array<int>")


@pytest.mark.parametrize("spread,blocks", [(3, (4, 5, 2)), (100, (1024, 2048, 512)), (2**20, (7, 16, 5))])
def test_like_sorting(spark, monkeypatch, spread, blocks):
    for name, value in zip(("ANCHORS", "ROWS", "STEP"), blocks):
        monkeypatch.setattr(hn, name, value)
    rng = np.random.default_rng(spread)
    # few values make many ties; ids are not in order; some vectors are copies, short or empty
    rows = {int(k): (int(rng.integers(3)), rng.integers(-spread, spread + 1, rng.choice([8, 8, 8, 5, 0]))) for k in rng.permutation(140)}
    for k in range(0, 30, 3):
        rows[k] = (rows[k][0], rows[1][1])
    got = hn.mine(frame(spark, rows), hn.F.col("vec_id") % 10 == 0).collect()
    want = brute(rows, lambda k: k % 10 == 0)
    assert want and {tuple(r) for r in got} == want and len(got) == len(want)


def test_intervals_hold_the_score():
    rng = np.random.default_rng(0)
    a, b = rng.integers(-300, 300, (20, 16)), rng.integers(-300, 300, (30, 16))
    seen = []
    exact = a @ b.T

    def keep(low, high, i):
        if i is None:
            assert ((low <= exact) & (exact <= high)).all()
            seen.append((high - low).max())
        return high >= 100_000

    i, j, s = hn.surviving(a, b, keep, np.ones((20, 30), bool))
    assert set(zip(i, j)) == set(zip(*np.nonzero(exact >= 100_000))) and (s == exact[i, j]).all()
    assert seen == sorted(seen, reverse=True)


def test_which_rows_take_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.001], 1), (1, [0.25, 0.0], 2), (2, None, 1), (3, [0.1, None], 1), (4, [nan, 0.0], 1), (5, [inf], 1), (6, [0.1], None), (7, [], 1), (None, [1.0], 1)]
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, score double, rank string")
    assert {(r.vec_id, r.label, tuple(r.v)) for r in hn.integer_vectors(df).collect()} == {(1, 1, (128, -1)), (7, 1, ())}
    assert hn.mine(hn.integer_vectors(df.limit(0)), hn.F.lit(True)).count() == 0
    assert hn.mine(hn.integer_vectors(df), hn.F.lit(True)).count() == 0
    with pytest.raises(Exception, match="a component"):
        hn.integer_vectors(spark.createDataFrame([(1, [1e9], 1)], "vec_id bigint, embedding array<double>, label int")).collect()


def brute_query(rows):
    """op11's contract over (vec_id, embedding, label), a row at a time in whole numbers."""
    kept = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows]
    out = []
    for a in (r for r in kept if r[0] % 50 == 0):
        scored = sorted(((-sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1], r is a) for r in kept), key=lambda s: s[:2])
        for p, i, *_ in [s for s in scored if s[2] == a[1] and not s[3]][:5]:
            fits = [s for s in scored if s[2] != a[1] and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(a[0], i, k + 1, s[1], -p, -s[0]) for k, s in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("scale,again", [(1.0, 150), (6e5, 0), (6e5, 80)])
def test_query_on_repeated_ids_and_large_numbers(spark, tmp_path, scale, again):
    rng = np.random.default_rng(7)
    made = lambda i: (i, [float(x) for x in np.float32(rng.normal(size=16) * scale)], int(rng.integers(3)))
    rows = [made(i) for i in range(300)]
    # ids again: another vector and label, and whole rows
    rows += [made(i) for i in range(again)] + [(*r,) for r in rows[:again:2]]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert sorted(tuple(r) for r in queries.op11_hard_negatives(spark, str(tmp_path)).collect()) == brute_query(rows)


def test_every_block_meets_every_other(spark, monkeypatch):
    """Blocks that stay in many tasks, as those of a large table do."""
    for name, value in (("ANCHORS", 7), ("ROWS", 16)):
        monkeypatch.setattr(hn, name, value)
    rng = np.random.default_rng(11)
    rows = {k: (int(rng.integers(3)), rng.integers(-100, 101, 8)) for k in range(300)}
    held = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        got = hn.mine(frame(spark, rows), hn.F.col("vec_id") % 10 == 0).collect()
    finally:
        for c, value in held.items():
            spark.conf.set(c, value)
    assert sorted(tuple(r) for r in got) == sorted(brute(rows, lambda k: k % 10 == 0))


def test_halves_make_exact_scores():
    rng = np.random.default_rng(9)
    a, b = rng.integers(-(2**30) + 1, 2**30, (9, 300)), rng.integers(-(2**30) + 1, 2**30, (11, 300))
    a[0], b[0], b[1] = 2**30 - 1, 2**30 - 1, -(2**30) + 1
    want = a.astype(object) @ b.astype(object).T
    assert (hn.products(a, b) == np.clip(want, -(2**63), 2**63 - 1).astype(np.int64)).all()
    assert want.max() > 2**63 and (abs(want) < 2**63).sum() > 20
