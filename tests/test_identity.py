"""The order of same-named entities: against all permutations, and beyond six of them."""

import random
from itertools import permutations

from pyspark.sql import functions as F

from tallyspark.operators import identity
from tallyspark.plans.queries_identity import assigned, tables


def by_permutations(score, rows, n):
    tried = sorted(((-sum(score.get((p, s), 0.0) for p, s in enumerate(order)), order) for order in permutations(range(n), rows)), key=lambda t: (round(t[0], 9), t[1]))
    return list(tried[0][1]), tried[1][0] - tried[0][0] if len(tried) > 1 else None


def test_order_like_all_permutations():
    r = random.Random(4)
    for k in range(400):
        n = r.randrange(1, 7)
        rows = r.randrange(1, n + 1)
        draw = (lambda: r.choice([-1.25, -0.5, 0.0])) if k % 2 else (lambda: -r.random() * 4)
        score = {(p, s): draw() for p in range(rows) for s in range(n) if r.random() < 0.9}
        (order, gap), (want, far) = identity.best_order(score, rows, n), by_permutations(score, rows, n)
        assert order == want
        assert (gap is None) == (far is None) and abs((gap or 0.0) - (far or 0.0)) < 1e-9


def test_more_than_six_entities(spark):
    perm = random.Random(5).sample(range(23), 23)
    score = {(p, s): -1.0 if perm[p] == s else -2.0 for p in range(23) for s in range(23)}
    assert identity.best_order(score, 23, 23) == (perm, 2.0)
    apps = spark.createDataFrame([("N", 2000, 1, 0, "A")], "name string, season int, wk int, place int, opp string")
    settled = spark.createDataFrame([("N", 9, "deferred", None), ("A", 1, "one", "A|I-2")], "name string, n bigint, class string, id string")
    roster = spark.createDataFrame([("N", str(k), k) for k in range(1, 10)] + [("A", "x", 2)], "name string, school_id string, region int")
    log_p = spark.range(1, 10).select(F.col("id").cast("int").alias("ra"), F.lit(2).alias("rb"), (-F.abs(F.col("id") - 4.25)).alias("log_p"))
    row = identity.assign(apps, settled, roster, log_p).first()
    assert row["order"] == [3] and abs(row["gap"] - 0.5) < 1e-9


def test_a_table_with_larger_groups(spark):
    sf = "/root/testdata/sf0.1"
    assert tables(spark, sf)[3].filter("class = 'deferred' and n > 6").count() > 0
    for row in assigned(spark, sf).collect():
        assert len(set(row["order"])) == len(row["order"]) and row["gap"] > -1e-9
