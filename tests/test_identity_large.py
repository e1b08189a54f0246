"""Names of very many entities: one row a week, not one for each pair of a place and an entity."""

import random
import time
from itertools import permutations

from pyspark.sql import functions as F

from tallyspark.operators import identity


def test_seven_entities_and_more_like_all_permutations():
    r = random.Random(8)
    for k in range(200):
        n, rows = r.randrange(7, 9), r.randrange(1, 4)
        # few values, so that kinds are shared and places compete
        score = {(p, s): r.choice([-1.25, -0.5, 0.0]) if k % 2 else -float(p + 1) * (s % 3 + (k % 5 == 0) * s) for p in range(rows) for s in range(n)}
        tried = sorted((-round(sum(score[p, s] for p, s in enumerate(o)), 9), o) for o in permutations(range(n), rows))
        order, gap = identity.best_order(score, rows, n)
        assert tuple(order) == tried[0][1] and abs(gap - (tried[1][0] - tried[0][0])) < 1e-9


def test_a_name_of_two_thousand_entities(spark):
    entries, weeks, games = 2000, 40, 40
    apps = spark.range(weeks * games).select(F.lit("N").alias("name"), F.lit(2000).alias("season"), (F.col("id") / games).cast("int").alias("wk"), (F.col("id") % games).cast("int").alias("place"), F.concat(F.lit("A"), F.col("id") % 5).alias("opp"))
    settled = spark.createDataFrame([("N", entries, "deferred"), *((f"A{k}", 1, "one") for k in range(5))], "name string, n bigint, class string")
    roster = spark.createDataFrame([("N", f"{k:05}", k % 5 + 1) for k in range(entries)] + [(f"A{k}", "x", k + 1) for k in range(5)], "name string, school_id string, region int")
    log_p = spark.createDataFrame([(a, b, -0.5 if a == b else -2.0) for a in range(1, 6) for b in range(1, 6)], "ra int, rb int, log_p double")
    began = time.time()
    rows = identity.assign(apps, settled, roster, log_p).collect()
    assert time.time() - began < 60 and len(rows) == weeks
    assert all(r["gap"] == 0 and [s % 5 for s in r["order"]] == [p % 5 for p in range(games)] and r["order"] == list(range(games)) for r in rows)


def test_places_that_compete_for_kinds():
    r = random.Random(1)
    costs = [[r.randrange(1, 10**12) for _ in range(5)] for _ in range(5)] + [[0] * 5] * 5
    places = [r.choice(costs) for _ in range(300)]
    began = time.time()
    order, gap = identity.order_of_kinds([tuple(c) for c in zip(*places)], [list(range(k, 350, 5)) for k in range(5)], 300)
    assert time.time() - began < 20 and len(set(order)) == 300 and abs(gap) < 1e-9
