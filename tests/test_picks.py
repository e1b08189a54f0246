"""Short names and the full names they may mean: against the rule on all pairs, and in a week of very many games."""

import time

from pyspark.sql import functions as F

from tallyspark.functions import extract as x

FULLS = ["Central (Philadelphia)", "Central (Pittsburgh)", "St. Mary's (Erie)", "Mary (St Erie)", "Upper Darby (Lower Merion)", "Darby", "1st Avenue (York)", "York (Upper Darby)", "O'Hara (New Castle)", "New-Hope (Hope)", " (Hope)"]
SHORTS = ["Central", "Central (Phil)", "Phil Central", "Central Pitt", "St Mary", "Erie St. Mary's", "Darby", "Upper Darby", "U D", "1st", "York", "O'H (New C)", "OHara New", "New Hope", "N H", "Nowhere", "", "Hope", "Central Nowhere"]


def test_meanings_like_all_pairs(spark):
    shorts = spark.createDataFrame([(s,) for s in SHORTS], "short string")
    fulls = spark.createDataFrame([(f,) for f in FULLS], "full string")
    want = shorts.crossJoin(fulls).filter(x.compatible(F.col("short"), F.col("full")))
    assert sorted(map(tuple, x.meanings(shorts, fulls).collect())) == sorted(map(tuple, want.collect())) != []


def test_a_week_of_many_games_with_one_initial(spark):
    n = 5000
    letters = lambda c: F.translate(c.cast("string"), "0123456789", "abcdefghij")
    name = lambda c: F.concat(F.lit("V"), letters(c), F.lit("x"))
    fixtures = spark.range(n).select(F.lit(7).alias("wk"), F.concat(name(F.col("id")), F.lit(" (Ca)")).alias("home"), F.concat(name(F.col("id") + n), F.lit(" (Cb)")).alias("away"))
    picks = spark.range(n).select(F.lit(7).alias("wk"), F.col("id").alias("pick"), name(F.col("id")).alias("fav"), F.concat(F.lit("Cb "), name(F.col("id") + n)).alias("dog"), F.lit(True).alias("fav_home"), F.lit(3).alias("margin"), F.lit(0.6).alias("fav_p"))
    began = time.time()
    assert x.match_picks(picks, fixtures).filter("n = 1").count() == n
    assert time.time() - began < 60
