"""Appearances, records, strength of schedule, ranks, and the integrity of a game table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.arena import safe_round


def appearances(games: DataFrame) -> DataFrame:
    """Two rows for each game, one for each side, home first: (season, wk, game_id, seq, team, opp, pf, pa, is_home, neutral, outcome)."""
    side = lambda seq, team, opp, pf, pa: F.struct(F.lit(seq).alias("seq"), F.col(team).alias("team"), F.col(opp).alias("opp"), F.col(pf).alias("pf"), F.col(pa).alias("pa"))
    both = games.select("season", "wk", "game_id", "neutral", F.explode(F.array(side(0, "home", "away", "hs", "aw"), side(1, "away", "home", "aw", "hs"))).alias("s"))
    return both.select("season", "wk", "game_id", "neutral", "s.*").withColumns({"is_home": F.col("seq") == 0, "outcome": outcome(F.col("pf") - F.col("pa"))})


def outcome(margin: Column) -> Column:
    return F.when(margin > 0, 1.0).when(margin < 0, 0.0).otherwise(0.5)


def records(games: DataFrame) -> DataFrame:
    """(season, team, games, w, l, t, pd): one aggregate over both sides, combined before the shuffle."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return appearances(games).groupBy("season", "team").agg(
        F.count(F.lit(1)).alias("games"),
        one(F.col("pf") > F.col("pa")).alias("w"),
        one(F.col("pf") < F.col("pa")).alias("l"),
        one(F.col("pf") == F.col("pa")).alias("t"),
        F.sum((F.col("pf") - F.col("pa")).cast("long")).alias("pd"),
    )


def strength_of_schedule(games: DataFrame, ratings: DataFrame) -> DataFrame:
    """(team, sos): the mean rating of the opponents met, each meeting counted; 0 for a team without rated opponents."""
    met = appearances(games).select("team", "opp").join(ratings.select(F.col("team").alias("opp"), "rating"), "opp", "left")
    return met.groupBy("team").agg(safe_round(F.coalesce(F.avg("rating"), F.lit(0.0)), 2).alias("sos"))


def ranks(ratings: DataFrame, roster: DataFrame, record: DataFrame) -> DataFrame:
    """(team, rating, overall, in_division, in_region) of league teams that have played; ties by team.

    The overall rank needs one global order.  It is counted from rating
    buckets: a running sum over the bucket counts, then ranks inside buckets,
    so no single task sorts all teams.
    """
    teams = ratings.join(roster.filter("in_league").select("team", "division", "region"), "team").join(record.filter("games > 0").select("team"), "team", "left_semi")
    bucketed = teams.withColumn("bucket", F.floor("rating"))
    sizes = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    above = sizes.select("bucket", (F.sum("n").over(Window.orderBy(F.desc("bucket"))) - F.col("n")).alias("above"))
    inside = Window.partitionBy("bucket").orderBy(F.desc("rating"), "team")
    by = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(F.desc("rating"), "team"))
    return bucketed.join(above, "bucket").select("team", "rating", (F.col("above") + F.row_number().over(inside)).cast("long").alias("overall"), by("division").cast("long").alias("in_division"), by("region").cast("long").alias("in_region"))


def integrity(games: DataFrame) -> DataFrame:
    """(season, wk, team, n): teams with more than one game in a week."""
    return appearances(games).groupBy("season", "wk", "team").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def name_universe(games: DataFrame, roster: DataFrame, names: DataFrame) -> DataFrame:
    """(name, in_games, in_roster, slots): every name of either side, by a full outer join of distinct names."""
    seen = appearances(games).join(names.select("team", "name"), "team").select("name").distinct().withColumn("in_games", F.lit(True))
    slots = roster.groupBy("name").agg(F.count(F.lit(1)).alias("slots")).withColumn("in_roster", F.lit(True))
    return seen.join(slots, "name", "full_outer").select("name", F.coalesce("in_games", F.lit(False)).alias("in_games"), F.coalesce("in_roster", F.lit(False)).alias("in_roster"), F.coalesce("slots", F.lit(0).cast("long")).alias("slots"))


def simultaneous(named: DataFrame) -> DataFrame:
    """(name, most): the most appearances of a name in one week; named has name, season, wk."""
    return named.groupBy("name", "season", "wk").agg(F.count(F.lit(1)).alias("n")).groupBy("name").agg(F.max("n").alias("most"))
