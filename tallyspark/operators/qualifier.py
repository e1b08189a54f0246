"""The two-level qualifier: points for who you beat and for whom they beat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.arena import LAST_REGULAR_WEEK, safe_round
from .records import appearances

#: Points for beating a team of each division, and for any other (fixed values).
DIVISION_POINTS = {"I": 6.5, "II": 6.0, "III": 5.5, "IV": 5.0, "V": 4.5, "VI": 4.0, "VII": 3.5}
OTHER_POINTS = 6.0
PER_REGION, BYES = 12, 4


def division_value(division: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in DIVISION_POINTS.items() for x in kv])
    return F.when(division.isNull(), OTHER_POINTS).otherwise(F.coalesce(F.try_element_at(table, division), F.lit(OTHER_POINTS)))


def regular(games: DataFrame, last_week: int = LAST_REGULAR_WEEK) -> DataFrame:
    return games.filter(F.col("wk") <= last_week)


def wins(games: DataFrame) -> DataFrame:
    """(team, opp): one row for each win; beating a team twice gives two."""
    return appearances(games).filter("pf > pa").select("team", "opp")


def games_played(games: DataFrame) -> DataFrame:
    return appearances(games).groupBy("team").agg(F.count(F.lit(1)).alias("played"))


def win_tables(games: DataFrame) -> DataFrame:
    """(team, played, won): games count ties, wins do not."""
    return appearances(games).groupBy("team").agg(F.count(F.lit(1)).alias("played"), F.sum(F.when(F.col("pf") > F.col("pa"), 1).otherwise(0)).cast("long").alias("won"))


def points(roster: DataFrame, games: DataFrame) -> DataFrame:
    """(team, level1, level2, played, points) of every roster team.

    Wins are first counted by (winner, loser), so a pair that met often is one
    row; level 1 is then a join and a sum, and level 2 the same over level 1.
    Opponents outside the roster count as games and are worth nothing.
    """
    beaten = wins(games).groupBy("team", "opp").agg(F.count(F.lit(1)).alias("times"))
    value = roster.select(F.col("team").alias("opp"), division_value(F.col("division")).alias("value"))
    level1 = roster.select("team").join(beaten.join(value, "opp").groupBy("team").agg(F.sum(F.col("times") * F.col("value")).alias("level1")), "team", "left").select("team", F.coalesce("level1", F.lit(0.0)).alias("level1"))
    level2 = beaten.join(level1.select(F.col("team").alias("opp"), "level1"), "opp").groupBy("team").agg(F.sum(F.col("times") * F.col("level1")).alias("level2"))
    joined = level1.join(level2, "team", "left").join(games_played(games), "team", "left")
    total = F.col("level1") + F.coalesce("level2", F.lit(0.0))
    return joined.select("team", "level1", F.coalesce("level2", F.lit(0.0)).alias("level2"), F.coalesce("played", F.lit(0).cast("long")).alias("played"), F.when(F.col("played") > 0, total / F.col("played")).otherwise(0.0).alias("points"))


def qualifiers(roster: DataFrame, scored: DataFrame, per_region: int = PER_REGION) -> DataFrame:
    """(region, seed, team, points): the first of each region, ties by team."""
    w = Window.partitionBy("region").orderBy(F.desc("points"), "team")
    ranked = roster.filter("in_league and region is not null").select("team", "region").join(scored.select("team", "points"), "team").withColumn("seed", F.row_number().over(w))
    return ranked.filter(F.col("seed") <= per_region).select("region", "seed", "team", safe_round(F.col("points"), 3).alias("points"))


def leans_outside(roster: DataFrame, games: DataFrame) -> DataFrame:
    """(team): roster teams with a win, or a beaten team with a win, over a team outside the league."""
    beaten = wins(games).distinct()
    outside = roster.filter("not in_league").select(F.col("team").alias("opp"))
    direct = beaten.join(outside, "opp", "left_semi").select("team").distinct()
    second = beaten.join(direct.select(F.col("team").alias("opp")), "opp", "left_semi").select("team")
    return direct.union(second).distinct().join(roster.select("team"), "team", "left_semi")


def validate(roster: DataFrame, games: DataFrame, published: DataFrame) -> DataFrame:
    """One row: comparable teams, exact matches (within 0.005), exact share, largest and mean absolute error against (team, value)."""
    rows = points(roster, games).join(published, "team").join(roster.filter("in_league").select("team"), "team", "left_semi").join(leans_outside(roster, games), "team", "left_anti").withColumn("err", F.abs(F.col("points") - F.col("value")))
    return rows.agg(
        F.count(F.lit(1)).alias("comparable"),
        F.count_if(F.col("err") < 0.005).alias("exact"),
        safe_round(F.avg((F.col("err") < 0.005).cast("double")), 3).alias("exact_share"),
        safe_round(F.coalesce(F.max("err"), F.lit(0.0)), 3).alias("max_err"),
        safe_round(F.avg("err"), 3).alias("mean_err"),
    )
