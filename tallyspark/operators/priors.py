"""Priors: what last season says, by team and by division."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.arena import safe_round
from .records import appearances

CLIP, CARRY, DIVISION_WEIGHT, LEAST_TEAMS = 14.0, 0.6, 1.0, 10
#: Games without which a season says nothing of a team.
LEAST_GAMES = 4


def stable_key(school_id: Column, name: Column) -> Column:
    """What names a school in every season: its id, or its name where it has none."""
    return F.coalesce(F.nullif(F.trim(school_id), F.lit("")), name)


def full_season(rated: DataFrame, games: DataFrame, roster: DataFrame, least: int = LEAST_GAMES) -> DataFrame:
    """(team, rating) of a season's fit for what may be said of the next: league teams of at least ``least`` games; the advantage is no team."""
    often = appearances(games).groupBy("team").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("team")
    return rated.join(often, "team", "left_semi").join(roster.filter("in_league").select("team"), "team", "left_semi").select("team", "rating")


def division_effects(ratings: DataFrame, roster: DataFrame, least: int = LEAST_TEAMS) -> DataFrame:
    """(division, effect): mean rating of a division with enough teams, about the plain mean of such divisions."""
    means = ratings.join(roster.filter("in_league").select("team", "division"), "team").groupBy("division").agg(F.avg("rating").alias("mean"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    # seven divisions at most
    return means.join(F.broadcast(means.agg(F.avg("mean").alias("all")))).select("division", (F.col("mean") - F.col("all")).alias("effect"))


def build_prior(ratings: DataFrame, roster: DataFrame, carry: float = CARRY, clip: float = CLIP) -> DataFrame:
    """(school_id, dev): a team's distance from the mean and its division's effect, carried over and clipped."""
    league = ratings.join(roster.filter("in_league").select("team", "school_id", "division"), "team")
    base = division_effects(ratings, roster)
    dev = (F.col("rating") - F.col("mean") - F.coalesce("effect", F.lit(0.0))) * carry
    return league.join(F.broadcast(league.agg(F.avg("rating").alias("mean")))).join(base, "division", "left").select("school_id", safe_round(F.greatest(F.lit(-clip), F.least(F.lit(clip), dev)), 3).alias("dev"))


def apply_prior(roster: DataFrame, by_id: DataFrame, by_name: DataFrame) -> DataFrame:
    """(team, dev): by school id, else by name, else 0."""
    return roster.select("team", "school_id", "name").join(by_id.select("school_id", F.col("dev").alias("d1")), "school_id", "left").join(by_name.select("name", F.col("dev").alias("d2")), "name", "left").select("team", F.coalesce("d1", "d2", F.lit(0.0)).alias("dev"))


def compose(roster: DataFrame, effects: DataFrame, devs: DataFrame, weight: float = DIVISION_WEIGHT) -> DataFrame:
    """(team, prior) of league teams: division effect times its weight, plus the team's own; centred on 0."""
    rows = roster.filter("in_league").select("team", "division").join(effects, "division", "left").join(devs, "team", "left").select("team", (F.coalesce("effect", F.lit(0.0)) * weight + F.coalesce("dev", F.lit(0.0))).alias("prior"))
    return rows.join(F.broadcast(rows.agg(F.avg("prior").alias("mean")))).select("team", safe_round(F.col("prior") - F.col("mean"), 3).alias("prior"))


def stand_in(ratings: DataFrame, roster: DataFrame) -> DataFrame:
    """One row: the median rating of rated league teams, for opponents that nobody rates."""
    return ratings.join(roster.filter("in_league").select("team"), "team").agg(safe_round(F.median("rating"), 2).alias("rating"), F.count(F.lit(1)).alias("teams"))


def starting_points(ratings: DataFrame, before: DataFrame, roster: DataFrame, carry: float = CARRY, weight: float = DIVISION_WEIGHT, clip: float = CLIP) -> DataFrame:
    """(team, prior) of the roster's league teams, centred: this season's division effect, and last season's distance above the effect of last season's division, carried and clipped.

    ratings are full_season()'s, by the teams of ``before``, last season's
    roster.  A school is found again by its stable key, so it keeps what it
    earned though its team number, its name or its division is another; of two
    schools with one key neither is followed.
    """
    effects = division_effects(ratings, before)
    keyed = lambda df: df.filter("in_league").withColumn("key", stable_key(F.col("school_id"), F.col("name")))
    once = lambda df: df.join(df.groupBy("key").agg(F.count(F.lit(1)).alias("__n")).filter("__n = 1").select("key"), "key", "left_semi")
    base = F.coalesce("effect", F.lit(0.0))
    mean = ratings.agg(F.avg("rating").alias("mean"))
    earned = once(keyed(before).join(ratings, "team")).join(effects, "division", "left").join(F.broadcast(mean))
    dev = earned.select("key", F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col("rating") - F.col("mean") - base) * carry)).alias("dev"))
    now = keyed(roster)
    followed = once(now).join(dev, "key").select("team", "dev")
    rows = now.join(effects, "division", "left").join(followed, "team", "left").select("team", (base * weight + F.coalesce("dev", F.lit(0.0))).alias("prior"))
    return rows.join(F.broadcast(rows.agg(F.avg("prior").alias("centre")))).select("team", (F.col("prior") - F.col("centre")).alias("prior"))
