"""Checks of tables and of what is published: each gives rows of (severity, rule, n), nothing wrong being n = 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import appearances


def overdue(fixtures: DataFrame, today: Column) -> DataFrame:
    """Fixtures with a date before today."""
    return fixtures.filter(F.col("date") < today)


def week_coverage(fixtures: DataFrame, results: DataFrame, today: Column) -> DataFrame:
    """(wk, overdue, captured, fails) of weeks with overdue fixtures; a week fails with 20 or more missing that are over half of all."""
    late = overdue(fixtures, today).groupBy("wk").agg(F.count(F.lit(1)).alias("overdue"))
    got = results.groupBy("wk").agg(F.count(F.lit(1)).alias("captured"))
    rows = late.join(got, "wk", "left").select("wk", "overdue", F.coalesce("captured", F.lit(0).cast("long")).alias("captured"))
    return rows.withColumn("fails", (F.col("overdue") >= 20) & (F.col("overdue") > 0.5 * (F.col("overdue") + F.col("captured"))))


def week_spans(results: DataFrame) -> DataFrame:
    return results.groupBy("wk").agg(F.min("date").alias("first"), F.max("date").alias("last"))


def weeks_out_of_order(spans: DataFrame) -> DataFrame:
    """(wk): weeks that end on or after the first day of the next."""
    after = spans.select((F.col("wk") - 1).alias("wk"), F.col("first").alias("next"))
    return spans.join(after, "wk").filter("last >= next").select("wk")


def double_booked(*tables: DataFrame) -> DataFrame:
    """(season, wk, team, n): teams with more than one game or fixture in a week."""
    sides = [t.select("season", "wk", F.explode(F.array("home", "away")).alias("team")) for t in tables]
    return reduce(DataFrame.unionByName, sides).groupBy("season", "wk", "team").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def season_length(games: DataFrame, fixtures: DataFrame, most: int = 16) -> DataFrame:
    """(team, n, too_many): games and fixtures of each team."""
    both = games.select("home", "away").unionByName(fixtures.select("home", "away"))
    return both.select(F.explode(F.array("home", "away")).alias("team")).groupBy("team").agg(F.count(F.lit(1)).alias("n")).withColumn("too_many", F.col("n") > most)


def no_games(roster: DataFrame, games: DataFrame) -> DataFrame:
    """(team): league teams without a game."""
    return roster.filter("in_league").select("team").join(appearances(games).select("team").distinct(), "team", "left_anti")


def record_sums(record: DataFrame) -> DataFrame:
    return record.filter("w + l + t <> games").select("team")


def rating_sanity(ratings: DataFrame, reach: float = 80.0, centre: float = 0.5) -> DataFrame:
    """One row: teams, ratings that are no number or out of reach, and whether they are centred."""
    return ratings.filter("team <> -1").agg(F.count(F.lit(1)).alias("teams"), F.count_if(F.isnan("rating") | F.col("rating").isNull()).alias("not_finite"), F.count_if(F.abs("rating") > reach).alias("out_of_reach"), (F.abs(F.avg("rating")) < centre).alias("centred"))


def rank_gaps(ranks: DataFrame) -> DataFrame:
    """One row: whether the overall ranks are 1 to N without gaps and follow the rating.

    Each rank is joined with the one before it, so no task sorts all ranks.
    """
    before = ranks.select((F.col("overall") + 1).alias("overall"), F.col("rating").alias("above"))
    rows = ranks.join(before, "overall", "left")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.max("overall").alias("last"), F.count_distinct("overall").alias("ranks"), F.count_if(F.col("rating") > F.col("above")).alias("out_of_order"))


def forecast_rows(predicted: DataFrame) -> DataFrame:
    """One row of counts: probabilities at 0 or 1, signs that disagree, scores that drift from the margin, implausible scores."""
    from .forecast import DRIFT, IMPLAUSIBLE

    return predicted.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("p") <= 0) | (F.col("p") >= 1)).alias("certain"),
        F.count_if((F.col("p") > 0.5) & (F.col("shown") < 0) | (F.col("p") < 0.5) & (F.col("shown") > 0)).alias("signs"),
        F.count_if(F.abs((F.col("h") - F.col("a")) - F.col("shown")) > DRIFT).alias("drifts"),
        F.count_if(F.col("h").isin(*IMPLAUSIBLE) | F.col("a").isin(*IMPLAUSIBLE)).alias("implausible"),
    )


def scale_swap(predicted: DataFrame, margin_scale: float) -> DataFrame:
    """One row: the largest distance of a published probability from the one that the shown margin, unscaled again, gives."""
    from ..functions.scales import win_probability

    p = win_probability(F.col("shown") / margin_scale, F.col("behind").cast("double"), F.lit(False))
    return predicted.agg(F.max(F.abs(p - F.col("p"))).alias("worst"), F.count_if(F.abs(p - F.col("p")) > 0.01).alias("swapped"))


def squash_invariants(margins: DataFrame, scale: float, cap: float) -> DataFrame:
    """One row: half at 0, symmetric, rising, flat beyond the cap, over the margins (m)."""
    from ..functions.scales import squash

    rows = margins.select("m", squash(F.col("m").cast("double"), scale, cap).alias("y"), squash(-F.col("m").cast("double"), scale, cap).alias("back"), squash(F.col("m").cast("double") + 1, scale, cap).alias("next"))
    return rows.agg(F.max(F.when(F.col("m") == 0, F.abs(F.col("y") - 0.5) < 1e-12)).alias("half_at_zero"), (F.max(F.abs(F.col("y") + F.col("back") - 1)) < 1e-12).alias("symmetric"), F.min(F.col("next") >= F.col("y")).alias("rising"), F.max(F.when(F.col("m") > cap, F.abs(F.col("y") - squash(F.lit(cap), scale, cap)) < 1e-12)).alias("capped"))


def report(rows: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """(severity, rule, n): how many rows each rule's table of offenders has."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), "n") for severity, rule, df in rows])


def calibration_nested(document: Column) -> Column:
    """Whether a calibration document is nested by kind: the values of its values are the bins themselves.

    A flat one, of bins alone, has numbers there; a document that is none fails too.
    """
    values = lambda c: F.map_values(F.from_json(c, "map<string,string>"))
    table = lambda c: F.coalesce(c.startswith("{"), F.lit(False))
    return F.coalesce(F.forall(values(document), lambda kind: table(kind) & F.forall(values(kind), table)), F.lit(False))
