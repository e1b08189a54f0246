"""Forecasts of fixtures: who stands behind a name, margin, probability, total and a plausible score; and expected records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scales import CONFIG, Config, win_probability
from ..plans.arena import safe_round
from .lineage import Rounds
from .records import appearances

#: Scores that a team hardly ever ends on, and the order in which totals near the expected one are tried (fixed values).
IMPLAUSIBLE = (1, 2, 4, 5, 11)
TOTALS = (0, 1, -1, 2, -2, 3, -3, 4, -4, 5, -5, 6, -6)
DRIFT = 1.1


def scoring_profile(games: DataFrame, shrink: float = 4.0) -> DataFrame:
    """(team, played, offense, defense, league_ppg): points for and against per game beside the league's, shrunk by games played."""
    sides = appearances(games)
    team = sides.groupBy("team").agg(F.count(F.lit(1)).alias("played"), F.avg("pf").alias("pf"), F.avg("pa").alias("pa"))
    league = sides.agg(F.avg("pf").alias("league_ppg"))
    weight = F.col("played") / (F.col("played") + shrink)
    # the league's mean is one row
    return team.join(F.broadcast(league)).select("team", "played", (weight * (F.col("pf") - F.col("league_ppg"))).alias("offense"), (weight * (F.col("pa") - F.col("league_ppg"))).alias("defense"), "league_ppg")


def expected_total(league_ppg: Column, *parts: Column) -> Column:
    total = 2 * league_ppg
    for p in parts:
        total = total + F.coalesce(p, F.lit(0.0))
    return F.greatest(F.lit(10.0), F.least(F.lit(100.0), total))


def projected_score(margin: Column, total: Column) -> Column:
    """(h, a): the likeliest whole scores with this margin near this total.

    Of the totals tried, the split with the smallest drift from the margin
    wins, then that nearest the total, then the first tried; splits with an
    implausible score, too much drift, or without the stated favourite ahead
    are out.  If none is left, the plain split stands.
    """
    base = F.greatest(total, F.abs(margin))

    def split(t: Column) -> tuple[Column, Column]:
        return F.rint(F.greatest(F.lit(0.0), (t + margin) / 2)).cast("int"), F.rint(F.greatest(F.lit(0.0), (t - margin) / 2)).cast("int")

    def candidate(step: Column, order: Column) -> Column:
        h, a = split(base + step)
        drift = F.abs((h - a) - margin)
        favoured = (F.abs(margin) < 0.5) | ((margin > 0) & (h > a)) | ((margin < 0) & (h < a))
        fits = ~h.isin(*IMPLAUSIBLE) & ~a.isin(*IMPLAUSIBLE) & (drift <= DRIFT) & favoured
        return F.when(fits, F.struct(F.round(drift, 6).alias("drift"), F.abs(step).alias("off"), order.alias("order"), h.alias("h"), a.alias("a")))

    tried = F.array_compact(F.transform(F.array(*map(F.lit, TOTALS)), candidate))
    h, a = split(base)
    best = F.array_min(tried)
    return F.struct(F.coalesce(best["h"], h).alias("h"), F.coalesce(best["a"], a).alias("a"))


def side_status(names: DataFrame, roster: DataFrame) -> DataFrame:
    """(name, candidates, team, status): who a fixture's name means.

    One candidate is rated; of several, the only one in the league is assumed,
    else the name is ambiguous; without a candidate a stand-in is used.
    """
    found = roster.groupBy("name").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("in_league").alias("league"), F.min("team").alias("any_team"), F.min(F.when(F.col("in_league"), F.col("team"))).alias("league_team"))
    joined = names.select("name").distinct().join(found, "name", "left")
    status = F.when(F.col("candidates").isNull(), "stand-in").when(F.col("candidates") == 1, "rated").when(F.col("league") == 1, "assumed").otherwise("ambiguous")
    team = F.when(F.col("candidates") == 1, F.col("any_team")).when(F.col("league") == 1, F.col("league_team"))
    return joined.select("name", F.coalesce("candidates", F.lit(0).cast("long")).alias("candidates"), team.alias("team"), status.alias("status"))


def fixtures_in_league(fixtures: DataFrame, roster: DataFrame) -> DataFrame:
    """Fixtures with a league team on either side, as a union of two semi joins rather than one join on an OR."""
    league = roster.filter("in_league").select("team")
    home = fixtures.join(league.withColumnRenamed("team", "home"), "home", "left_semi")
    away = fixtures.join(league.withColumnRenamed("team", "home"), "home", "left_anti").join(league.withColumnRenamed("team", "away"), "away", "left_semi")
    return home.unionByName(away)


def predict(fixtures: DataFrame, ratings: DataFrame, played: DataFrame, profile: DataFrame, cfg: Config = CONFIG, stand_in: DataFrame | None = None) -> DataFrame:
    """Every fixture, with raw margin, shown margin, probability of a home win, projected scores and a status.

    Probability comes from the raw margin, the shown margin is the calibrated
    one, and the score is made from what is shown.  A side without a rating
    takes that of stand_in (one row with ``rating``), its probability is the
    flattest, and the status says so; without a stand-in such a fixture stays,
    with the reason as its status and nothing forecast.
    """
    hfa = ratings.filter(F.col("team") == -1).select(F.col("rating").alias("hfa"))
    spare = (stand_in.select(F.col("rating").alias("spare")) if stand_in is not None else hfa.select(F.lit(None).cast("double").alias("spare")))
    n = played.select("team", "games")
    off = profile.select("team", "offense", "defense", "league_ppg")
    league = off.agg(F.max("league_ppg").alias("league_ppg"))
    side = lambda c, r: ratings.select(F.col("team").alias(c), F.col("rating").alias(r))
    rows = (
        fixtures.join(side("home", "rh"), "home", "left")
        .join(side("away", "ra"), "away", "left")
        .join(n.select(F.col("team").alias("home"), F.col("games").alias("gh")), "home", "left")
        .join(n.select(F.col("team").alias("away"), F.col("games").alias("ga")), "away", "left")
        .join(off.select(F.col("team").alias("home"), F.col("offense").alias("oh"), F.col("defense").alias("dh")), "home", "left")
        .join(off.select(F.col("team").alias("away"), F.col("offense").alias("oa"), F.col("defense").alias("da")), "away", "left")
        # three tables of one row
        .join(F.broadcast(hfa.join(F.broadcast(spare)).join(F.broadcast(league))))
    )
    stood = F.col("rh").isNull() | F.col("ra").isNull()
    margin = F.coalesce("rh", "spare") - F.coalesce("ra", "spare") + F.when(F.col("neutral"), 0.0).otherwise(F.col("hfa"))
    behind = F.least(F.coalesce("gh", F.lit(0)), F.coalesce("ga", F.lit(0)))
    status = F.when(~stood, "rated").when(F.col("margin").isNull(), "opponent has no rating yet").otherwise("stand-in")
    rows = rows.withColumns({"stood": stood, "margin": margin, "behind": behind})
    rows = rows.withColumns({"shown": safe_round(F.col("margin") * cfg.margin_scale, 1), "p": safe_round(win_probability(F.col("margin"), F.col("behind").cast("double"), F.col("stood"), cfg), 3), "total": expected_total(F.col("league_ppg"), F.col("oh"), F.col("oa"), F.col("dh"), F.col("da")), "status": status})
    score = F.when(F.col("shown").isNotNull(), projected_score(F.col("shown"), F.col("total")))
    return rows.withColumn("score", score).select(*fixtures.columns, "margin", "behind", "shown", "p", "total", "score.h", "score.a", "status")


def predict_named(fixtures: DataFrame, roster: DataFrame, ratings: DataFrame, played: DataFrame, profile: DataFrame, cfg: Config = CONFIG, stand_in: DataFrame | None = None) -> DataFrame:
    """As predict(), for fixtures that name their sides (home_name, away_name): home and away are the teams the names mean.

    A name means a rated team of the roster by the rule of side_status().  A
    side that several schools may be leaves the fixture without a forecast, its
    status ``ambiguous``; a name that no rated team has stands for the stand-in, or is
    ``unknown`` without one; a side that was assumed is said to be.
    """
    rated = roster.join(ratings.select("team"), "team", "left_semi")
    names = fixtures.select(F.explode(F.array("home_name", "away_name")).alias("name"))
    means = side_status(names, rated)
    at = lambda c: means.select(F.col("name").alias(f"{c}_name"), F.col("team").alias(c), F.col("status").alias(f"{c}_status"))
    sided = fixtures.join(at("home"), "home_name").join(at("away"), "away_name")
    rows = predict(sided, ratings, played, profile, cfg, stand_in)
    either = lambda s: (F.col("home_status") == s) | (F.col("away_status") == s)
    status = F.when(either("ambiguous"), "ambiguous").when(either("stand-in"), F.when(F.col("margin").isNull(), "unknown").otherwise("stand-in")).when(either("assumed"), "assumed").otherwise("rated")
    known = ~either("ambiguous")
    return rows.withColumns({**{c: F.when(known, F.col(c)) for c in ("margin", "shown", "p", "total", "h", "a")}, "status": status}).drop("home_status", "away_status")


def project_records(record: DataFrame, predicted: DataFrame) -> DataFrame:
    """(team, wins, losses): won so far plus the probabilities to come; losses are the rest of all games."""
    side = lambda t, p: F.struct(F.col(t).alias("team"), p.alias("p"))
    to_come = predicted.select(F.explode(F.array(side("home", F.col("p")), side("away", 1 - F.col("p")))).alias("s")).groupBy("s.team").agg(F.sum("s.p").alias("more"), F.count(F.lit(1)).alias("left"))
    joined = record.select("team", "w", "games", "t").join(to_come, "team", "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    wins = safe_round(zero("w") + F.coalesce("more", F.lit(0.0)), 1)
    return joined.select("team", wins.alias("wins"), safe_round(zero("games") - zero("t") + zero("left") - wins, 1).alias("losses"))


def compact(predicted: DataFrame, index: DataFrame) -> DataFrame:
    """(game_id, row): a short JSON for each fixture, teams by their place in the payload, fields that are null or 0 left out."""
    i = index.select("team", "i")
    rows = predicted.drop("h", "a").join(i.select(F.col("team").alias("home"), F.col("i").alias("h")), "home", "left").join(i.select(F.col("team").alias("away"), F.col("i").alias("a")), "away", "left")
    fields = F.struct(F.col("wk").alias("w"), "h", F.when(F.col("h").isNull(), F.col("home")).alias("hn"), "a", F.when(F.col("a").isNull(), F.col("away")).alias("an"), F.when(F.col("neutral"), 1).alias("n"), F.when(F.col("shown") != 0, F.format_number("shown", 1)).alias("m"))
    return rows.select("game_id", F.to_json(fields).alias("row"))


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node that each node of (a, b) reaches.

    Each round every node takes the smallest label near it, every label the
    smallest that any of its nodes saw, and then each node its label's label, so
    paths halve and whole groups move at once.  Edges are written once, labels
    in each round; both sides of a join on labels are written tables, so Spark can split the rows of
    a label that most nodes share.
    """
    tables = Rounds(edges.sparkSession)
    both = tables.write("both", edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).filter("u <> v").distinct())
    labels = tables.write("labels", edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("near"))
        seen = tables.write("seen", labels.join(near, labels["node"] == near["u"], "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("near")))
        # what one node of a group saw holds for the whole group; the label's own row takes it too
        moved = tables.write("moved", seen.groupBy("root").agg(F.min("near").alias("best")))
        stepped = tables.write("stepped", seen.join(moved, "root").select("node", F.col("best").alias("root"), F.col("root").alias("was")))
        far = stepped.filter("node <> root").select(F.col("node").alias("root"), F.col("root").alias("far"))
        labels = tables.write("labels", stepped.join(far, "root", "left").select("node", F.coalesce("far", "root").alias("root"), "was"))
        if labels.filter("root <> was").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")
    raise RuntimeError(f"labels did not settle in {rounds} rounds")


def connectivity(labels: DataFrame, games: DataFrame) -> DataFrame:
    """One row: teams, components, the largest, mean games a team, and how far ratings can be compared.

    None under two games a team or where the largest component has under a
    quarter of the teams; low under 60 percent of them, medium under 90
    percent or four games a team, else high.
    """
    sizes = labels.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.sum("n").alias("teams"), F.count(F.lit(1)).alias("components"), F.max("n").alias("largest")).join(F.broadcast(games.agg(F.count(F.lit(1)).alias("games"))))
    share, mean = F.col("largest") / F.col("teams"), 2 * F.col("games") / F.col("teams")
    label = F.when((mean < 2) | (share < 0.25), "none").when(share < 0.6, "low").when((share < 0.9) | (mean < 4), "medium").otherwise("high")
    return row.select("teams", "components", "largest", safe_round(mean, 2).alias("mean_games"), label.alias("label"))
