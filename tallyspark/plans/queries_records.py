"""Queries on game tables: records, ranks, qualifiers, integrity, dates and conservation checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import qualifier, records as rec
from . import arena
from .arena import ARENA_SQL, LAST_REGULAR_WEEK, SEASON
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()
WITH = f"with {ARENA_SQL}"
SIDES = "sides as (select season, wk, game_id, neutral, home as team, away as opp, hs as pf, aw as pa, 0 as seq from games union all select season, wk, game_id, neutral, away, home, aw, hs, 1 from games)"
R3 = lambda x: f"round({x} + 1e-9, 3) + 0.0"
R2 = lambda x: f"round({x} + 1e-9, 2) + 0.0"


def season(spark: SparkSession, sf: str) -> DataFrame:
    return arena.dense_games(spark, sf).filter(F.col("season") == SEASON)


def regular(spark: SparkSession, sf: str) -> DataFrame:
    return qualifier.regular(season(spark, sf))


@query(f"{WITH} select season, wk, count(*) as games, cast(sum(hs) as bigint) as home_points, cast(sum(aw) as bigint) as away_points, count_if(neutral) as on_neutral, count_if(hs = aw) as ties from games group by season, wk")
def scan_games(spark, sf):
    return arena.dense_games(spark, sf).groupBy("season", "wk").agg(F.count(F.lit(1)).alias("games"), F.sum(F.col("hs").cast("long")).alias("home_points"), F.sum(F.col("aw").cast("long")).alias("away_points"), F.count_if("neutral").alias("on_neutral"), F.count_if(F.col("hs") == F.col("aw")).alias("ties"))


@query(f"{WITH} select name, count(*) as slots, string_agg(school_id || '/' || coalesce(division, '-') || '/' || region, ';' order by school_id) as members from roster group by name")
def scan_roster(spark, sf):
    row = F.concat_ws("/", "school_id", F.coalesce("division", F.lit("-")), F.col("region").cast("string"))
    return arena.dense_roster(spark, sf).groupBy("name").agg(F.count(F.lit(1)).alias("slots"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("school_id", row.alias("row")))), lambda s: s["row"]), ";").alias("members"))


@query(f"{WITH}, {SIDES} select season, game_id, seq, team, opp, cast(case when pf > pa then 1.0 when pf < pa then 0.0 else 0.5 end as double) as outcome from sides where season = {SEASON}")
def appearances(spark, sf):
    return rec.appearances(season(spark, sf)).select("season", "game_id", "seq", "team", "opp", "outcome")


@query(f"{WITH}, {SIDES} select season, team, count(*) as games, count_if(pf > pa) as w, count_if(pf < pa) as l, count_if(pf = pa) as t, cast(sum(pf - pa) as bigint) as pd from sides group by season, team")
def records(spark, sf):
    return rec.records(arena.dense_games(spark, sf))


@query(f"{WITH}, {SIDES} select season, wk, team, count(*) as n from sides group by season, wk, team having count(*) > 1")
def integrity(spark, sf):
    return rec.integrity(arena.dense_games(spark, sf))


@query(f"{WITH}, {SIDES}, seen as (select distinct name from sides join roster using (team)), slots as (select name, count(*) as slots from roster group by name) select coalesce(s.name, r.name) as name, s.name is not null as in_games, r.name is not null as in_roster, coalesce(slots, 0) as slots from seen s full outer join slots r on s.name = r.name")
def name_universe(spark, sf):
    roster = arena.dense_roster(spark, sf)
    return rec.name_universe(arena.dense_games(spark, sf), roster, roster)


@query(f"{WITH}, {SIDES} select name, max(n) as most from (select name, season, wk, count(*) as n from sides join roster using (team) group by name, season, wk) group by name")
def simultaneous(spark, sf):
    return rec.simultaneous(rec.appearances(arena.dense_games(spark, sf)).join(arena.dense_roster(spark, sf).select("team", "name"), "team"))


POINTS = "case division when 'I' then 6.5 when 'II' then 6.0 when 'III' then 5.5 when 'IV' then 5.0 when 'V' then 4.5 when 'VI' then 4.0 when 'VII' then 3.5 else 6.0 end"
QUALIFIER_SQL = f"""{SIDES}, regular as (select * from sides where season = {SEASON} and wk <= {LAST_REGULAR_WEEK}), wins as (select team, opp from regular where pf > pa),
val as (select team, cast({POINTS} as double) as value from roster), n as (select team, count(*) as played from regular group by team),
l1 as (select roster.team, coalesce(sum(value), 0.0) as level1 from roster left join wins on wins.team = roster.team left join val on val.team = wins.opp group by roster.team),
l2 as (select wins.team, sum(level1) as level2 from wins join l1 on l1.team = wins.opp group by wins.team),
pts as (select l1.team, level1, coalesce(level2, 0.0) as level2, coalesce(played, 0) as played, case when played > 0 then (level1 + coalesce(level2, 0.0)) / played else 0.0 end as points from l1 left join l2 using (team) left join n using (team)),
quals as (select region, seed, team, points from (select region, team, points, row_number() over (partition by region order by points desc, team) as seed from roster join pts using (team) where in_league and region is not null) where seed <= 12)"""


@query(f"{WITH} select team, division, cast({POINTS} as double) as value from roster")
def division_value(spark, sf):
    return arena.dense_roster(spark, sf).select("team", "division", qualifier.division_value(F.col("division")).alias("value"))


@query(f"{WITH}, {QUALIFIER_SQL} select team, count(*) as played, count_if(pf > pa) as won from regular group by team")
def win_tables(spark, sf):
    return qualifier.win_tables(regular(spark, sf))


@query(f"{WITH}, {QUALIFIER_SQL} select team, level1, level2, played, {R3('points')} as points from pts")
def qualifier_points(spark, sf):
    return qualifier.points(arena.dense_roster(spark, sf), regular(spark, sf)).withColumn("points", arena.safe_round(F.col("points"), 3))


@query(f"{WITH}, {QUALIFIER_SQL} select region, seed, team, {R3('points')} as points from quals")
def qualifiers(spark, sf):
    roster = arena.dense_roster(spark, sf)
    return qualifier.qualifiers(roster, qualifier.points(roster, regular(spark, sf)))


OUTSIDE_SQL = "beat as (select distinct team, opp from wins), direct as (select distinct beat.team from beat join roster o on o.team = beat.opp and not o.in_league), lean as (select team from direct union select beat.team from beat join direct on direct.team = beat.opp)"
EARLY_SQL = QUALIFIER_SQL.replace(f"wk <= {LAST_REGULAR_WEEK}", "wk <= 2")


@query(f"{WITH}, {EARLY_SQL}, {OUTSIDE_SQL} select team from lean where team in (select team from roster)")
def qualifier_approximate(spark, sf):
    return qualifier.leans_outside(arena.dense_roster(spark, sf), season(spark, sf).filter("wk <= 2"))


@query(f"{WITH}, {EARLY_SQL}, {OUTSIDE_SQL}, err as (select abs(points - (round(points * 3) / 3)) as err from pts join roster using (team) where in_league and team not in (select team from lean)) select count(*) as comparable, count_if(err < 0.005) as exact, {R3('avg(cast(err < 0.005 as double))')} as exact_share, {R3('cast(coalesce(max(err), 0) as double)')} as max_err, {R3('avg(err)')} as mean_err from err")
def qualifier_validate(spark, sf):
    """Against the points to the nearest third, as a published column of another make would be."""
    roster, games = arena.dense_roster(spark, sf), season(spark, sf).filter("wk <= 2")
    published = qualifier.points(roster, games).select("team", (F.round(F.col("points") * 3) / 3).alias("value"))
    return qualifier.validate(roster, games, published)


@query(f"{WITH} select cast(r as int) as region, (['I','II','III','IV','V','VI','VII'])[(r - 1) // 4 + 1] as division from range(1, 29) t(r)")
def region_division(spark, sf):
    return spark.range(1, 29).select(F.col("id").cast("int").alias("region"), F.element_at(F.array(*map(F.lit, arena.DIVISIONS)), (F.floor((F.col("id") - 1) / 4) + 1).cast("int")).alias("division"))
