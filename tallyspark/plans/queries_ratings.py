"""Queries on ratings: the three fits, what follows from them, and priors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scales
from ..operators import ratings, records as rec
from ..operators.lineage import ensure_cut  # noqa: F401
from . import arena
from .arena import ARENA_SQL, SPARSE_SQL, safe_round
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()
WITH = f"with recursive {ARENA_SQL}"
R2 = lambda x: f"round({x} + 1e-9, 2) + 0.0"
R3 = lambda x: f"round({x} + 1e-9, 3) + 0.0"


def fit_sql(games: str, y: str, name: str = "fit", scale: float = 9.0, prior_games: float = 0.5, centre: str = "0.0", rounds: int = 100) -> str:
    """Damped, recentred diagonal Newton rounds over (team, th); team -1 is the home advantage. centre: an expression over team, in logits."""
    return f"""{name}_g as (select home, away, neutral, {y} as y from {games}),
{name}_ids as (select distinct unnest([home, away]) as team from {name}_g),
{name}_t(k, team, th) as (
  select 0, team, cast({centre} as double) from {name}_ids union all select 0, -1, cast(0.0 as double)
  union all
  select k + 1, team, case when team = -1 then th else th - avg(th) filter (where team <> -1) over () end from (
    select k, team, th - 0.7 * (gr + pen * (th - cen)) / (he + greatest(pen, 1e-12)) as th from (
      select any_value(t.k) as k, t.team, any_value(t.th) as th, case when t.team = -1 then 0.0 else {0.25 * prior_games} end as pen,
             any_value(case when t.team = -1 then 0.0 else {centre.replace('team', 't.team') if centre != '0.0' else '0.0'} end) as cen, coalesce(sum(s.gr), 0) as gr, coalesce(sum(s.he), 0) as he
      from {name}_t t left join (
        select e.team, sum(e.sg * (e.p - e.y)) as gr, sum(e.p * (1 - e.p)) as he from (
          select unnest([z.home, z.away, case when z.neutral then -2 else -1 end]) as team, unnest([1, -1, 1]) as sg, z.p, z.y from (
            select g.home, g.away, g.neutral, 1 / (1 + exp(-(a.th - b.th + case when g.neutral then 0 else f.th end))) as p, g.y
            from {name}_g g join {name}_t a on a.team = g.home join {name}_t b on b.team = g.away join {name}_t f on f.team = -1) z) e
        group by e.team) s on s.team = t.team
      where t.k < {rounds} group by t.team) u) w),
{name} as (select team, th * {scale} as rating from {name}_t where k = {rounds})"""


MARGIN = "1 / (1 + exp(-greatest(-49, least(49, hs - aw)) / 9.0))"
RESULT = "case when hs > aw then 1.0 when hs < aw then 0.0 else 0.5 end"
FIT = fit_sql("played", MARGIN)
RIDGE = """m as (select home, away, neutral, greatest(-49, least(49, hs - aw)) as y from played), m_ids as (select distinct unnest([home, away]) as team from m),
mt(k, team, th) as (select 0, team, cast(0.0 as double) from m_ids union all select 0, -1, cast(0.0 as double) union all
  select k + 1, team, case when team = -1 then th else th - avg(th) filter (where team <> -1) over () end from (
    select k, team, th - 0.7 * (gr + pen * th) / (he + greatest(pen, 1e-12)) as th from (
      select any_value(t.k) as k, t.team, any_value(t.th) as th, case when t.team = -1 then 0.0 else 0.5 end as pen, coalesce(sum(s.gr), 0) as gr, coalesce(sum(s.he), 0) as he
      from mt t left join (select e.team, sum(e.sg * e.r) as gr, count(*) as he from (
          select unnest([g.home, g.away, case when g.neutral then -2 else -1 end]) as team, unnest([1, -1, 1]) as sg, a.th - b.th + case when g.neutral then 0 else f.th end - g.y as r
          from m g join mt a on a.team = g.home join mt b on b.team = g.away join mt f on f.team = -1) e group by e.team) s on s.team = t.team
      where t.k < 150 group by t.team) u) w),
massey_t as (select team, th as rating from mt where k = 150)"""


def season_fit(spark, sf, kind="margin", **more):
    return ratings.fit(arena.played(arena.dense_games(spark, sf)), ["season"], kind=kind, **more).drop("season")


def rounded(df):
    return df.withColumn("rating", safe_round(F.col("rating"), 2))


@query(f"with {ARENA_SQL} select game_id, round(1 / (1 + exp(-greatest(-49, least(49, hs - aw)) / 9.0)) + 1e-9, 6) + 0.0 as y from played")
def squash(spark, sf):
    return arena.played(arena.dense_games(spark, sf)).select("game_id", safe_round(scales.squash(F.col("hs") - F.col("aw"), 9.0, 49.0), 6).alias("y"))


@query(f"with {ARENA_SQL} select game_id, col, val from (select game_id, unnest([home, away, -1]) as col, unnest([1, -1, 1]) as val, neutral from played) where not (col = -1 and neutral)")
def design_coo(spark, sf):
    return ratings.design(arena.played(arena.dense_games(spark, sf)))


@query(f"{WITH}, {FIT} select team, {R2('rating')} as rating from fit")
def bt_margin(spark, sf):
    return rounded(season_fit(spark, sf))


@query(f"{WITH}, {fit_sql('played', RESULT)} select team, {R2('rating')} as rating from fit")
def bt_binary(spark, sf):
    return rounded(season_fit(spark, sf, "binary"))


@query(f"{WITH}, {RIDGE} select team, {R2('rating')} as rating from massey_t")
def massey(spark, sf):
    return rounded(season_fit(spark, sf, "points"))


@query(f"{WITH}, {SPARSE_SQL}, early as (select * from sparse where season = {arena.SEASON} and wk <= {arena.PLAYED_TO}), {fit_sql('early', MARGIN, rounds=150)} select team, {R2('rating')} as rating from fit")
def bt_large_graph(spark, sf):
    """The sparse arena's fit: many teams with few games each, to convergence; above ratings.PAIRS pairs it goes by rounds of shuffles."""
    games = arena.sparse_games(spark, sf).filter((F.col("season") == arena.SEASON) & (F.col("wk") <= arena.PLAYED_TO))
    return rounded(ratings.fit(games, ["season"]).drop("season"))


@query(f"{WITH}, {FIT}, {fit_sql('played', RESULT, 'fitb')}, {RIDGE} select f.team, {R2('f.rating')} as bt_margin, {R2('b.rating')} as bt_binary, {R2('m.rating')} as massey from fit f join fitb b using (team) join massey_t m using (team)")
def rate(spark, sf):
    games = arena.played(arena.dense_games(spark, sf))
    return ratings.rate(games, ["season"]).select("team", *[safe_round(F.col(c), 2).alias(c) for c in ("bt_margin", "bt_binary", "massey")])


@query(f"{WITH}, level as (select home, away, true as neutral, hs, aw from played), {fit_sql('level', MARGIN)} select team, {R2('rating')} as rating from fit")
def fit_without_advantage(spark, sf):
    """The season as if all ground were neutral."""
    games = arena.played(arena.dense_games(spark, sf))
    return rounded(ratings.fit(games, ["season"], advantage=False).drop("season"))


@query(f"{WITH}, {FIT}, sides as (select home as team, away as opp from played union all select away, home from played) select s.team, {R2('coalesce(avg(rating), 0.0)')} as sos from sides s left join fit on fit.team = s.opp group by s.team")
def sos(spark, sf):
    return rec.strength_of_schedule(arena.played(arena.dense_games(spark, sf)), season_fit(spark, sf))


@query(f"""{WITH}, {FIT}, r as (select team, division, region, {R2('rating')} as rating from fit join roster using (team) where in_league)
select team, rating, row_number() over (order by rating desc, team) as overall, row_number() over (partition by division order by rating desc, team) as in_division, row_number() over (partition by region order by rating desc, team) as in_region from r""")
def ranks(spark, sf):
    games = arena.played(arena.dense_games(spark, sf))
    return rec.ranks(rounded(season_fit(spark, sf)), arena.dense_roster(spark, sf), rec.records(games))


PREDICT = "predicted as (select x.*, a.rating - b.rating + case when x.neutral then 0 else f.rating end as margin from fixtures x join fit a on a.team = x.home join fit b on b.team = x.away join fit f on f.team = -1)"


@query(f"{WITH}, {FIT}, {PREDICT} select game_id, home, away, {R2('margin')} as margin from predicted")
def predict_margin(spark, sf):
    found = ratings.predict_margin(arena.fixtures(arena.dense_games(spark, sf)), season_fit(spark, sf))
    return found.select("game_id", "home", "away", safe_round(F.col("margin"), 2).alias("margin"))


CURVE = lambda g, standin="false": f"case when {standin} then 20.0 when {g} < 1 then 9.0 else greatest(3.0, least(20.0, sqrt(19.6807 + 82.7213 / greatest({g}, 1)))) end"


@query(f"{WITH} select game_id, round({CURVE('(wk % 41)', 'neutral')} + 1e-9, 4) + 0.0 as scale from games")
def prob_scale(spark, sf):
    """The published curve for every game, its week standing for the games behind it and neutral ground for a stand-in."""
    return arena.dense_games(spark, sf).select("game_id", safe_round(scales.prob_scale((F.col("wk") % 41).cast("double"), F.col("neutral")), 4).alias("scale"))


@query(f"{WITH} select game_id, {R3(f'1 / (1 + exp(-(hs - aw) / ({CURVE("(wk % 17)")})))')} as p from games")
def win_probability(spark, sf):
    return arena.dense_games(spark, sf).select("game_id", safe_round(scales.win_probability((F.col("hs") - F.col("aw")).cast("double"), (F.col("wk") % 17).cast("double"), F.lit(False)), 3).alias("p"))
