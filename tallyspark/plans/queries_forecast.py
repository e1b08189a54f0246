"""Queries on priors, forecasts, the history log and its scores, and the schedule checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import forecast, priors, ratings, records as rec
from ..operators.lineage import cut
from . import arena, rendered
from .arena import ARENA_SQL, SPARSE_SQL, safe_round
from .queries_ratings import CURVE, FIT, MARGIN, ensure_cut, fit_sql, season_fit
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()
WITH = f"with recursive {ARENA_SQL}"
R = lambda x, n: f"round({x} + 1e-9, {n}) + 0.0"

SIDES = "psides as (select home as team, away as opp, hs as pf, aw as pa from played union all select away, home, aw, hs from played)"
PROFILE = f"{SIDES}, ppg as (select avg(pf) as league_ppg from psides), profile as (select team, count(*) as played, count(*) / (count(*) + 4.0) * (avg(pf) - any_value(league_ppg)) as offense, count(*) / (count(*) + 4.0) * (avg(pa) - any_value(league_ppg)) as defense, any_value(league_ppg) as league_ppg from psides, ppg group by team)"
#: A table (id, margin, total) named sc is split into scores named scored (id, h, a).
SCORE = """halves as (select id, margin, d, o, cast(round_even(greatest(0.0, (base + d + margin) / 2), 0) as int) as h, cast(round_even(greatest(0.0, (base + d - margin) / 2), 0) as int) as a
 from (select id, margin, greatest(total, abs(margin)) as base, unnest([0, 1, -1, 2, -2, 3, -3, 4, -4, 5, -5, 6, -6]) as d, unnest(range(13)) as o from sc)),
judged as (select *, h not in (1,2,4,5,11) and a not in (1,2,4,5,11) and abs((h - a) - margin) <= 1.1 and (abs(margin) < 0.5 or (margin > 0 and h > a) or (margin < 0 and h < a)) as fits, cast(round(abs((h - a) - margin) * 1e6) as bigint) * 10000 + abs(d) * 100 + o as place from halves),
scored as (select id, coalesce(arg_min(h, place) filter (where fits), max(h) filter (where o = 0)) as h, coalesce(arg_min(a, place) filter (where fits), max(a) filter (where o = 0)) as a from judged group by id)"""
PREDICTED = f"""{FIT}, {PROFILE}, spare as (select {R('median(rating)', 2)} as spare from fit join roster using (team) where in_league), raw as (select x.season, x.wk, x.game_id, x.home, x.away, x.neutral, a.rating is null or b.rating is null as stood, coalesce(a.rating, spare) - coalesce(b.rating, spare) + case when x.neutral then 0 else f.rating end as margin, least(coalesce(ph.played, 0), coalesce(pa.played, 0)) as behind,
  greatest(10.0, least(100.0, 2 * league_ppg.league_ppg + coalesce(ph.offense, 0) + coalesce(pa.offense, 0) + coalesce(ph.defense, 0) + coalesce(pa.defense, 0))) as total
  from fixtures x left join fit a on a.team = x.home left join fit b on b.team = x.away join fit f on f.team = -1 cross join spare cross join ppg league_ppg left join profile ph on ph.team = x.home left join profile pa on pa.team = x.away),
shown as (select *, {R('margin * 1.4708', 1)} as shown, {R(f'1 / (1 + exp(-margin / ({CURVE("behind", "stood")})))', 3)} as p, case when stood then 'stand-in' else 'rated' end as status from raw),
sc as (select game_id as id, shown as margin, total from shown), {SCORE}"""


def played(spark, sf):
    return arena.played(arena.dense_games(spark, sf))


def predicted(spark, sf):
    games, rated = played(spark, sf), cut(season_fit(spark, sf))
    spare = priors.stand_in(rated, arena.dense_roster(spark, sf))
    return forecast.predict(arena.fixtures(arena.dense_games(spark, sf)), rated, rec.records(games), forecast.scoring_profile(games), stand_in=spare)


@query(f"{WITH}, {PROFILE} select team, played, {R('offense', 3)} as offense, {R('defense', 3)} as defense, {R('league_ppg', 3)} as league_ppg from profile")
def scoring_profile(spark, sf):
    p = forecast.scoring_profile(played(spark, sf))
    return p.select("team", "played", *[safe_round(F.col(c), 3).alias(c) for c in ("offense", "defense", "league_ppg")])


@query(f"{WITH}, sc as (select distinct (hs - aw) * 1000 + hs + aw as id, cast(hs - aw as double) / 2 as margin, cast(hs + aw as double) as total from games), {SCORE} select id, h, a from scored")
def projected_score(spark, sf):
    """Scores for the halved margin and the total of every game that was played, each once."""
    m, t = F.col("hs") - F.col("aw"), F.col("hs") + F.col("aw")
    grid = arena.dense_games(spark, sf).select((m * 1000 + t).cast("bigint").alias("id"), (m / 2).alias("m"), t.cast("double").alias("t")).distinct()
    return grid.select("id", forecast.projected_score(F.col("m"), F.col("t")).alias("s")).select("id", "s.h", "s.a")


@query(f"{WITH}, {PREDICTED} select game_id, {R('margin', 2)} as margin, behind, shown, p, {R('total', 2)} as total, status from shown")
def predict_schedule(spark, sf):
    return predicted(spark, sf).select("game_id", safe_round(F.col("margin"), 2).alias("margin"), F.col("behind").cast("long").alias("behind"), "shown", "p", safe_round(F.col("total"), 2).alias("total"), "status")


#: The coming games by names; a name in seven is one that nobody has.
NAMED_SQL = f"""{PREDICTED}, asked as (select game_id, wk, neutral, case when game_id // 100 % 7 = 0 then 'Nobody' else h.name end as home_name, a.name as away_name from fixtures x join roster h on h.team = x.home join roster a on a.team = x.away),
cand as (select name, count(*) as n, count_if(in_league) as lg, min(team) as t, min(case when in_league then team end) as lt from roster where team in (select team from fit) group by name),
means as (select name, case when n = 1 then t when lg = 1 then lt end as team, case when n = 1 then 'rated' when lg = 1 then 'assumed' else 'ambiguous' end as status from cand),
nraw as (select q.*, h.team as home, a.team as away, coalesce(h.status, 'stand-in') as hs, coalesce(a.status, 'stand-in') as st, fh.rating is null or fa.rating is null as stood, coalesce(fh.rating, spare) - coalesce(fa.rating, spare) + case when q.neutral then 0 else f.rating end as margin, least(coalesce(ph.played, 0), coalesce(pa.played, 0)) as behind
 from asked q left join means h on h.name = home_name left join means a on a.name = away_name left join fit fh on fh.team = h.team left join fit fa on fa.team = a.team join fit f on f.team = -1 cross join spare left join profile ph on ph.team = h.team left join profile pa on pa.team = a.team),
named as (select *, case when hs = 'ambiguous' or st = 'ambiguous' then 'ambiguous' when hs = 'stand-in' or st = 'stand-in' then 'stand-in' when hs = 'assumed' or st = 'assumed' then 'assumed' else 'rated' end as status from nraw)"""


@query(f"{WITH}, {NAMED_SQL} select game_id, home, away, status, case when status <> 'ambiguous' then {R('margin', 2)} end as margin, case when status <> 'ambiguous' then {R(f'1 / (1 + exp(-margin / ({CURVE("behind", "stood")})))', 3)} end as p from named")
def predict_named(spark, sf):
    """The coming games as a schedule names them: shared names are told by the league or left alone, unknown ones get the stand-in."""
    games, rated, roster = played(spark, sf), cut(season_fit(spark, sf)), arena.dense_roster(spark, sf)
    name = lambda c: roster.select(F.col("team").alias(c), F.col("name").alias(f"{c}_name"))
    asked = arena.fixtures(arena.dense_games(spark, sf)).join(name("home"), "home").join(name("away"), "away")
    asked = asked.select("wk", "game_id", "neutral", F.when(F.floor(F.col("game_id") / 100) % 7 == 0, "Nobody").otherwise(F.col("home_name")).alias("home_name"), "away_name")
    found = forecast.predict_named(asked, roster, rated, rec.records(games), forecast.scoring_profile(games), stand_in=priors.stand_in(rated, roster))
    return found.select("game_id", "home", "away", "status", safe_round(F.col("margin"), 2).alias("margin"), "p")


@query(f"{WITH} select count(*) as kept, (select count(*) from fixtures) as all_fixtures from fixtures where home in (select team from roster where in_league) or away in (select team from roster where in_league)")
def fixtures_in_league(spark, sf):
    fixtures = arena.fixtures(arena.dense_games(spark, sf))
    kept = forecast.fixtures_in_league(fixtures, arena.dense_roster(spark, sf)).agg(F.count(F.lit(1)).alias("kept"))
    return kept.join(F.broadcast(fixtures.agg(F.count(F.lit(1)).alias("all_fixtures"))))


@query(f"""{WITH}, {PREDICTED}, rec as (select team, count_if(pf > pa) as w, count(*) as games, count_if(pf = pa) as t from psides group by team), more as (select team, sum(p) as more, count(*) as n from (select home as team, p from shown union all select away, 1 - p from shown) group by team),
j as (select coalesce(rec.team, more.team) as team, {R('coalesce(w, 0) + coalesce(more, 0.0)', 1)} as wins, coalesce(games, 0) - coalesce(t, 0) + coalesce(n, 0) as total from rec full outer join more on rec.team = more.team) select team, wins, {R('total - wins', 1)} as losses from j""")
def project_records(spark, sf):
    return forecast.project_records(rec.records(played(spark, sf)), predicted(spark, sf))


@query(f"""{WITH}, {PREDICTED}, idx as (select team, row_number() over (order by team) - 1 as i from fit where team <> -1) select game_id, wk, h.i as h, a.i as a, coalesce(h.i, -1) >= 0 as known from shown left join idx h on h.team = home left join idx a on a.team = away""")
def schedule_index(spark, sf):
    teams = season_fit(spark, sf).filter("team <> -1").select("team")
    index = teams.select("team", (F.row_number().over(Window.orderBy("team")) - 1).cast("long").alias("i"))
    rows = predicted(spark, sf).drop("h", "a").join(index.select(F.col("team").alias("home"), F.col("i").alias("h")), "home", "left").join(index.select(F.col("team").alias("away"), F.col("i").alias("a")), "away", "left")
    return rows.select("game_id", "wk", "h", "a", (F.coalesce("h", F.lit(-1)) >= 0).alias("known"))


@query()
def compact_schedule(spark, sf):
    """Short JSON rows of the payload."""
    index = arena.dense_roster(spark, sf).select("team", (F.row_number().over(Window.orderBy("team")) - 1).alias("i"))
    return forecast.compact(predicted(spark, sf), index)


EARLY = f"early as (select * from sparse where season = {arena.SEASON} and wk <= {arena.PLAYED_TO})"
#: The smallest label that reaches a node, by rounds in which every node takes its neighbours' smallest; only labels that fall go on.
REACH = "e as (select home as u, away as v from early union select away, home from early), r as (select u as node, u as root from e union select e.u, r.root from r join e on e.v = r.node where r.root < e.u), comp as (select node, min(root) as root from r group by node)"


def early(spark, sf):
    return arena.sparse_games(spark, sf).filter((F.col("season") == arena.SEASON) & (F.col("wk") <= arena.PLAYED_TO))


@query(f"with recursive {SPARSE_SQL}, {EARLY}, {REACH} select node, root from comp")
def components(spark, sf):
    ensure_cut(spark)
    return forecast.components(early(spark, sf).select(F.col("home").alias("a"), F.col("away").alias("b")))


@query(f"with recursive {SPARSE_SQL}, {EARLY}, {REACH}, s as (select root, count(*) as n from comp group by root), t as (select cast(sum(n) as bigint) as teams, count(*) as components, max(n) as largest, (select count(*) from early) as games from s) select teams, components, largest, {R('2.0 * games / teams', 2)} as mean_games, case when 2.0 * games / teams < 2 or largest / teams < 0.25 then 'none' when largest / teams < 0.6 then 'low' when largest / teams < 0.9 or 2.0 * games / teams < 4 then 'medium' else 'high' end as label from t")
def connectivity(spark, sf):
    ensure_cut(spark)
    games = early(spark, sf)
    return forecast.connectivity(forecast.components(games.select(F.col("home").alias("a"), F.col("away").alias("b"))), games)


@query(f"{WITH}, asked as (select distinct name from roster union select 'Nobody'), c as (select name, count(*) as n, count_if(in_league) as lg, min(team) as t, min(case when in_league then team end) as lt from roster group by name) select name, coalesce(n, 0) as candidates, case when n = 1 then t when lg = 1 then lt end as team, case when n is null then 'stand-in' when n = 1 then 'rated' when lg = 1 then 'assumed' else 'ambiguous' end as status from asked left join c using (name)")
def side_status(spark, sf):
    roster = arena.dense_roster(spark, sf)
    return forecast.side_status(roster.select("name").union(spark.createDataFrame([("Nobody",)], "name string")), roster)


# --- priors: the season before, and what it says about this one -----------------------------------------------------
LAST = "last as (select * from games where season = 1999)"
LAST_FIT = fit_sql("last", MARGIN, "lf")
EFFECTS = "lg as (select lf.team, rating, division, school_id, name from lf join roster using (team) where in_league and team in (select team from (select unnest([home, away]) as team from last) group by team having count(*) >= 4)), dm as (select division, avg(rating) as mean from lg group by division having count(*) >= 10), eff as (select division, mean - avg(mean) over () as effect from dm)"
DEVS = f"dev as (select school_id, {R('greatest(-14.0, least(14.0, (rating - m.mean - coalesce(effect, 0.0)) * 0.6))', 3)} as dev from lg cross join (select avg(rating) as mean from lg) m left join eff using (division))"
COMPOSED = f"raw_prior as (select team, coalesce(effect, 0.0) + coalesce(dev, 0.0) as prior from roster left join eff using (division) left join dev using (school_id) where in_league), prior as (select team, {R('prior - avg(prior) over ()', 3)} as prior from raw_prior)"


def last_fit(spark, sf):
    games = arena.dense_games(spark, sf).filter("season = 1999")
    return priors.full_season(ratings.fit(games, ["season"]), games, arena.dense_roster(spark, sf))


@query(f"{WITH}, {LAST}, {LAST_FIT}, {EFFECTS} select division, {R('effect', 2)} as effect from eff")
def division_effects(spark, sf):
    return priors.division_effects(last_fit(spark, sf), arena.dense_roster(spark, sf)).select("division", safe_round(F.col("effect"), 2).alias("effect"))


@query(f"{WITH}, {LAST}, {LAST_FIT}, {EFFECTS}, {DEVS} select school_id, round(dev + 1e-9, 2) + 0.0 as dev from dev")
def build_prior(spark, sf):
    return priors.build_prior(last_fit(spark, sf), arena.dense_roster(spark, sf)).select("school_id", safe_round(F.col("dev"), 2).alias("dev"))


@query(f"{WITH}, {LAST}, {LAST_FIT}, {EFFECTS}, {DEVS}, byname as (select name, avg(dev) as dev from roster join dev using (school_id) group by name) select r.team, {R('coalesce(d.dev, n.dev, 0.0)', 2)} as dev from roster r left join (select * from dev where cast(school_id as int) % 2 = 0) d using (school_id) left join byname n on n.name = r.name")
def apply_prior(spark, sf):
    """School ids that are odd are held back, so that those teams take the prior of their name."""
    roster, dev = arena.dense_roster(spark, sf), priors.build_prior(last_fit(spark, sf), arena.dense_roster(spark, sf))
    by_name = roster.join(dev, "school_id").groupBy("name").agg(F.avg("dev").alias("dev"))
    return priors.apply_prior(roster, dev.filter(F.col("school_id").cast("int") % 2 == 0), by_name).select("team", safe_round(F.col("dev"), 2).alias("dev"))


def composed(spark, sf):
    roster, fitted = arena.dense_roster(spark, sf), last_fit(spark, sf)
    dev = roster.join(priors.build_prior(fitted, roster), "school_id").select("team", "dev")
    return priors.compose(roster, priors.division_effects(fitted, roster), dev)


@query(f"{WITH}, {LAST}, {LAST_FIT}, {EFFECTS}, {DEVS}, {COMPOSED} select team, {R('prior', 2)} as prior from prior")
def compose_prior(spark, sf):
    return composed(spark, sf).select("team", safe_round(F.col("prior"), 2).alias("prior"))


@query(f"{WITH}, {LAST}, {LAST_FIT}, {EFFECTS}, {DEVS}, {COMPOSED}, few as (select * from played where wk <= 3), f_g as (select home, away, neutral, {MARGIN} as y from few), f_ids as (select distinct unnest([home, away]) as team from f_g union select team from prior), cen as (select team, coalesce(prior, 0.0) / 9.0 - avg(coalesce(prior, 0.0) / 9.0) over () as c from f_ids left join prior using (team)), ft(k, team, th) as (select 0, team, c from cen union all select 0, -1, cast(0.0 as double) union all select k + 1, team, case when team = -1 then th else th - avg(th) filter (where team <> -1) over () end from (select k, team, th - 0.7 * (gr + pen * (th - c)) / (he + greatest(pen, 1e-12)) as th from (select any_value(t.k) as k, t.team, any_value(t.th) as th, any_value(coalesce(cen.c, 0.0)) as c, case when t.team = -1 then 0.0 else 0.125 end as pen, coalesce(sum(s.gr), 0) as gr, coalesce(sum(s.he), 0) as he from ft t left join cen on cen.team = t.team left join (select e.team, sum(e.sg * (e.p - e.y)) as gr, sum(e.p * (1 - e.p)) as he from (select unnest([z.home, z.away, case when z.neutral then -2 else -1 end]) as team, unnest([1, -1, 1]) as sg, z.p, z.y from (select g.home, g.away, g.neutral, 1 / (1 + exp(-(a.th - b.th + case when g.neutral then 0 else f.th end))) as p, g.y from f_g g join ft a on a.team = g.home join ft b on b.team = g.away join ft f on f.team = -1) z) e group by e.team) s on s.team = t.team where t.k < 150 group by t.team) u) w) select team, {R('th * 9.0', 2)} as rating from ft where k = 150")
def fit_with_prior(spark, sf):
    """A few weeks into the season, each team pulled towards its prior; teams without a game stay in."""
    games = played(spark, sf).filter("wk <= 3")
    found = ratings.fit(games, ["season"], priors=composed(spark, sf).withColumn("season", F.lit(arena.SEASON)))
    return found.select("team", safe_round(F.col("rating"), 2).alias("rating"))


@query(f"{WITH}, {FIT} select {R('median(rating)', 2)} as rating, count(*) as teams from fit join roster using (team) where in_league")
def standin_rating(spark, sf):
    return priors.stand_in(season_fit(spark, sf), arena.dense_roster(spark, sf))


#: Last season's roster: some schools had another division, some another name; one in four has no id, so that only its name follows it.
MOVED = f"""sid as (select *, {rendered.FULL('team')} as now_name, case when team % 4 = 0 then ' ' else school_id end as now_id, case when team % 5 = 0 and division is not null then (['I','II','III','IV','V','VI','VII'])[team % 7 + 1] else division end as old_division, case when team % 3 = 1 then 'Old ' else '' end || {rendered.FULL('team')} as old_name from roster where in_league),
olg as (select sid.team, rating, old_division as division, case when trim(now_id) <> '' then now_id else old_name end as key from lf join sid using (team) where team in (select team from (select unnest([home, away]) as team from last) group by team having count(*) >= 4)),
odm as (select division, avg(rating) as mean from olg group by division having count(*) >= 10), oeff as (select division, mean - avg(mean) over () as effect from odm),
odev as (select key, greatest(-14.0, least(14.0, (rating - (select avg(rating) from olg) - coalesce(effect, 0.0)) * 0.6)) as dev from olg left join oeff using (division)),
nraw as (select team, coalesce(effect, 0.0) + coalesce(dev, 0.0) as prior from sid left join oeff using (division) left join odev on odev.key = case when trim(now_id) <> '' then now_id else now_name end)"""


@query(f"{WITH}, {LAST}, {LAST_FIT}, {MOVED} select team, {R('prior - avg(prior) over ()', 2)} as prior from nraw")
def prior_for(spark, sf):
    """Each team's starting point from last season, across new names and divisions: its division's effect and what it earned above that of its old one."""
    roster, fitted, t = arena.dense_roster(spark, sf), last_fit(spark, sf), F.col("team")
    now = roster.withColumns({"name": rendered.full_name(t), "school_id": F.when(t % 4 == 0, " ").otherwise(F.col("school_id"))})
    old = now.withColumns({"name": F.concat(F.when(t % 3 == 1, "Old ").otherwise(""), "name"), "division": F.when((t % 5 == 0) & F.col("division").isNotNull(), arena.division_of(t)).otherwise(F.col("division"))})
    return priors.starting_points(fitted, old, now).select("team", safe_round(F.col("prior"), 2).alias("prior"))


@query(f"{WITH}, {FIT} select count_if(team = -1 and rating between -6 and 6) as advantage_in_band, count_if(team <> -1) as teams, (select bool_and(b <= a) from (select {CURVE('g')} as a, {CURVE('(g + 1)')} as b from range(1, 16) t(g))) as curve_steepens from fit")
def meta_checks(spark, sf):
    """The home advantage lies in its band, and probabilities grow surer with games played."""
    from ..functions.scales import prob_scale

    steps = spark.range(1, 16).select(prob_scale(F.col("id").cast("double"), F.lit(False)).alias("a"), prob_scale(F.col("id") + 1.0, F.lit(False)).alias("b"))
    steep = steps.agg(F.bool_and(F.col("b") <= F.col("a")).alias("curve_steepens"))
    return season_fit(spark, sf).agg(F.count_if((F.col("team") == -1) & F.col("rating").between(-6, 6)).alias("advantage_in_band"), F.count_if(F.col("team") != -1).alias("teams")).join(F.broadcast(steep))
