"""Queries on the simulated rest of the season."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, simulate
from ..operators.lineage import cut
from . import arena
from .queries_forecast import PREDICTED, played, predicted
from .queries_records import POINTS
from .registry import registry
from .reporting import with_counts

QUERIES, ORACLE_SQL, query = registry()
WITH = f"with recursive {arena.ARENA_SQL}"
R = lambda x, n: f"round({x} + 1e-9, {n}) + 0.0"
#: Simulations of all open games up to the last regular week; swings need LEAST_BRANCH of them either way.
SIMS, LEAST = 1000, simulate.LEAST_BRANCH

UNIFORM = lambda *k: f"(('0x' || substr(md5(concat_ws('|', {', '.join(f'cast({x} as varchar)' for x in k)})), 1, 8))::bigint / 4294967296.0)"
DRAWS = f"""{PREDICTED}, open as (select game_id, home, away, p from shown where wk <= {arena.LAST_REGULAR_WEEK}), draws as (select s as sim, game_id, home, away, {UNIFORM('game_id', 's', simulate.SEED)} < p as home_won from open, range({SIMS}) r(s))"""
SIM = f"""{DRAWS}, val as (select team, cast({POINTS} as double) as value from roster),
beat as (select case when hs > aw then home else away end as team, case when hs > aw then away else home end as opp from played where hs <> aw),
fixed as (select team, sum(value) as f1, count(*) as fw from (select beat.team, v.value from beat join val v on v.team = beat.opp) group by team),
ng as (select team, count(*) as games from (select unnest([home, away]) as team from played union all select unnest([home, away]) from open) group by team),
won as (select sim, case when home_won then home else away end as team, case when home_won then away else home end as opp from draws),
new as (select sim, won.team, sum(v.value) as n1, count(*) as nw from won join val v on v.team = won.opp group by sim, won.team),
lev as (select s as sim, roster.team, region, in_league, coalesce(games, 0) as games, coalesce(f1, 0) + coalesce(n1, 0) as l1, coalesce(fw, 0) + coalesce(nw, 0) as wins from roster cross join range({SIMS}) r(s) left join fixed on fixed.team = roster.team left join ng on ng.team = roster.team left join new on new.team = roster.team and new.sim = s),
l2 as (select sim, team, sum(l1) as l2 from (select won.sim, won.team, l1 from won join lev on lev.sim = won.sim and lev.team = won.opp union all select lev.sim, beat.team, l1 from beat join lev on lev.team = beat.opp) group by sim, team),
simulated as (select lev.sim, lev.team, region, (l1 + coalesce(l2, 0)) / greatest(games, 1) as points, wins from lev left join l2 on l2.sim = lev.sim and l2.team = lev.team where in_league and region is not null),
seeded as (select *, row_number() over (partition by sim, region order by points desc, {UNIFORM('team', 'sim', simulate.SEED + 1)}, team) as seed from simulated)"""
COND = f"""{SIM}, reg as (select team, region from seeded where sim = 0), touch as (select game_id, region from open join reg on reg.team = home union select game_id, region from open join reg on reg.team = away),
br as (select game_id, count_if(home_won) as n_home, count_if(not home_won) as n_away from draws group by game_id having count_if(home_won) >= {LEAST} and count_if(not home_won) >= {LEAST}),
q as (select s.team, d.game_id, count_if(home_won) as qh, count_if(not home_won) as qa from seeded s join draws d on d.sim = s.sim join touch t on t.game_id = d.game_id and t.region = s.region where seed <= 12 group by s.team, d.game_id),
cond as (select reg.team, reg.region, t.game_id, n_home, coalesce(qh, 0) / n_home as p_home, coalesce(qa, 0) / n_away as p_away, o.home, o.away from reg join touch t on t.region = reg.region join br on br.game_id = t.game_id join open o on o.game_id = t.game_id left join q on q.team = reg.team and q.game_id = t.game_id)"""


def open_games(spark, sf):
    return predicted(spark, sf).filter(F.col("wk") <= arena.LAST_REGULAR_WEEK).select("game_id", "home", "away", "p")


def drawn(spark, sf):
    # forecasts and draws are written once: the sample is read many times
    return cut(simulate.draws(open_games(spark, sf), SIMS))


def simulated(spark, sf):
    games = drawn(spark, sf)
    return cut(simulate.simulate(arena.dense_roster(spark, sf), played(spark, sf), games, SIMS)), games


def seeded(spark, sf):
    runs, games = simulated(spark, sf)
    return cut(simulate.seeds(runs, SIMS)), games


@query(f"{WITH}, {DRAWS} select game_id, count_if(home_won) as home_wins from draws group by game_id")
def mc_draws(spark, sf):
    return simulate.draws(open_games(spark, sf), SIMS).select("game_id", simulate.ones(F.col("won")).alias("home_wins"))


@query(f"{WITH}, {SIM} select team, {R('avg(points)', 3)} as points, {R('min(points)', 3)} as low, {R('max(points)', 3)} as high, cast(sum(wins) as bigint) as wins from simulated group by team")
def mc_points(spark, sf):
    runs, _ = simulated(spark, sf)
    r = lambda c: arena.safe_round(c, 3)
    total = lambda c, kind: F.aggregate(c, F.lit(0).cast(kind), lambda n, x: n + x)
    return runs.select("team", r(total("points", "double") / SIMS).alias("points"), r(F.array_min("points")).alias("low"), r(F.array_max("points")).alias("high"), total("wins", "bigint").alias("wins"))


@query(f"{WITH}, {SIM} select sim, region, team, seed from seeded where seed <= 3")
def mc_seeds(spark, sf):
    return simulate.by_run(seeded(spark, sf)[0]).filter("seed <= 3").select("sim", "region", "team", "seed")


@query(f"{WITH}, {SIM} select team, {R('avg(cast(seed <= 12 as double))', 3)} as playoff, {R('avg(cast(seed <= 4 as double))', 3)} as bye, {R('avg(cast(seed = 1 as double))', 3)} as top, {R('avg(seed)', 2)} as mean_seed, cast(floor(median(seed)) as bigint) as median_seed, {R('avg(points)', 3)} as mean_points, {R('avg(wins)', 2)} as mean_wins from seeded group by team")
def mc_summary(spark, sf):
    return simulate.summary(simulate.by_run(seeded(spark, sf)[0]))


@query(f"{WITH}, {SIM}, c as (select team, wins, count(*) / {SIMS}.0::double as share from seeded group by team, wins), e as (select *, min(case when share > 0.0005 then wins end) over (partition by team) as lo, max(case when share > 0.0005 then wins end) over (partition by team) as hi from c) select team, wins, {R('share', 3)} as share from e where wins between lo and hi")
def win_dist(spark, sf):
    return simulate.win_distribution(simulate.by_run(seeded(spark, sf)[0]), SIMS)


@query(f"{WITH}, {COND}, own as (select team, game_id, case when team = home then p_home else p_away end as w, case when team = home then p_away else p_home end as l from cond where team = home or team = away) select team, game_id, {R('w', 3)} as if_win, {R('l', 3)} as if_lose, {R('w - l', 3)} as swing from own")
def own_swings(spark, sf):
    return simulate.own_swings(*seeded(spark, sf), SIMS)


@query(f"{WITH}, {COND}, o as (select *, round(p_home - p_away, 9) as s from cond where team <> home and team <> away), k as (select *, row_number() over (partition by team order by abs(s) desc, game_id) as rank from o where abs(s) >= 0.005) select team, rank, game_id, case when s > 0 then 'home' else 'away' end as rooting, {R('abs(s)', 3)} as swing from k where rank <= 3")
def scoreboard_watch(spark, sf):
    return simulate.scoreboard_watch(*seeded(spark, sf), SIMS)


@query(f"{WITH}, {SIM}, r as (select sim, region, count(*) as n, count_if(seed <= 12) as places, count_if(seed <= 4) as byes, count_if(seed = 1) as tops from seeded group by sim, region) select region, {R('avg(places)', 2)} as places, {R('avg(byes)', 2)} as byes, {R('avg(tops)', 2)} as tops, min(least(12, n)) as owed from r group by region")
def conservation(spark, sf):
    """Each region's odds add up to its places."""
    per = simulate.by_run(seeded(spark, sf)[0]).groupBy("sim", "region").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("seed") <= 12).alias("places"), F.count_if(F.col("seed") <= 4).alias("byes"), F.count_if(F.col("seed") == 1).alias("tops"))
    r = lambda c: arena.safe_round(F.avg(c), 2)
    return per.groupBy("region").agg(r("places").alias("places"), r("byes").alias("byes"), r("tops").alias("tops"), F.min(F.least(F.lit(12), F.col("n"))).alias("owed"))


@query(f"{WITH}, {COND}, q2 as (select team, avg(cast(seed <= 12 as double)) as overall from seeded group by team) select count(*) as pairs, count_if(abs(p_home * n_home / {SIMS} + p_away * (1 - n_home / {SIMS}) - overall) > 0.02) as broken, count_if(overall < least(p_home, p_away) - 0.02 or overall > greatest(p_home, p_away) + 0.02) as outside from cond join q2 using (team)")
def total_probability(spark, sf):
    """Odds lie between, and average to, the odds given either result."""
    return simulate.total_probability(*seeded(spark, sf), SIMS)


@query(f"{WITH} select case when count(*) = 0 then 'nothing to simulate' else 'simulated' end as marker, count(*) as open_games from fixtures where wk <= {arena.LAST_REGULAR_WEEK}")
def sim_skip(spark, sf):
    """A marker is published even where nothing remains to be simulated."""
    left = arena.fixtures(arena.dense_games(spark, sf)).filter(F.col("wk") <= arena.LAST_REGULAR_WEEK).agg(F.count(F.lit(1)).alias("open_games"))
    return left.select(F.when(F.col("open_games") == 0, "nothing to simulate").otherwise("simulated").alias("marker"), "open_games")


@query(f"{WITH}, {COND}, own as (select team, game_id, case when team = home then p_home - p_away else p_away - p_home end as s from cond where team = home or team = away) select team, count(*) as games, string_agg(cast(game_id as varchar), ',' order by wk, game_id) as by_week from own join (select game_id, wk from shown) using (game_id) group by team")
def what_if(spark, sf):
    """Each team's own open games that are worth telling, by week."""
    weeks = arena.fixtures(arena.dense_games(spark, sf)).select("game_id", "wk")
    rows = simulate.own_swings(*seeded(spark, sf), SIMS).join(weeks, "game_id")
    return rows.groupBy("team").agg(F.count(F.lit(1)).alias("games"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("wk", "game_id"))), lambda g: g["game_id"].cast("string")), ",").alias("by_week"))


ODDS = f"""{COND}, od as (select team, any_value(region) as region, {R('avg(cast(seed <= 12 as double))', 3)} as playoff, {R('avg(cast(seed <= 4 as double))', 3)} as bye, {R('avg(cast(seed = 1 as double))', 3)} as top from seeded group by team),
rs as (select region, count(*) as teams, sum(playoff) as playoff, sum(bye) as bye, sum(top) as top from od group by region), wd as (select team, sum(share) as total from (select team, wins, {R(f'count(*) / {SIMS}.0::double', 3)} as share, count(*) as n from seeded group by team, wins) x where n > 0.0005 * {SIMS} group by team),
own as (select team, game_id, {R('case when team = home then p_home else p_away end', 3)} as w, {R('case when team = home then p_away else p_home end', 3)} as l from cond where team = home or team = away),
wt as (select team, game_id, home, away, s from (select *, row_number() over (partition by team order by abs(s) desc, game_id) as k from (select *, round(p_home - p_away, 9) as s from cond where team <> home and team <> away) o where abs(s) >= 0.005) x where k <= 3)"""
ODDS_COUNTS = ["(select count_if(greatest(playoff, bye, top) > 1 or least(playoff, bye, top) < 0) from od)", "(select count_if(bye > playoff + 1e-6) from od)", "(select count_if(top > bye + 1e-6) from od)"]
ODDS_COUNTS += ["(select count_if(abs(playoff - least(12.0, teams)) >= 0.02) from rs)", "(select count_if(abs(bye - least(4.0, teams)) >= 0.02) from rs)", "(select count_if(abs(top - 1) >= 0.02) from rs)", "(select count_if(abs(total - 1) >= 0.02) from wd)"]
ODDS_COUNTS += ["(select count_if(greatest(w, l) > 1 or least(w, l) < 0) from own)", "(select count_if(playoff < least(w, l) - 0.02 or playoff > greatest(w, l) + 0.02) from own join od using (team))", "(select count_if(team = home or team = away) from wt)", "(select count_if(s = 0) from wt)", "(select count_if(abs(s) > 1) from wt)"]


@query(f"{WITH}, {ODDS} " + with_counts(audit.odds_rules(12, 4), ODDS_COUNTS))
def check_odds(spark, sf):
    """The simulation under its rules: places, byes and top seats add up, odds are nested, conditionals bracket them, nobody watches itself."""
    seeds, games = seeded(spark, sf)
    runs = simulate.by_run(seeds)
    odds = cut(simulate.summary(runs).join(seeds.select("team", "region").distinct(), "team"))
    regions = odds.groupBy("region").agg(F.count(F.lit(1)).alias("teams"), *[F.sum(c).alias(c) for c in ("playoff", "bye", "top")])
    wins = simulate.win_distribution(runs, SIMS).groupBy("team").agg(F.sum("share").alias("total"))
    swings = simulate.own_swings(seeds, games, SIMS).join(odds.select("team", "playoff"), "team")
    watch = simulate.scoreboard_watch(seeds, games, SIMS).join(games.select("game_id", "home", "away"), "game_id")
    return audit.audit(audit.odds_rules(12, 4), {"odds": odds, "regions": regions, "wins": wins, "swings": swings, "watch": watch})
