"""Queries on walk-forward forecasts, the grid, calibration and the history log."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from ..operators import calibrate as cal
from ..operators import audit, checks, history, ratings, tuning
from ..operators.lineage import cut
from . import arena
from .queries_forecast import predicted
from .queries_ratings import CURVE
from .registry import registry
from .reporting import with_counts

QUERIES, ORACLE_SQL, query = registry()
WITH = f"with recursive {arena.ARENA_SQL}"
R = lambda x, n: f"round({x} + 1e-9, {n}) + 0.0"
HOLDOUTS, SEASONS = [8, 14, 20, 26], (1999, 2000)
#: A short grid over the four knobs, checked in SQL; FULL is the whole product, for the same calls.
GRID = [(i, *c) for i, c in enumerate(product((7.0, 9.0, 12.0), (0.5, 1.0), (0.4, 0.6), (0.0, 1.0)))]
FULL = [(i, *c) for i, c in enumerate(product((5.0, 6.0, 7.0, 8.0, 9.0, 10.0), (0.05, 0.1, 0.25, 0.5, 0.75, 1.5), (0.5, 0.6, 0.7, 0.8, 0.9, 1.0), (0.0, 0.5, 1.0, 1.5, 2.0, 2.5)))]
CONFIGS = "config int, scale double, prior_games double, carry double, division_weight double"
VALUES = ", ".join(f"({i}, {', '.join(f'{v}::double' for v in c)})" for i, *c in GRID)


def newton_sql(name: str, games: str, start: str, rounds: int) -> str:
    """Damped, recentred rounds over (g, team, th) for every group g of games (g, home, away, neutral, y); start has g, team, th, pen and cen, team -1 the advantage."""
    return f"""{name}(k, g, team, th, pen, cen) as (select 0, g, team, th, pen, cen from {start}
  union all select k + 1, g, team, case when team = -1 then th else th - avg(th) filter (where team <> -1) over (partition by g) end, pen, cen from (
    select k, g, team, pen, cen, th - 0.7 * (gr + pen * (th - cen)) / (he + greatest(pen, 1e-12)) as th from (
      select any_value(t.k) as k, t.g, t.team, any_value(t.th) as th, any_value(t.pen) as pen, any_value(t.cen) as cen, coalesce(sum(s.gr), 0) as gr, coalesce(sum(s.he), 0) as he
      from {name} t left join (select e.g, e.team, sum(e.sg * (e.p - e.y)) as gr, sum(e.p * (1 - e.p)) as he from (
          select z.g, unnest([z.home, z.away, case when z.neutral then -2 else -1 end]) as team, unnest([1, -1, 1]) as sg, z.p, z.y from (
            select q.g, q.home, q.away, q.neutral, 1 / (1 + exp(-(a.th - b.th + case when q.neutral then 0 else f.th end))) as p, q.y
            from {games} q join {name} a on a.g = q.g and a.team = q.home join {name} b on b.g = q.g and b.team = q.away join {name} f on f.g = q.g and f.team = -1) z) e
          group by e.g, e.team) s on s.g = t.g and s.team = t.team
      where t.k < {rounds} group by t.g, t.team) u) w)"""


def walk_sql(configs: str) -> str:
    """The walk-forward forecasts as table wf: last season's fits, what they say of every team, then all folds' fits at once."""
    y = "1 / (1 + exp(-greatest(-49, least(49, hs - aw)) / scale))"
    return f"""cfg(config, scale, prior_games, carry, division_weight) as (values {configs}), pool as (select * from games where season in {SEASONS}),
fits as (select distinct scale, prior_games, cast(scale * 1000 + prior_games * 100 as int) as fit from cfg),
lg_games as (select season + 1 as season, home, away, neutral, hs, aw from games where season + 1 in {SEASONS}),
lq as (select fit * 10000 + season as g, home, away, neutral, {y} as y from lg_games, fits),
ls as (select distinct g, team, cast(0.0 as double) as th, 0.25 * prior_games as pen, cast(0.0 as double) as cen from (select fit * 10000 + season as g, prior_games, unnest([home, away]) as team from lg_games, fits) union all select distinct fit * 10000 + season, -1, 0.0, 0.0, 0.0 from lg_games, fits),
{newton_sql('lt', 'lq', 'ls', 80)},
lr as (select g // 10000 as fit, g % 10000 as season, team, th * scale as rating from lt join fits on fits.fit = lt.g // 10000 where k = 80),
often as (select season, team from (select season, unnest([home, away]) as team from lg_games) group by season, team having count(*) >= 4),
lgr as (select lr.fit, lr.season, lr.team, division, rating from lr join roster using (team) join often using (season, team) where in_league),
lmean as (select fit, season, avg(rating) as mean from lgr group by fit, season),
lstep as (select fit, season, division, avg(rating) as level from lgr where division is not null group by fit, season, division having count(*) >= 10),
leff as (select fit, season, division, level - avg(level) over (partition by fit, season) as effect from lstep),
lraw as (select config, lmean.season, roster.team, case when in_league then coalesce(effect, 0.0) * division_weight + case when lgr.rating is null then 0.0 else greatest(-14.0, least(14.0, (lgr.rating - mean - coalesce(effect, 0.0)) * carry)) end else 0.0 end as raw
  from lmean cross join roster join fits on fits.fit = lmean.fit join cfg using (scale, prior_games) left join leff on leff.fit = lmean.fit and leff.season = lmean.season and leff.division = roster.division left join lgr on lgr.fit = lmean.fit and lgr.season = lmean.season and lgr.team = roster.team),
lprior as (select config, season, team, raw - avg(raw) over (partition by config, season) as prior from lraw),
lhfa as (select config, season, rating as hfa from lr join fits using (fit) join cfg using (scale, prior_games) where team = -1),
fold as (select f.fold, s.season, (select count(*) from pool where pool.season = s.season and pool.wk < f.fold) as n from (values {', '.join(f'({h})' for h in HOLDOUTS)}) f(fold), (select distinct season from pool) s),
tr as (select f.fold, pool.* from pool join fold f on f.season = pool.season and pool.wk < f.fold),
tq as (select config * 1000000 + tr.season * 100 + tr.fold as g, home, away, neutral, {y} as y from tr join fold using (season, fold), cfg where n >= {tuning.LEAST_TRAIN}),
start as (select config, season, fold, n, team, coalesce(prior, 0.0) / scale as th, scale, 0.25 * prior_games as pen from fold cross join roster cross join cfg left join lprior using (config, season, team)),
ts as (select config * 1000000 + season * 100 + fold as g, team, th, pen, th as cen from start where n >= {tuning.LEAST_TRAIN} union all select config * 1000000 + season * 100 + fold, -1, 0.0, 0.0, 0.0 from fold, cfg where n >= {tuning.LEAST_TRAIN}),
{newton_sql('wt', 'tq', 'ts', 60)},
wr as (select config, (g % 1000000) // 100 as season, g % 100 as fold, team, th * scale as rating from wt join cfg on cfg.config = wt.g // 1000000 where k = 60
  union all select config, season, fold, team, th * scale from start where n < {tuning.LEAST_TRAIN} union all select config, season, fold, -1, coalesce(hfa, {tuning.FIRST_ADVANTAGE}) from fold cross join cfg left join lhfa using (config, season) where n < {tuning.LEAST_TRAIN}),
nb as (select season, fold, team, count(*) as n from (select season, fold, unnest([home, away]) as team from tr) group by season, fold, team),
wm as (select a.config, cfg.scale, g.season, g.wk, g.game_id, g.home, g.away, least(coalesce(nh.n, 0), coalesce(na.n, 0)) as behind, a.rating - b.rating + case when g.neutral then 0 else f.rating end as margin, g.hs - g.aw as actual
  from pool g join wr a on a.season = g.season and a.fold = g.wk and a.team = g.home join wr b on b.config = a.config and b.season = a.season and b.fold = a.fold and b.team = g.away join wr f on f.config = a.config and f.season = a.season and f.fold = a.fold and f.team = -1 join cfg on cfg.config = a.config
  left join nb nh on nh.season = a.season and nh.fold = a.fold and nh.team = g.home left join nb na on na.season = a.season and na.fold = a.fold and na.team = g.away),
wf as (select *, 1 / (1 + exp(-margin / scale)) as p, 1 / (1 + exp(-margin / ({CURVE('behind')}))) as shown_p from wm),
ws as (select *, case when actual = 0 then -(ln(q) + ln(1 - q)) / 2 when actual > 0 then -ln(q) else -ln(1 - q) end as loss, case when actual <> 0 then cast((margin > 0) = (actual > 0) as int) end as rt, abs(margin - actual) as error from (select *, greatest(1e-6, least(1 - 1e-6, p)) as q from wf) z)"""


ONE, ALL = walk_sql("(0, 9.0::double, 0.5::double, 0.6::double, 1.0::double)"), walk_sql(VALUES)


def pool(spark, sf):
    return arena.dense_games(spark, sf).filter(F.col("season").isin(*SEASONS))


def forecasts(spark, sf):
    return tuning.walk_forward(arena.dense_games(spark, sf), HOLDOUTS, arena.dense_roster(spark, sf), seasons=SEASONS)


def grid(spark):
    return spark.createDataFrame(GRID, CONFIGS)


def scored(spark, sf):
    """Every game's loss under every configuration: written once, the choices below read them several times."""
    return tuning.grid_losses(arena.dense_games(spark, sf), HOLDOUTS, arena.dense_roster(spark, sf), GRID, SEASONS, each=True)


@query(f"{WITH}, {ONE} select season, wk, game_id, behind, {R('margin', 2)} as margin, {R('p', 3)} as p from wf")
def walk_forward(spark, sf):
    return forecasts(spark, sf).select("season", "wk", "game_id", "behind", arena.safe_round(F.col("margin"), 2).alias("margin"), arena.safe_round(F.col("p"), 3).alias("p"))


@query(f"{WITH}, {ONE} select season, game_id, actual > 0 as won, behind, wk, {R('margin', 2)} as margin from wf where actual <> 0")
def collect_predictions(spark, sf):
    return forecasts(spark, sf).filter("actual <> 0").select("season", "game_id", (F.col("actual") > 0).alias("won"), "behind", "wk", arena.safe_round(F.col("margin"), 2).alias("margin"))


EVAL = f"count(*) as games, {R('sum(loss) / count(*)', 4)} as logloss, {R('sqrt(greatest(0.0, (sum(loss * loss) - sum(loss) * sum(loss) / count(*)) / greatest(count(*) - 1, 1)) / count(*))', 4)} as se, {R('avg(rt)', 4)} as accuracy, {R('avg(error)', 2)} as mae"


@query(f"{WITH}, {ONE} select season, wk, {EVAL} from ws group by season, wk")
def evaluate(spark, sf):
    return tuning.evaluate(tuning.losses(forecasts(spark, sf)), ["season", "wk"])


@query(f"{WITH}, {ALL} select config, {EVAL} from ws group by config")
def grid_search(spark, sf):
    return tuning.evaluate_sums(searched(spark, sf, GRID), ["config"])


def searched(spark, sf, configs):
    return tuning.grid_losses(arena.dense_games(spark, sf), HOLDOUTS, arena.dense_roster(spark, sf), configs, SEASONS)


@query()
def grid_full(spark, sf):
    """All 1,296 configurations of the four knobs."""
    return tuning.evaluate_sums(searched(spark, sf, FULL), ["config"])


@query(f"{WITH}, {ALL}, e as (select config, round(avg(loss), 9) as m from ws group by config) select config, {R('m', 4)} as logloss from e order by m, config limit 10")
def leaderboard(spark, sf):
    means = tuning.mean_losses(searched(spark, sf, GRID), ["config"])
    return means.orderBy("m", "config").limit(10).select("config", arena.safe_round(F.col("m"), 4).alias("logloss"))


TIED = f"{ALL}, mean as (select config, round(avg(loss), 9) as m from ws group by config), best as (select config from mean order by m, config limit 1), base as (select season, game_id, loss as base from ws where config in (select config from best)), d as (select ws.config, loss - base as d from ws join base using (season, game_id)), td as (select config, avg(d) as gap, coalesce(stddev_samp(d), 0.0) / sqrt(count(*)) as se from d group by config)"


@query(f"{WITH}, {TIED} select config, {R('gap', 3)} as gap, {R('se', 3)} as se, gap <= se + 1e-12 as tied from td")
def tied_with_best(spark, sf):
    r = lambda c: arena.safe_round(F.col(c), 3).alias(c)
    return tuning.tied_with_best(scored(spark, sf)).select("config", r("gap"), r("se"), "tied")


CHOSEN = f"{TIED}, chosen as (select td.config, cfg.scale, cfg.prior_games, cfg.carry, cfg.division_weight from td join cfg using (config) where gap <= se + 1e-12 order by round(abs(cfg.scale - 9.0) / 5.0 + abs(cfg.prior_games - 0.5) / 0.5 + abs(cfg.carry - 0.6) / 0.2 + abs(cfg.division_weight - 1.0) / 1.0, 9), td.config limit 1)"
RANGES = {"scale": 5.0, "prior_games": 0.5, "carry": 0.2, "division_weight": 1.0}


@query(f"{WITH}, {CHOSEN} select config, scale, prior_games, carry, division_weight from chosen")
def select_config(spark, sf):
    return tuning.select_config(tuning.tied_with_best(scored(spark, sf)), grid(spark), RANGES)


@query(f"{WITH}, {CHOSEN} select 'scale' as name, scale as value, scale in (7.0, 12.0) as on_edge from chosen union all select 'prior_games', prior_games, prior_games in (0.5, 1.0) from chosen union all select 'carry', carry, carry in (0.4, 0.6) from chosen union all select 'division_weight', division_weight, division_weight in (0.0, 1.0) from chosen")
def grid_edges(spark, sf):
    return tuning.grid_edges(tuning.select_config(tuning.tied_with_best(scored(spark, sf)), grid(spark), RANGES), grid(spark), list(RANGES))


@query(f"{WITH}, {ALL} select season, arg_min(config, (m, config)) as config from (select season, config, round(avg(loss), 9) as m from ws group by season, config) group by season")
def stability(spark, sf):
    return tuning.stability(tuning.mean_losses(searched(spark, sf, GRID), ["season", "config"]))


@query(f"{WITH}, {ONE}, s as (select wk, sum(margin * actual) / sum(margin * margin) as slope from wf group by wk) select wk, count(*) as games, {R('any_value(slope)', 4)} as slope, {R('avg(abs(margin - actual))', 2)} as mae_raw, {R('avg(abs(margin * slope - actual))', 2)} as mae_fit, {R('avg(margin * slope - actual)', 3)} as bias from wf join s using (wk) group by wk")
def margin_scale(spark, sf):
    return tuning.margin_scale(forecasts(spark, sf), ["wk"])


CURVES = [(float(a), float(b)) for a in (9, 16, 25, 36, 64, 144, 400) for b in (0, 40, 80, 160, 320)]
CURVE_SQL = f"curves(a, b) as (values {', '.join(f'({a}::double, {b}::double)' for a, b in CURVES)}), cl as (select season, a, b, count(*) as games, avg(case when actual > 0 then -ln(q) else -ln(1 - q) end) as loss from (select *, greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-margin / greatest(3.0, least(20.0, sqrt(a + b / behind))))))) as q from wf, curves where actual <> 0 and behind >= 1) z group by season, a, b)"


@query(f"{WITH}, {ONE}, {CURVE_SQL}, al as (select a, b, sum(games) as games, sum(loss * games) / sum(games) as loss from cl group by a, b) select a, b, cast(games as bigint) as games, {R('loss', 4)} as loss from al order by round(loss, 9), a, b limit 1")
def fit_prob_scale(spark, sf):
    best = tuning.fit_prob_scale(forecasts(spark, sf), spark.createDataFrame(CURVES, "a double, b double"), [])
    return best.select("a", "b", "games", arena.safe_round(F.col("loss"), 4).alias("loss"))


@query(f"{WITH}, {ONE}, {CURVE_SQL}, o as (select *, (sum(loss * games) over (partition by a, b) - loss * games) / (sum(games) over (partition by a, b) - games) as rest from cl), k as (select *, row_number() over (partition by season order by round(rest, 9), a, b) as k from o) select season, a, b, games, {R('loss', 4)} as loss from k where k = 1")
def crossval(spark, sf):
    best = tuning.cross_validate(forecasts(spark, sf), spark.createDataFrame(CURVES, "a double, b double"))
    return best.select("season", "a", "b", "games", arena.safe_round(F.col("loss"), 4).alias("loss"))


PUBLISHED = (19.6807, 82.7213)
BANDS = [(1, 15), (15, 53)]


@query(f"{WITH}, {ONE}, c as (select wk, avg(case when actual > 0 then -ln(greatest(1e-6, least(1 - 1e-6, f))) else -ln(1 - greatest(1e-6, least(1 - 1e-6, f))) end) as flat, avg(case when actual > 0 then -ln(greatest(1e-6, least(1 - 1e-6, shown_p))) else -ln(1 - greatest(1e-6, least(1 - 1e-6, shown_p))) end) as fitted, count(*) as n from (select *, 1 / (1 + exp(-margin / 9.0)) as f from wf where actual <> 0) z group by wk having count(*) >= 30) select wk, n, {R('flat', 4)} as flat, {R('fitted', 4)} as fitted from c")
def curve_report(spark, sf):
    """Week by week, what the published curve is worth beside the flat scale."""
    return cal.curve_report(forecasts(spark, sf), spark.createDataFrame([PUBLISHED], "a double, b double"), [])


@query(f"{WITH}, {ONE} select case when wk < 15 then '1-14' else '15-52' end as band, count(*) as n, {R('sum(margin * actual) / sum(margin * margin)', 3)} as slope from wf where actual <> 0 group by 1 having count(*) >= 200")
def margin_bands(spark, sf):
    return cal.margin_bands(forecasts(spark, sf), BANDS)


@query()
def fit_curve(spark, sf):
    """The curve's two numbers to 0.002, over all seasons and each season's without it; no row under 500 forecasts."""
    rows = cut(forecasts(spark, sf))
    alone = cal.fit_curve(cal.binned(rows, []), []).select(F.lit("all").alias("fit"), "a", "b", "games", "loss")
    return alone.unionByName(cal.cross_validated(rows).select(F.concat(F.lit("without "), F.col("season").cast("string")).alias("fit"), "a", "b", F.col("n").alias("games"), F.col("fitted").alias("loss")))


@query()
def calibrate(spark, sf):
    """The whole block: curve, losses in and out of the sample, and the constant for margins."""
    return cal.calibrate(cut(forecasts(spark, sf)))


# --- the history log ---------------------------------------------------------------------------------------------
def logged(spark, sf):
    return forecasts(spark, sf).select(F.when(F.col("wk") <= 14, "backtest").otherwise("live").alias("kind"), "season", "wk", "game_id", "home", "away", arena.safe_round(F.col("margin"), 1).alias("margin"), arena.safe_round(F.col("shown_p"), 3).alias("p"))


LOG = f"{ONE}, lg as (select case when wk <= 14 then 'backtest' else 'live' end as kind, season, wk, game_id, home, away, {R('margin', 1)} as margin, {R('shown_p', 3)} as p from wf)"
#: A pair may meet twice in a week; every forecast is then graded against each of these results, as the join on names does.
GRADED = f"{LOG}, gd as (select lg.*, hs - aw as actual, greatest(1e-6, least(1 - 1e-6, p)) as q from lg join pool g using (season, wk, home, away) where hs <> aw), gs as (select *, cast((margin > 0) = (actual > 0) as int) as rt, case when actual > 0 then -ln(q) else -ln(1 - q) end as loss, abs(margin - actual) as error, power(q - cast(actual > 0 as int), 2) as square from gd)"


@query(f"{WITH}, {GRADED}, s as (select kind, season, count(*) as games, {R('avg(rt)', 4)} as accuracy, {R('avg(loss)', 4)} as logloss, {R('avg(square)', 4)} as brier, {R('avg(error)', 2)} as margin_error from gs group by kind, season) select * from s union all select kind, null, cast(sum(games) as bigint), {R('sum(accuracy * games) / sum(games)', 4)}, {R('sum(logloss * games) / sum(games)', 4)}, {R('sum(brier * games) / sum(games)', 4)}, {R('sum(margin_error * games) / sum(games)', 2)} from s group by kind")
def history_score(spark, sf):
    return history.score(history.graded(logged(spark, sf), pool(spark, sf)).drop("game_id"))


@query(f"{WITH}, {GRADED}, c as (select kind, least(1.0::double, {R('case when p >= 0.5 then p else 1 - p end', 1)}) as predicted, case when p >= 0.5 then actual > 0 else actual <= 0 end as fw from gs) select kind, predicted, {R('avg(cast(fw as int))', 4)} as actual, count(*) as n from c group by kind, predicted having count(*) >= 20")
def calibration(spark, sf):
    return history.calibration(history.graded(logged(spark, sf), pool(spark, sf)))


@query(f"with {arena.ARENA_SQL} select 2000 as season, 26 as through, 'live' as kind, count(*) as n, min(wk) as first_wk, max(wk) as last_wk from fixtures where wk = 27 and home in (select unnest([home, away]) from played) and away in (select unnest([home, away]) from played)")
def snapshot(spark, sf):
    snap = history.snapshot(predicted(spark, sf), arena.SEASON, arena.PLAYED_TO)
    wk = F.transform("pred", lambda p: p["wk"])
    return snap.select("season", "through", "kind", F.size("pred").cast("long").alias("n"), F.array_min(wk).alias("first_wk"), F.array_max(wk).alias("last_wk"))


GRADED_TABLE = f"{GRADED}, tb as (select distinct season, kind, round(p, 1) as bin from gs)"


@query(f"{WITH}, {GRADED_TABLE} select season, count(*) > 0 and bool_and(kind is not null) as nested, count(*) = 0 as flat from tb group by season")
def calibration_shape(spark, sf):
    """Each season's calibration table as a document, nested by kind and flat as it once was: only the first passes."""
    rows = history.graded(logged(spark, sf), pool(spark, sf)).withColumn("bin", F.round("p", 1).cast("string"))
    bins = rows.groupBy("season", "kind", "bin").agg(F.struct(F.avg("p").alias("predicted"), F.avg(F.col("won").cast("int")).alias("actual")).alias("cell"))
    kinds = bins.groupBy("season", "kind").agg(F.map_from_entries(F.collect_list(F.struct("bin", "cell"))).alias("bins"))
    docs = kinds.groupBy("season").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("kind", "bins")))).alias("nested"), F.to_json(F.first("bins")).alias("flat"))
    return docs.select("season", checks.calibration_nested(F.col("nested")).alias("nested"), checks.calibration_nested(F.col("flat")).alias("flat"))


#: Weeks of a season: which the log holds, which are written again, of which kind; games are played up to week 20.
LOGGED = f"""{WITH}, g as (select *, wk - 1 as through from games where season = 2000), old as (select through, case when through % 2 = 1 then 'live' else 'backtest' end as kind, count(*) as n, bool_or(wk <= 20) as frozen from g where through % 3 <> 0 group by through),
new as (select through, case when through % 5 <> 0 then 'live' else 'backtest' end as kind, count(*) as n from g where through % 4 <> 1 and game_id // 100 % 2 = 0 group by through)"""


@query(f"{LOGGED} select 2000 as season, through, case when a.n is null or (b.kind = 'live' and not frozen) then b.kind else a.kind end as kind, case when a.n is null then 'appended' when b.n is null then 'untouched' when b.kind = 'live' and not frozen then 'replaced' else 'kept' end as action, cast(case when a.n is null or (b.kind = 'live' and not frozen) then b.n else a.n end as int) as n from old a full join new b using (through)")
def history_record(spark, sf):
    """A season's log written again: new weeks are appended, live ones revised until a game they speak of is played, all else is kept."""
    games = arena.dense_games(spark, sf).filter("season = 2000").withColumn("through", F.col("wk") - 1)
    pred = F.collect_list(F.struct("wk", "home", "away", (F.col("hs") - F.col("aw")).cast("double").alias("margin"), F.lit(0.5).alias("p")))
    shot = lambda rows, kind: rows.groupBy("season", "through").agg(pred.alias("pred")).withColumn("kind", kind)
    t = F.col("through")
    log = shot(games.filter(t % 3 != 0), F.when(t % 2 == 1, "live").otherwise("backtest"))
    new = shot(games.filter((t % 4 != 1) & (F.floor(F.col("game_id") / 100) % 2 == 0)), F.when(t % 5 != 0, "live").otherwise("backtest"))
    return history.record(log, new, games.filter("wk <= 20")).select("season", "through", "kind", "action", F.size("pred").alias("n"))


FIRST = f"{WITH}, c as (select case when game_id % 3 = 0 then 'a' else 'b' end as source, season, wk, count(*) as picks from games group by all)"


def logs(spark, sf):
    """A log of the even weeks, and what comes in: all weeks, with other numbers."""
    rows = arena.dense_games(spark, sf).groupBy(F.when(F.col("game_id") % 3 == 0, "a").otherwise("b").alias("source"), "season", "wk").agg(F.count(F.lit(1)).alias("picks"))
    return rows.filter("wk % 2 = 0"), rows.withColumn("picks", F.col("picks") + 1000)


@query(f"{FIRST} select source, season, wk, case when wk % 2 = 0 then picks else picks + 1000 end as picks from c", name="rival_append")
@query(f"{FIRST} select source, season, wk, case when wk % 2 = 0 then picks else picks + 1000 end as picks from c")
def append_if_new(spark, sf):
    """The first writer of a (source, season, week) wins."""
    return history.append_if_new(*logs(spark, sf), ["source", "season", "wk"])


WEEKLY = f"""tf as (select f.fold, played.* from played join (values {', '.join(f'({h})' for h in HOLDOUTS)}) f(fold) on wk < fold), tq as (select fold as g, home, away, neutral, 1 / (1 + exp(-greatest(-49, least(49, hs - aw)) / 9.0)) as y from tf),
ts as (select distinct g, team, cast(0.0 as double) as th, cast(0.125 as double) as pen, cast(0.0 as double) as cen from (select g, unnest([home, away]) as team from tq) union all select distinct g, -1, 0.0, 0.0, 0.0 from tq),
{newton_sql('tt', 'tq', 'ts', 120)}, pts as (select g - 1 as through, team, {R('th * 9.0', 1)} as rating from tt where k = 120 and team <> -1)"""


@query(f"{WITH}, {WEEKLY} select team, string_agg(cast(through as varchar), ',' order by through) as weeks, string_agg(cast(rating as varchar), ',' order by through) as ratings, count(*) as points from pts join roster using (team) group by team having count(*) >= 2")
def trends(spark, sf):
    """Each team's rating after each of a few weeks of the season, fitted on what was played until then."""
    games = tuning.folds_of(arena.played(arena.dense_games(spark, sf)), HOLDOUTS)
    fitted = ratings.fit(games, ["fold"]).filter(F.col("team") != ratings.HFA).select((F.col("fold") - 1).alias("through"), "team", arena.safe_round(F.col("rating"), 1).alias("rating"))
    log = fitted.groupBy("through").agg(F.collect_list(F.struct("team", "rating")).alias("teams"))
    return history.trends(log, arena.dense_roster(spark, sf))


@query(f"{WITH}, {ALL} select config, season, {R('sqrt(greatest(0.0, (sum(loss * loss) - sum(loss) * sum(loss) / count(*)) / (count(*) - 1)) / count(*))', 4)} as se from ws group by config, season")
def marginal_se(spark, sf):
    return tuning.evaluate_sums(searched(spark, sf, GRID), ["config", "season"]).select("config", "season", "se")


@query(f"{WITH}, q as (select game_id, hs > aw as won, greatest(1e-6, least(1 - 1e-6, (game_id % 101) / 100.0::double)) as p from games) select game_id, {R('-ln(case when won then p else 1 - p end)', 5)} as loss from q")
def logloss(spark, sf):
    """The loss of a call from 0 to 1 on every game."""
    from ..functions.scales import log_loss

    return arena.dense_games(spark, sf).select("game_id", arena.safe_round(log_loss(F.col("game_id") % 101 / 100.0, F.col("hs") > F.col("aw")), 5).alias("loss"))


@query(f"{WITH}, {GRADED}, k as (select kind, count(*) as games, avg(rt) as acc, count_if(p < 0 or p > 1) as bad from gs group by kind) select kind, games, bad, acc >= 0.4 as floor_held from k")
def scorecard_check(spark, sf):
    """The scorecard's games and probabilities hold together, and accuracy is over a floor."""
    rows = history.graded(logged(spark, sf), pool(spark, sf))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("games"), F.count_if((F.col("p") < 0) | (F.col("p") > 1)).alias("bad"), (F.avg("right") >= 0.4).alias("floor_held"))


LOG_COUNTS = ["(select count_if(p < 0 or p > 1) from gs)", "(select count_if(actual = 0) from gs)", "(select count_if(rt <> cast((margin > 0) = (actual > 0) as int)) from gs)", "(select count_if(a < 0.4) from sk)", "(select count_if(least(ll, br, me) < 0) from sk)", "(select count_if(predicted not between 0 and 1 or actual not between 0 and 1) from cb)", "(select count_if(n < 20) from cb)", "(select count_if(n >= 100 and abs(predicted - actual) > 0.2) from cb)"]


@query(f"{WITH}, {GRADED}, sk as (select kind, season, {R('avg(rt)', 4)} as a, avg(loss) as ll, avg(square) as br, avg(error) as me from gs group by kind, season), cb as (select kind, predicted, {R('avg(cast(fw as int))', 4)} as actual, count(*) as n from (select kind, least(1.0::double, {R('case when p >= 0.5 then p else 1 - p end', 1)}) as predicted, case when p >= 0.5 then actual > 0 else actual <= 0 end as fw from gs) c group by kind, predicted having count(*) >= 20) " + with_counts(audit.log_rules(), LOG_COUNTS))
def check_log(spark, sf):
    """The graded log, its score by season and its calibration under their rules."""
    rows = cut(history.graded(logged(spark, sf), pool(spark, sf)).drop("game_id"))
    return audit.audit(audit.log_rules(), {"grades": rows, "score": history.score(rows).filter("season is not null"), "bins": history.calibration(rows)})
