"""Queries on paired comparison, and the checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, checks, compare, forecast, records as rec, tuning
from ..operators.lineage import cut
from . import arena
from .arena import ARENA_SQL
from .queries_forecast import PREDICTED, played, predicted
from .queries_ratings import FIT, season_fit
from .queries_records import SIDES
from .queries_tuning import LOG, HOLDOUTS, forecasts, logged, pool
from .registry import registry
from .reporting import with_counts

QUERIES, ORACLE_SQL, query = registry()
WITH = f"with recursive {ARENA_SQL}"
R = lambda x, n: f"round({x} + 1e-9, {n}) + 0.0"

#: The rival: the difference of mean margins to date, as a probability at a flat scale of 12.
RIVAL = """tm as (select season, fold, team, avg(m) as mean from (select season, fold, home as team, hs - aw as m from tr union all select season, fold, away, aw - hs from tr) group by season, fold, team),
rv as (select g.season, g.wk, g.home, g.away, round(a.mean - b.mean + 1e-9, 1) + 0.0 as their_margin from pool g join tm a on a.season = g.season and a.fold = g.wk and a.team = g.home join tm b on b.season = g.season and b.fold = g.wk and b.team = g.away),
rq as (select *, greatest(0.01, least(0.99, round(1 / (1 + exp(-their_margin / 12.0)) + 1e-9, 3) + 0.0)) as their_p from rv)"""
SHARED = f"""{LOG}, {RIVAL}, la as (select distinct season, wk, home, away, arg_max(margin, game_id) over (partition by season, wk, home, away) as margin, arg_max(p, game_id) over (partition by season, wk, home, away) as p from lg where kind = 'live'),
ac as (select season, wk, home, away, hs - aw as actual from pool where hs <> aw),
sh0 as (select la.*, their_margin, their_p, actual from la join (select distinct * from rq) r using (season, wk, home, away) join ac using (season, wk, home, away)),
sh as (select *, (margin > 0) = (actual > 0) as ok, (their_margin > 0) = (actual > 0) as tok, case when actual > 0 then -ln(greatest(1e-6, least(1 - 1e-6, p))) else -ln(1 - greatest(1e-6, least(1 - 1e-6, p))) end as ol, case when actual > 0 then -ln(their_p) else -ln(1 - their_p) end as tl from sh0)"""


def shared(spark, sf):
    games = pool(spark, sf)
    train = tuning.folds_of(games, HOLDOUTS)
    mean = rec.appearances(games).join(train.select("game_id", "season", "fold").distinct(), ["game_id", "season"]).groupBy("season", F.col("fold").alias("wk"), "team").agg(F.avg(F.col("pf") - F.col("pa")).alias("mean"))
    side = lambda c, m: mean.select("season", "wk", F.col("team").alias(c), F.col("mean").alias(m))
    margin = arena.safe_round(F.col("mh") - F.col("ma"), 1)
    theirs = games.join(side("home", "mh"), ["season", "wk", "home"]).join(side("away", "ma"), ["season", "wk", "away"]).select("season", "wk", "home", "away", margin.alias("margin"), F.greatest(F.lit(0.01), F.least(F.lit(0.99), arena.safe_round(1 / (1 + F.exp(-margin / 12.0)), 3))).alias("p")).distinct()
    return compare.shared_games(logged(spark, sf).withColumnRenamed("game_id", "through"), theirs, games)


@query(f"{WITH}, {SHARED} select season, wk, home, away, margin, their_margin, p, their_p, actual, ok as ours_ok, tok as theirs_ok from sh")
def shared_games(spark, sf):
    return shared(spark, sf).select("season", "wk", "home", "away", "margin", "their_margin", "p", "their_p", "actual", "ours_ok", "theirs_ok")


@query(f"{WITH}, {SHARED} select count(*) as n, count_if(ok and tok) as both_right, count_if(ok and not tok) as we_only, count_if(not ok and tok) as they_only, count_if(not ok and not tok) as both_wrong, {R('avg(cast(ok as double))', 4)} as our_accuracy, {R('avg(cast(tok as double))', 4)} as their_accuracy, {R('avg(ol)', 4)} as our_loss, {R('avg(tl)', 4)} as their_loss, {R('avg(abs(margin - actual))', 2)} as our_error, {R('avg(abs(their_margin - actual))', 2)} as their_error from sh")
def agreement(spark, sf):
    return compare.agreement(shared(spark, sf))


GAP = f"{SHARED}, gp as (select count(*) as n, count_if(ok and not tok) as b, count_if(not ok and tok) as c, avg(ol - tl) as loss_gap, stddev_samp(ol - tl) / sqrt(count(*)) as loss_se from sh)"


@query(f"{WITH}, {GAP} select n, b, c, {R('(b - c) / n', 4)} as gap, {R('sqrt(b + c) / n', 4)} as gap_se, {R('loss_gap', 4)} as loss_gap, {R('loss_se', 4)} as loss_se from gp")
def paired_gap(spark, sf):
    r = lambda c: arena.safe_round(F.col(c), 4).alias(c)
    return compare.paired_gap(shared(spark, sf)).select("n", "b", "c", r("gap"), r("gap_se"), r("loss_gap"), r("loss_se"))


CLOSE = f"{WITH}, close as (select season, wk, cast(count_if(hs - aw = 1) as bigint) as b, cast(count_if(aw - hs = 1) as bigint) as c from games group by all), exact as (select *, case when b + c = 0 then 1.0 else least(1.0, 2 * list_sum(list_transform(range(greatest(b, c), b + c + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0))))) end as p from close)"


def close_games(spark, sf):
    """(season, wk, b, c): games that home and away sides won by one point."""
    m = F.col("hs") - F.col("aw")
    return arena.dense_games(spark, sf).groupBy("season", "wk").agg(F.count_if(m == 1).alias("b"), F.count_if(m == -1).alias("c"))


@query(f"{CLOSE} select season, wk, b, c, {R('p', 6)} as p from exact")
def mcnemar(spark, sf):
    """The exact test of every week's narrow home wins against its narrow away wins."""
    return close_games(spark, sf).select("season", "wk", "b", "c", arena.safe_round(compare.binomial_p(F.col("b"), F.col("c")), 6).alias("p"))


@query(f"{CLOSE} select season, wk, case when round(p, 9) > 0.10 then 'indistinguishable' when round(p, 9) > 0.01 then 'leaning' else 'clear' end as by_p, case when b + c < 30 or abs(b - c) / sqrt(b + c) < 1.64 then 'indistinguishable' when abs(b - c) / sqrt(b + c) < 2.58 then 'leaning' else 'clear' end as by_z from exact")
def verdict(spark, sf):
    rows = close_games(spark, sf)
    p = F.round(compare.binomial_p(F.col("b"), F.col("c")), 9)
    return rows.select("season", "wk", compare.verdict_p(p).alias("by_p"), compare.verdict_z(F.col("b") - F.col("c"), F.sqrt(F.col("b") + F.col("c")), F.col("b") + F.col("c")).alias("by_z"))


# --- checks ------------------------------------------------------------------------------------------------------
DATED = "rs as (select g.*, cast(o_orderdate as date) as date from games g join orders o on o.o_orderkey = g.game_id // 100), rp as (select * from rs where season = 2000)"
TODAY = "date '2000-08-15'"


def dated(spark, sf):
    orders = arena.read(spark, sf, "orders").select(F.col("o_orderkey"), F.to_date("o_orderdate").alias("date"))
    games = arena.dense_games(spark, sf).filter("season = 2000").withColumn("o_orderkey", F.floor(F.col("game_id") / 100))
    return games.join(orders, "o_orderkey").drop("o_orderkey")


@query(f"with {ARENA_SQL}, {DATED} select game_id, wk from rp where wk > 26 and date < {TODAY}")
def overdue(spark, sf):
    return checks.overdue(dated(spark, sf).filter("wk > 26"), F.expr(TODAY)).select("game_id", "wk")


@query(f"with {ARENA_SQL}, {DATED}, o as (select wk, count(*) as overdue from rp where wk > 26 and game_id % 3 = 0 and date < {TODAY} group by wk), c as (select wk, count(*) as captured from rp where game_id % 3 <> 0 group by wk) select wk, overdue, coalesce(captured, 0) as captured, overdue >= 20 and overdue > 0.5 * (overdue + coalesce(captured, 0)) as fails from o left join c using (wk)")
def week_coverage(spark, sf):
    games = dated(spark, sf)
    return checks.week_coverage(games.filter("wk > 26 and game_id % 3 = 0"), games.filter("game_id % 3 <> 0"), F.expr(TODAY))


@query(f"with {ARENA_SQL}, {DATED} select wk, min(date) as first, max(date) as last from rp group by wk")
def week_spans(spark, sf):
    return checks.week_spans(dated(spark, sf))


@query(f"with {ARENA_SQL}, {DATED}, s as (select wk, min(date) as first, max(date) as last from (select case when game_id % 97 = 0 then wk + 1 else wk end as wk, date from rp) group by wk) select a.wk from s a join s b on b.wk = a.wk + 1 where a.last >= b.first")
def weeks_overlap(spark, sf):
    """With every 97th game filed under the week after its own."""
    late = dated(spark, sf).withColumn("wk", F.when(F.col("game_id") % 97 == 0, F.col("wk") + 1).otherwise(F.col("wk")))
    return checks.weeks_out_of_order(checks.week_spans(late))


@query(f"with {ARENA_SQL}, b as (select season, wk, unnest([home, away]) as team from played union all select season, wk, unnest([home, away]) from fixtures) select season, wk, team, count(*) as n from b group by season, wk, team having count(*) > 1")
def double_booked(spark, sf):
    games = arena.dense_games(spark, sf)
    return checks.double_booked(arena.played(games), arena.fixtures(games))


@query(f"with {ARENA_SQL}, b as (select unnest([home, away]) as team from played union all select unnest([home, away]) from fixtures) select team, count(*) as n, count(*) > 16 as too_many from b group by team")
def season_length(spark, sf):
    games = arena.dense_games(spark, sf)
    return checks.season_length(arena.played(games), arena.fixtures(games))


@query(f"with {ARENA_SQL} select team from roster where in_league and team not in (select unnest([home, away]) from played where wk <= 1)")
def no_games(spark, sf):
    return checks.no_games(arena.dense_roster(spark, sf), played(spark, sf).filter("wk <= 1"))


@query(f"with {ARENA_SQL}, {SIDES} select count(*) as broken from (select team, season from sides group by team, season having count_if(pf > pa) + count_if(pf < pa) + count_if(pf = pa) <> count(*))")
def record_check(spark, sf):
    return checks.record_sums(rec.records(arena.dense_games(spark, sf))).agg(F.count(F.lit(1)).alias("broken"))


@query(f"{WITH}, {FIT} select count(*) as teams, count_if(isnan(rating)) as not_finite, count_if(abs(rating) > 80) as out_of_reach, abs(avg(rating)) < 0.5 as centred from fit where team <> -1")
def rating_sanity(spark, sf):
    return checks.rating_sanity(season_fit(spark, sf))


@query(f"{WITH}, {FIT} select count(*) as n, max(k) as last, count(distinct k) as ranks, count_if(rating > above) as out_of_order from (select rating, k, lag(rating) over (order by k) as above from (select rating, row_number() over (order by round(rating, 9) desc, team) as k from fit join roster using (team) where in_league) x) y")
def rank_check(spark, sf):
    games = played(spark, sf)
    return checks.rank_gaps(rec.ranks(season_fit(spark, sf), arena.dense_roster(spark, sf), rec.records(games)))


@query(f"{WITH}, {PREDICTED} select count(*) as n, count_if(p <= 0 or p >= 1) as certain, count_if(p > 0.5 and shown < 0 or p < 0.5 and shown > 0) as signs, count_if(abs((h - a) - shown) > 1.1) as drifts, count_if(h in (1, 2, 4, 5, 11) or a in (1, 2, 4, 5, 11)) as implausible from shown join scored on id = game_id")
def schedule_checks(spark, sf):
    return checks.forecast_rows(predicted(spark, sf))


@query(f"{WITH}, {PREDICTED}, z as (select abs(1 / (1 + exp(-(shown / 1.4708) / greatest(3.0, least(20.0, sqrt(19.6807 + 82.7213 / greatest(behind, 1)))))) - p) as d from shown) select {R('max(d)', 3)} as worst, count_if(d > 0.01) as swapped from z")
def scale_swap(spark, sf):
    return checks.scale_swap(predicted(spark, sf), 1.4708).select(arena.safe_round(F.col("worst"), 3).alias("worst"), "swapped")


SQUASH = lambda m: f"1 / (1 + exp(-greatest(-49, least(49, {m})) / 9.0))"


@query(f"{WITH}, q as (select m, {SQUASH('m')} as y, {SQUASH('-m')} as back, {SQUASH('m + 1')} as next, {SQUASH('49')} as top from (select distinct 2 * (hs - aw) as m from games union select 0)) select bool_or(m = 0 and abs(y - 0.5) < 1e-12) as half_at_zero, max(abs(y + back - 1)) < 1e-12 as symmetric, bool_and(next >= y) as rising, bool_and(m <= 49 or abs(y - top) < 1e-12) as capped from q")
def squash_invariants(spark, sf):
    """Over twice every margin that was played, and 0."""
    margins = arena.dense_games(spark, sf).select((2 * (F.col("hs") - F.col("aw"))).alias("m")).union(spark.range(1).select(F.lit(0))).distinct()
    return checks.squash_invariants(margins, 9.0, 49.0)


@query(f"with {ARENA_SQL} select count(distinct team) as teams, (select count(*) from played) as games, count(distinct team) > 600 as enough_teams, (select count(*) from played) > 200 as enough_games from (select unnest([home, away]) as team from played)")
def coverage(spark, sf):
    games = played(spark, sf)
    rows = games.select("game_id", F.explode(F.array("home", "away")).alias("team")).agg(F.count_distinct("team").alias("teams"), F.count_distinct("game_id").alias("games"))
    return rows.select("teams", "games", (F.col("teams") > 600).alias("enough_teams"), (F.col("games") > 200).alias("enough_games"))


RATING_COUNTS = ["(select count_if(isnan(rating) or rating is null) from fit)", "(select count_if(team <> -1 and abs(rating) > 80) from fit)", "(select abs(avg(rating)) >= 0.5 from fit where team <> -1)", "(select count(*) <> 1 from fit where team = -1)", "(select count(*) from fit where team = -1 and rating not between -1 and 6)", "(select count(*) <= 600 from fit where team <> -1)"]
S = lambda cond: f"(select count(*) from shown join scored on id = game_id where {cond})"
FORECAST_COUNTS = [S("p <= 0 or p >= 1"), S("(p > 0.5 and shown < 0) or (p < 0.5 and shown > 0)"), S("h is null or a is null"), S("h < 0 or a < 0"), S("abs((h - a) - shown) > 1.1"), S("h in (1, 2, 4, 5, 11) or a in (1, 2, 4, 5, 11)"), S("abs(shown) >= 0.5 and not case when shown > 0 then h > a else h < a end"), S("p is null and status in ('rated', 'stand-in')"), S("p is null and h is not null"), S("home not in (select team from roster) or away not in (select team from roster)"), S("home = away"), S("exists (select 1 from played q where q.wk = shown.wk and q.home = shown.home and q.away = shown.away)"), "(select count(p) < 0.75 * count(*) from shown)"]
TEAM_SQL = f"""tg as (select team, count(*) as games, count_if(pf > pa) as w, count_if(pf < pa) as l, count_if(pf = pa) as t from psides group by team),
tf as (select team, sum(p) as more, count(*) as left_ from (select home as team, p from shown union all select away, 1 - p from shown) group by team),
rk as (select team, row_number() over (order by round(rating, 9) desc, team) as overall from fit join roster using (team) join tg using (team) where in_league and games > 0),
tt as (select r.team, r.in_league, coalesce(tg.games, 0) as games, coalesce(w, 0) as w, coalesce(l, 0) as l, coalesce(t, 0) as t, overall, coalesce(left_, 0) as left_, {R('coalesce(w, 0) + coalesce(more, 0)', 1)} as wins from roster r left join tg using (team) left join tf using (team) left join rk using (team)),
tl as (select *, {R('games - t + left_ - wins', 1)} as losses from tt)"""
T = lambda cond: f"(select count(*) from tl where {cond})"
TEAM_COUNTS = [T("w + l + t <> games"), T("least(w, l, t, games) < 0"), T("games = 0 and overall is not null"), T("in_league and games > 0 and overall is null"), "(select max(overall) <> count(overall) from tl)", "(select count(distinct overall) <> count(overall) from tl)", T("games + left_ > 16"), T("in_league and games = 0"), T("abs(wins + losses + t - games - left_) > 0.051"), T("wins < w - 0.051")]


@query(f"{WITH}, {PREDICTED}, {TEAM_SQL} " + with_counts(audit.rating_rules(), RATING_COUNTS) + " union all " + with_counts(audit.forecast_rules(), FORECAST_COUNTS) + " union all " + with_counts(audit.team_rules(), TEAM_COUNTS))
def check_report(spark, sf):
    """Ratings, forecasts and records under all their rules, one pass over each table."""
    games, rated, roster = played(spark, sf), cut(season_fit(spark, sf)), arena.dense_roster(spark, sf)
    told = cut(predicted(spark, sf))
    known = lambda c: roster.select(F.col("team").alias(c), F.lit(True).alias(f"{c}_known"))
    results = games.select("wk", "home", "away", F.lit(True).alias("was_played")).distinct()
    forecasts = told.join(known("home"), "home", "left").join(known("away"), "away", "left").join(results, ["wk", "home", "away"], "left")
    forecasts = forecasts.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("home_known", "away_known", "was_played")})
    record = rec.records(games)
    ranks = rec.ranks(rated, roster, record)
    left = told.select(F.explode(F.array("home", "away")).alias("team")).groupBy("team").agg(F.count(F.lit(1)).alias("left"))
    projected = forecast.project_records(record, told)
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("w", "l", "t", "games", "left")}
    # wins and losses of teams without a game or a fixture are none
    teams = roster.select("team", "in_league").join(record.select("team", "w", "l", "t", "games"), "team", "left").join(ranks.select("team", "overall"), "team", "left").join(left, "team", "left").join(projected, "team", "left").withColumns({**zero, "wins": F.coalesce("wins", F.lit(0.0)), "losses": F.coalesce("losses", F.lit(0.0))})
    return audit.audit(audit.rating_rules() + audit.forecast_rules() + audit.team_rules(), {"ratings": rated, "forecasts": forecasts, "teams": teams})
