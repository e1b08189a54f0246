"""Queries on identity: the dense arena under shared names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import identity as ident
from . import arena
from .arena import SPARSE_SQL
from . import rendered
from .arena import ARENA_SQL
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()
R = lambda c, n: f"round({c} + 1e-9, {n}) + 0.0"

#: Names of the sparse arena: two in three are one customer's own, the others are shared by two or three.
NAME = "'N' || cast(case when k % 3 = 0 then k % 600 else k end as varchar)"
NAMED = f"""{SPARSE_SQL}, rosters as (select {NAME.replace('k', 'c_custkey')} as name, cast(c_custkey as varchar) as school_id, case when c_nationkey <> 24 then (['I','II','III','IV','V','VI','VII'])[c_nationkey % 7 + 1] end as division, cast(n_regionkey + 1 as int) as region from customer join nation on c_nationkey = n_nationkey where c_custkey % 11 <> 0),
ng as (select season, wk, game_id, {NAME.replace('k', 'home')} as home, {NAME.replace('k', 'away')} as away from sparse where season = 2000),
ap as (select season, wk, game_id, 0 as seq, home as name, away as opp from ng union all select season, wk, game_id, 1, away, home from ng),
mo as (select name, max(k) as most from (select name, season, wk, count(*) as k from ap group by name, season, wk) group by name), sl as (select name, count(*) as slots, min(division) as division, min(region) as region from rosters group by name),
cl0 as (select coalesce(mo.name, sl.name) as name, coalesce(slots, 0) as slots, coalesce(most, 0) as most, division, region from mo full outer join sl on sl.name = mo.name),
cl as (select *, case when slots = 0 and most <= 1 then 'outside' when slots = 0 then 'outside, several' when most <= 1 and slots = 1 then 'one' when most <= 1 then 'ambiguous' else 'deferred' end as class from cl0),
rg as (select cl.name, r.region from cl join rosters r using (name) where class = 'one' and r.region is not null),
co0 as (select a.region as ra, b.region as rb, count(*) as n from ng join rg a on a.name = home join rg b on b.name = away group by a.region, b.region),
co as (select ra, rb, cast(sum(n) as bigint) as n from (select * from co0 union all select rb, ra, n from co0) group by ra, rb)"""


def name_of(c):
    return F.concat(F.lit("N"), F.when(c % 3 == 0, c % 600).otherwise(c).cast("string"))


def tables(spark, sf):
    games = arena.sparse_games(spark, sf).filter("season = 2000").select("season", "wk", "game_id", name_of(F.col("home")).alias("home"), name_of(F.col("away")).alias("away"))
    roster = arena.sparse_roster(spark, sf).filter("team % 11 <> 0").withColumn("name", name_of(F.col("team")))
    apps = ident.named_appearances(games)
    return games, roster, apps, ident.classes(apps, roster)


@query(f"with {ARENA_SQL} select team, {rendered.SCHOOL('team')} || case when team % 3 = 0 then ' [NJ]' else '' end as identity from roster")
def team_identity(spark, sf):
    """Names and states as they are typed: with spaces, without a state, and without anything."""
    t = F.col("team")
    state = F.when(t % 3 == 0, " nj ").when(t % 3 == 1, "")
    return arena.dense_roster(spark, sf).select("team", ident.team_identity(F.concat(F.lit("  "), rendered.school(t), F.lit("  ")), state).alias("identity"))


@query(f"with {NAMED} select name, slots, most, greatest(most, slots, 1) as n, class, case class when 'outside' then 'OOS::' || name when 'one' then name || '|' || coalesce(division, 'None') || '-' || region when 'ambiguous' then name || '|?' end as id from cl")
def resolve_class(spark, sf):
    return tables(spark, sf)[3]


@query(f"with {NAMED} select season, game_id, seq, name, row_number() over (partition by name order by game_id, seq) - 1 as nth, least(row_number() over (partition by name, season, wk order by game_id, seq) - 1, greatest(most, slots, 1) - 1) as entity from ap join cl using (name)")
def spread(spark, sf):
    _, _, apps, settled = tables(spark, sf)
    return apps.join(settled.select("name", "n"), "name").select("season", "game_id", "seq", "name", F.col("nth").cast("long").alias("nth"), ident.spread(F.col("place"), F.col("n")).cast("long").alias("entity"))


@query(f"with {NAMED} select ra, rb, n from co")
def region_cooc(spark, sf):
    games, roster, _, settled = tables(spark, sf)
    return ident.region_counts(games, ident.settled_regions(settled, roster))


@query(f"with {NAMED}, t as (select ra, sum(n) as total from co group by ra) select t.ra, cast(r as int) as rb, {R('ln((coalesce(n, 0) + 0.5) / (total + 0.5 * 28))', 5)} as log_p from t cross join range(1, 29) x(r) left join co on co.ra = t.ra and co.rb = r")
def region_logp(spark, sf):
    games, roster, _, settled = tables(spark, sf)
    return ident.region_log_p(ident.region_counts(games, ident.settled_regions(settled, roster))).select("ra", "rb", arena.safe_round(F.col("log_p"), 5).alias("log_p"))


def assigned(spark, sf):
    games, roster, apps, settled = tables(spark, sf)
    return ident.assign(apps, settled, roster, ident.region_log_p(ident.region_counts(games, ident.settled_regions(settled, roster))))


#: Every order of a week's appearances among at most six entities, its score, and the best of them; then the ids.
ORDERS = f"""{NAMED}, tot as (select ra, sum(n) as total from co group by ra),
lp as (select tot.ra, cast(r as int) as rb, ln((coalesce(n, 0) + 0.5) / (total + 0.5 * 28)) as lp from tot cross join range(1, 29) x(r) left join co on co.ra = tot.ra and co.rb = r),
full_cl as (select name, slots, most, greatest(most, slots, 1) as n, class from cl), d as (select name, n from full_cl where class = 'deferred'),
perms(n, p) as (select cast(r as bigint), cast([] as bigint[]) from range(1, 7) x(r) union all select n, list_append(p, v) from perms, range(0, 6) y(v) where len(p) < n and v < n and not list_contains(p, v)),
slt as (select name, school_id, division, region, row_number() over (partition by name order by school_id, region, division) - 1 as k from rosters where name in (select name from d)),
one as (select c.name, r.region from full_cl c join rosters r using (name) where c.class = 'one'),
pl as (select ap.*, d.n, row_number() over (partition by ap.name, season, wk order by game_id, seq) - 1 as place, one.region as opp_region from ap join d using (name) left join one on one.name = ap.opp),
wks as (select name, season, wk, n, count(*) as m from pl group by all),
cell as (select w.name, w.season, w.wk, pm.p, pl.place, coalesce(lp.lp, 0.0) as lp from wks w join perms pm on pm.n = w.n and len(pm.p) = least(w.n, w.m) join pl on pl.name = w.name and pl.season = w.season and pl.wk = w.wk and pl.place < len(pm.p) left join slt on slt.name = w.name and slt.k = pm.p[pl.place + 1] left join lp on lp.ra = slt.region and lp.rb = pl.opp_region),
sc as (select name, season, wk, p, sum(lp) as score from cell group by all),
rk as (select *, row_number() over (partition by name, season, wk order by round(score, 8) desc, p) as k, count(*) over (partition by name, season, wk) as c, max(score) over (partition by name, season, wk) as top from sc),
picked as (select name, season, wk, any_value(p) filter (where k = 1) as p, case when any_value(c) > 1 then any_value(score) filter (where k = 1) - any_value(score) filter (where k = 2) end as gap from rk group by name, season, wk),
ent as (select name, k, base || case when b > 1 then '#' || b else '' end as id, division, region from (select *, row_number() over (partition by name, base order by k) as b from (select *, name || '|' || coalesce(division, 'None') || '-' || coalesce(cast(region as varchar), 'None') as base from slt) z) y
 union all select name, k, 'OOS::' || name || '#' || (k + 1), null, null from (select d.name, unnest(range(c.slots, c.n)) as k from d join full_cl c using (name)) u),
sure as (select name, count(gap) as weeks, coalesce(avg(gap), 0.0) as mean_gap, round(coalesce(avg(gap), 0.0), 9) >= 1.0 as confident from picked group by name)"""


@query(f"with recursive {ORDERS} select name, season, wk, array_to_string(p, ',') as order, {R('gap', 5)} as gap from picked".replace("as order,", 'as "order",'))
def assign_perm(spark, sf):
    return assigned(spark, sf).select("name", "season", "wk", F.concat_ws(",", F.col("order").cast("array<string>")).alias("order"), arena.safe_round(F.col("gap"), 5).alias("gap"))


@query(f"with recursive {ORDERS} select name, weeks, {R('mean_gap', 4)} as mean_gap, confident from sure")
def assign_confidence(spark, sf):
    """How sure the split of each shared name is over its season."""
    return ident.confidence(assigned(spark, sf)).select("name", "weeks", arena.safe_round(F.col("mean_gap"), 4).alias("mean_gap"), "confident")


@query(f"with recursive {ORDERS} select name, case class when 'ambiguous' then 'ambiguous' else 'oos-duplicate' end as kind, cast(n as bigint) as n from full_cl where class in ('ambiguous', 'outside, several') union all select name, 'low-confidence', cast(n as bigint) from d where name not in (select name from sure where confident)")
def identity_conflicts(spark, sf):
    return ident.conflicts(tables(spark, sf)[3], ident.confidence(assigned(spark, sf)))


@query(f"with recursive {ORDERS}, r as (select name, min(division) as division, min(region) as region, count(distinct division) as nd, count(distinct region) as nr from rosters group by name) select case class when 'outside' then 'OOS::' || c.name when 'one' then c.name || '|' || coalesce(division, 'None') || '-' || region else c.name || '|?' end as id, c.name, case when class = 'one' or nd = 1 then division end as division, case when class = 'one' or nr = 1 then region end as region, class <> 'outside' as in_league, class = 'ambiguous' as ambiguous from full_cl c left join r using (name) where class in ('outside', 'one', 'ambiguous') union all select 'OOS::' || name || '#' || k, name, null, null, false, true from (select name, unnest(range(1, cast(n as bigint) + 1)) as k from full_cl where class = 'outside, several') z union all select id, ent.name, division, region, not starts_with(id, 'OOS::'), starts_with(id, 'OOS::') or not coalesce(confident, false) from ent left join sure using (name)")
def resolved_teams(spark, sf):
    _, roster, _, settled = tables(spark, sf)
    return ident.teams(settled, roster, ident.confidence(assigned(spark, sf)))


@query(f"with recursive {ORDERS}, pa as (select season, wk, game_id, seq, name, row_number() over (partition by name, season, wk order by game_id, seq) - 1 as place from ap), ids as (select pa.*, case class when 'outside' then 'OOS::' || pa.name when 'one' then pa.name || '|' || coalesce(r.division, 'None') || '-' || r.region when 'ambiguous' then pa.name || '|?' when 'outside, several' then 'OOS::' || pa.name || '#' || (least(place, n - 1) + 1) else ent.id end as id from pa join full_cl c using (name) left join (select name, min(division) as division, min(region) as region from rosters group by name) r using (name) left join picked k on k.name = pa.name and k.season = pa.season and k.wk = pa.wk left join ent on ent.name = pa.name and ent.k = coalesce(k.p[place + 1], least(place, n - 1))) select season, wk, game_id, max(case when seq = 0 then id end) as home, max(case when seq = 1 then id end) as away from ids group by all")
def resolve_games(spark, sf):
    games, roster, apps, settled = tables(spark, sf)
    return ident.resolve_games(games, apps, settled, assigned(spark, sf), roster)


@query(f"with {NAMED} select count(*) as games from ng")
def resolved_count(spark, sf):
    """Resolving loses no game and makes none."""
    games, roster, apps, settled = tables(spark, sf)
    return ident.resolve_games(games, apps, settled, assigned(spark, sf), roster).agg(F.count(F.lit(1)).alias("games"))
