"""Queries on readers and writers: the arena's tables written as the files that are read, and read back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..functions import extract
from ..sources import files
from . import arena, rendered
from .arena import ARENA_SQL
from .queries_ratings import ensure_cut
from .registry import registry
from .rendered import BOARD, CITY, FULL, SCHOOL

QUERIES, ORACLE_SQL, query = registry()
R = lambda x, n: f"round({x} + 1e-9, {n}) + 0.0"
DAY = "cast(make_date(season, 1, 1) + 7 * (wk - 1) as varchar)"


def folder(spark, name: str) -> str:
    ensure_cut(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid4().hex}"


def text_file(spark, name: str, lines) -> str:
    path = folder(spark, name)
    lines.write.text(path)
    return path


def csv_file(spark, name: str, rows) -> str:
    path = folder(spark, name)
    files.write_csv(rows, path)
    return path


def game_file(spark, sf):
    """Games as a results file has them: every 13th without a week, every 17th without a score, states as they are typed."""
    c, g = F.col, F.col("game_id")
    wk, score = F.when(g % 13 == 0, "x").otherwise(c("wk").cast("string")), F.when(g % 17 == 0, "").otherwise(c("aw").cast("string"))
    full = rendered.full_name
    return csv_file(spark, "games", arena.dense_games(spark, sf).select(wk.alias("week"), rendered.day(c("season"), c("wk")).alias("date"), full(c("away")).alias("away"), score.alias("away_score"), full(c("home")).alias("home"), c("hs").alias("home_score"), F.when(c("neutral"), "1").otherwise("").alias("neutral"), F.when(c("away") % 9 == 0, " pa").otherwise("").alias("away_state")))


@query(f"with {ARENA_SQL} select wk, {DAY} as date, {FULL('away')} || case when away % 9 = 0 then ' [PA]' else '' end as away, aw, {FULL('home')} as home, hs, neutral from games where game_id % 13 <> 0 and game_id % 17 <> 0")
def scan_csv_games(spark, sf):
    return files.read_games(spark, game_file(spark, sf))


@query(f"with {ARENA_SQL} select 1 as wk, {FULL('away')} as away, aw, {FULL('home')} as home, hs, false as neutral from games where season = 2000 and game_id % 13 <> 0 and game_id % 17 <> 0")
def scan_psv(spark, sf):
    """A season as lines with pipes, every 13th of another shape, every 17th without a score."""
    c, g = F.col, F.col("game_id")
    whole = F.concat_ws("|", rendered.full_name(c("away")), F.when(g % 17 == 0, "").otherwise(c("aw").cast("string")), rendered.full_name(c("home")), c("hs").cast("string"))
    lines = arena.dense_games(spark, sf).filter("season = 2000").select(F.when(g % 13 == 0, "a|b|c").otherwise(whole).alias("value"))
    return files.read_pipe_games(spark, text_file(spark, "pipe", lines))


@query(f"with {ARENA_SQL} select wk, case game_id % 4 when 0 then '7pm' when 1 then '6:45pm' when 2 then 'noon' else '' end as time, {FULL('away')} as away, {FULL('home')} as home, neutral from fixtures where game_id % 13 <> 0")
def scan_schedule(spark, sf):
    """Coming games as a fixtures file, every 13th without a week; and a file that is not there, which is no fixture."""
    c, g = F.col, F.col("game_id")
    rows = arena.fixtures(arena.dense_games(spark, sf)).select(F.when(g % 13 == 0, "?").otherwise(c("wk").cast("string")).alias("week"), rendered.day(c("season"), c("wk")).alias("date"), rendered.clock(g).alias("time"), rendered.full_name(c("away")).alias("away"), rendered.full_name(c("home")).alias("home"), F.when(c("neutral"), "1").otherwise("0").alias("neutral"))
    path = csv_file(spark, "fixtures", rows)
    return files.read_fixtures(spark, path).unionByName(files.read_fixtures(spark, path + "-not-there")).select("wk", F.coalesce("time", F.lit("")).alias("time"), "away", "home", "neutral")


@query(f"with {ARENA_SQL} select {FULL('team')} as name, coalesce(division, '') as division, region, cast(team % 11 as int) as w, cast(team % 5 as int) as l, case when team % 7 = 0 then 1 else 0 end as t, team % 900 / 8.0::double as points from roster")
def scan_csv_roster(spark, sf):
    t = F.col("team")
    record = F.concat((t % 11).cast("string"), F.lit("-"), (t % 5).cast("string"), F.when(t % 7 == 0, "-1").otherwise(""))
    rows = arena.dense_roster(spark, sf).select(rendered.full_name(t).alias("name"), rendered.school(t).alias("school"), rendered.city(t).alias("city"), t.alias("school_id"), "division", "region", record.alias("record"), F.format_string("%.4f", t % 900 / 8.0).alias("harbin"))
    return files.read_roster(spark, csv_file(spark, "roster", rows)).select("name", F.coalesce("division", F.lit("")).alias("division"), "region", "w", "l", "t", "points")


def log_lines(spark, sf):
    """A forecast log: one line for each week of a season, its games of the week after; forecasts of five or seven elements; weeks of nine are broken off."""
    c, g = F.col, F.col("game_id")
    text = lambda x: F.concat(F.lit('"'), x.cast("string"), F.lit('"'))
    five = [text(c("home")), text(c("away")), c("wk").cast("string"), (c("hs") - c("aw")).cast("double").cast("string"), ((g % 90 + 5) / 100).cast("string")]
    pred = F.concat(F.lit("["), F.concat_ws(",", *five), F.when(g % 2 == 0, ",20,21").otherwise(""), F.lit("]"))
    # every game is a line's; lines of one week are several, so none grows with the table
    rows = arena.dense_games(spark, sf).select("season", (c("wk") - 1).alias("through"), F.floor(g / rendered.PAGE_KEYS).alias("part"), pred.alias("pred"))
    line = rows.groupBy("season", "through", "part").agg(F.array_join(F.collect_list("pred"), ",").alias("preds"))
    whole = F.concat(F.lit('{"season":'), c("season").cast("string"), F.lit(',"throughWeek":'), c("through").cast("string"), F.when(c("through") % 2 == 0, ',"kind":"backtest"').otherwise(""), F.lit(',"pred":['), c("preds"), F.lit("]}"))
    return line.select(F.when(c("through") % 9 == 0, F.substring(whole, 1, 25)).otherwise(whole).alias("value"))


@query(f"with {ARENA_SQL} select season, wk - 1 as through, case when (wk - 1) % 2 = 0 then 'backtest' else 'live' end as kind, cast(home as varchar) as home, cast(away as varchar) as away, wk, cast(hs - aw as double) as margin, (game_id % 90 + 5) / 100.0::double as p from games where (wk - 1) % 9 <> 0")
def scan_history(spark, sf):
    path = text_file(spark, "log", log_lines(spark, sf))
    return files.forecasts(files.read_log(spark, path).unionByName(files.read_log(spark, path + "-not-there")))


@query(f"with {ARENA_SQL} select count(*) as games, cast(sum(hs) as bigint) as points from played")
def sink_roundtrip(spark, sf):
    """Played games committed twice as a version of a table, and read back from the one that stands."""
    path, games = folder(spark, "sink"), arena.played(arena.dense_games(spark, sf))
    files.write_guarded(games, path)
    files.write_guarded(games, path)
    return files.read_current(spark, path, games.schema.simpleString()[7:-1].replace(":", " ")).agg(F.count(F.lit(1)).alias("games"), F.sum(F.col("hs").cast("long")).alias("points"))


@query(f"with {ARENA_SQL} select neutral, count(*) as games, cast(sum(hs) as bigint) as points from games where game_id % 13 <> 0 and game_id % 17 <> 0 group by neutral")
def sink_csv(spark, sf):
    """A results file read, written as CSV by the library, and read again."""
    first = files.read_games(spark, game_file(spark, sf))
    back = first.select(F.col("wk").alias("week"), "date", "away", F.col("aw").alias("away_score"), "home", F.col("hs").alias("home_score"), F.col("neutral").cast("int").alias("neutral"))
    return files.read_games(spark, csv_file(spark, "again", back)).groupBy("neutral").agg(F.count(F.lit(1)).alias("games"), F.sum(F.col("hs").cast("long")).alias("points"))


SHRUNK = f"{ARENA_SQL}, n as (select season, home % 5 as club, count_if(wk <= 52) as before, count_if(wk <= 12 * (home % 5)) as n from games group by all)"


@query(f"with {SHRUNK} select season, club, n, before, case when n = 0 then 'no games' when before > 50 and n < 0.8 * before then 'far fewer games than before' end as games, case when before > 50 and n = 0 then 'all fixtures gone' end as fixtures from n")
def write_guard(spark, sf):
    """What the guard says of seasons of which only the first weeks are left."""
    rows = arena.dense_games(spark, sf).groupBy("season", (F.col("home") % 5).alias("club")).agg(F.count_if(F.col("wk") <= 52).alias("before"), F.count_if(F.col("wk") <= 12 * (F.col("home") % 5)).alias("n"))
    return rows.select("season", "club", "n", "before", *[files.verdict(F.col("n"), F.col("before"), k).alias(k) for k in ("games", "fixtures")])


@query(f"with {ARENA_SQL} select season, count(*) as n from games group by season")
def season_of_file(spark, sf):
    """Each season in a file of its own name, which says the season when all are read."""
    games, path = arena.dense_games(spark, sf), folder(spark, "seasons")
    games.select("game_id", F.concat(F.lit("games_"), F.col("season").cast("string")).alias("file")).write.partitionBy("file").parquet(path)
    read = spark.read.parquet(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("file"))
    return read.groupBy(files.season_of(F.col("file")).alias("season")).agg(F.count(F.lit(1)).alias("n"))


@query("with s as (select page_id, case page_id % 5 when 0 then 500 when 1 then 502 when 2 then 404 when 3 then 200 end as status from pages) select page_id, status, status is null or status >= 500 as again, case when status is null or status >= 500 then '1.5,3.0' else '' end as waits from s")
def retry_policy(spark, sf):
    """What is done about each page, had it been answered by one of five statuses."""
    k = F.col("page_id") % 5
    rows = arena.read(spark, sf, "pages").select("page_id", F.when(k == 0, 500).when(k == 1, 502).when(k == 2, 404).when(k == 3, 200).alias("status"))
    return rows.select("page_id", "status", files.retries(F.col("status")).alias("again"), F.array_join(files.waits(F.col("status")).cast("array<string>"), ",").alias("waits"))


@query(f"with {BOARD} select f.wk, {FULL('f.away')} as away, {FULL('f.home')} as home from fixtures f where not exists (select 1 from games g where g.season = 2000 and g.game_id % 5 = 0 and g.wk = f.wk and g.away = f.away and g.home = f.home)")
def fixtures_unplayed(spark, sf):
    """Coming games without those that a results file already has, by week and names."""
    games, full = arena.dense_games(spark, sf), rendered.full_name
    results = games.filter("season = 2000 and game_id % 5 = 0").select("wk", F.upper(full(F.col("away"))).alias("away"), full(F.col("home")).alias("home"))
    return extract.unplayed(arena.fixtures(games).select("wk", full(F.col("away")).alias("away"), full(F.col("home")).alias("home")), results)


@query(f"with {ARENA_SQL} select case when game_id % 2 = 0 then 'a' else 'b' end as source, season, wk, {FULL('home')} as home, {FULL('away')} as away, cast(hs - aw as int) as home_margin, (game_id % 99 + 1) / 100.0::double as home_p from games where wk % 10 <> 0")
def scan_rivals(spark, sf):
    """Rivals' logs, a line a week; those of every tenth week are broken off."""
    c, g = F.col, F.col("game_id")
    pick = F.to_json(F.struct(rendered.full_name(c("home")).alias("home"), rendered.full_name(c("away")).alias("away"), (c("hs") - c("aw")).alias("homeMargin"), ((g % 99 + 1) / 100).alias("homeProb")))
    rows = arena.dense_games(spark, sf).select(F.when(g % 2 == 0, "a").otherwise("b").alias("source"), "season", "wk", F.floor(g / rendered.PAGE_KEYS).alias("part"), pick.alias("pick"))
    line = rows.groupBy("source", "season", "wk", "part").agg(F.array_join(F.collect_list("pick"), ",").alias("picks"))
    whole = F.concat(F.lit('{"source":"'), c("source"), F.lit('","season":'), c("season").cast("string"), F.lit(',"week":'), c("wk").cast("string"), F.lit(',"picks":['), c("picks"), F.lit("]}"))
    path = text_file(spark, "rivals", line.select(F.when(c("wk") % 10 == 0, F.substring(whole, 1, 30)).otherwise(whole).alias("value")))
    log = files.read_log(spark, path, files.RIVALS).select("source", "season", F.col("week").alias("wk"), F.explode("picks").alias("p"))
    return log.select("source", "season", "wk", "p.home", "p.away", F.col("p.homeMargin").alias("home_margin"), F.col("p.homeProb").alias("home_p"))


@query(f"with {ARENA_SQL}, b as (select region, division, team, s_acctbal from roster join supplier on s_suppkey = team where in_league) select region, 'division' as kind, division as name, {R('avg(s_acctbal / 1000)', 3)} as value from b group by region, division union all select region, 'school', cast(team as varchar), {R('s_acctbal / 1000', 3)} from b")
def fit_prior(spark, sf):
    """Priors as they are kept: one JSON document of many lines for each region; one that is not there gives no rows."""
    roster = arena.dense_roster(spark, sf).filter("in_league").join(arena.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("team"), (F.col("s_acctbal") / 1000).alias("dev")), "team")
    effects = roster.groupBy("region", "division").agg(arena.safe_round(F.avg("dev"), 3).alias("effect")).groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("division", "effect"))).alias("divisionEffects"))
    devs = roster.groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("school_id", arena.safe_round(F.col("dev"), 3)))).alias("prior"))
    document = F.to_json(F.struct(F.struct(F.col("region").alias("season"), F.lit(0.6).alias("carry")).alias("meta"), "divisionEffects", "prior"))
    lines = effects.join(devs, "region").select(F.regexp_replace(document, ",", ",\n  ").alias("value"), "region")
    path = folder(spark, "prior")
    # a file for each document
    lines.repartition("region").write.partitionBy("region").text(path)
    stored = spark.read.schema(files.PRIOR).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    document = stored.unionByName(files.read_document(spark, path + "-not-there", files.PRIOR))
    effects, devs = files.prior_table(document)
    return effects.select("season", F.lit("division").alias("kind"), F.col("division").alias("name"), F.col("effect").alias("value")).unionByName(devs.select("season", F.lit("school").alias("kind"), F.col("school_id").alias("name"), F.col("dev").alias("value"))).withColumnRenamed("season", "region")


@query(f"with {ARENA_SQL} select distinct season from games where season % 4 = 0 or season % 3 <> 2")
def parser_stamp(spark, sf):
    """Seasons read by an older parser, or never stamped, are read again."""
    seasons = arena.dense_games(spark, sf).select("season").distinct()
    return files.stale(seasons, seasons.filter("season % 4 <> 0").select("season", (F.col("season") % 3 + 2).alias("version")), 4)


@query(f"with {ARENA_SQL} select season, wk - 1 as through, case when (wk - 1) % 2 = 0 then 'backtest' else 'live' end as kind, count(*) as n from games where (wk - 1) % 9 <> 0 group by all")
def log_append(spark, sf):
    """The log of all seasons, appended to in two writes, read back."""
    log = files.read_log(spark, text_file(spark, "log", log_lines(spark, sf)))
    path = folder(spark, "appended")
    for part in ("season < 1996", "season >= 1996"):
        files.append_log(log.filter(part), path)
    return files.forecasts(files.read_log(spark, path)).groupBy("season", "through", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {ARENA_SQL} select season, count(*) as n from games where (wk - 1) % 9 <> 0 and (wk - 1) % 2 = 0 group by season")
def log_rewrite(spark, sf):
    """A log rewritten as a new version without its live lines, which readers see at one stroke."""
    path = folder(spark, "rewritten")
    log = files.read_log(spark, text_file(spark, "log", log_lines(spark, sf)))
    files.commit(spark, path, files.stage(log, path, "json"))
    kept = files.read_current(spark, path, files.SNAPSHOT, "json").filter("kind = 'backtest'")
    files.commit(spark, path, files.stage(kept, path, "json"))
    return files.forecasts(files.read_current(spark, path, files.SNAPSHOT, "json")).groupBy("season").agg(F.count(F.lit(1)).alias("n"))
