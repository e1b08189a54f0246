"""Queries on text extraction: the arena's tables rendered as pages and read back, and the pages and documents tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import extract as x
from ..operators.lineage import cut
from . import arena, rendered
from .arena import ARENA_SQL
from .rendered import BOARD, CITY, CLEAN, CUT_CITY, CUT_SCHOOL, FULL, PAGE_TEAMS, PICKED, RANKED, SCHOOL, SHORT, STATE
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()
PAGE = ["season", "wk", "part"]


def parsed(spark, sf):
    # pages are parsed once, by long patterns, and read by several filters
    return cut(x.parse_records(x.page_records(rendered.scoreboards(spark, sf)).drop("flat")))


@query(f"with {BOARD} select season, wk, day as date, clock as time, {CLEAN('away')} as away, {STATE('away')} as away_state, aw as ascore, {CLEAN('home')} as home, {STATE('home')} as home_state, hs as hscore, neutral from good")
def scrape_week(spark, sf):
    """The results of every week's pages: repeats, self-games, scores out of reach and called-off games left out."""
    return x.week_games(parsed(spark, sf), PAGE).select("season", "wk", "date", "time", "away", "away_state", "ascore", "home", "home_state", "hscore", "neutral")


@query(f"with {BOARD} select season, wk, {CLEAN('away')} as away, {STATE('away')} as away_state, {CLEAN('home')} as home, {STATE('home')} as home_state, clock as time, neutral from coming")
def scrape_schedule(spark, sf):
    return x.week_fixtures(parsed(spark, sf), PAGE).select("season", "wk", "away", "away_state", "home", "home_state", "time", "neutral")


@query(f"with {BOARD} select season, wk, case kind when 0 then 'called off' when 1 then 'fixture' when 6 then 'fixture' when 5 then 'unrecognised' else 'game' end as kind, cast(sum(case when kind = 2 then 2 else 1 end) as bigint) as n from board group by all")
def parse_records(spark, sf):
    return parsed(spark, sf).groupBy("season", "wk", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {BOARD} select season, wk, {CLEAN('away')} as away, {CLEAN('home')} as home, count(*) as n from board where kind = 0 group by all")
def parse_called_off(spark, sf):
    return parsed(spark, sf).filter("kind = 'called off'").groupBy("season", "wk", "away", "home").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {BOARD}, n as (select *, row_number() over (partition by game_id % 2 order by season, wk, part, game_id) as k, day || case when game_id % 2 = 0 then ' idle week for all' else ' no report of 12' end as record from board where kind = 5) select case when game_id % 2 = 0 then '<DATE> w' else '<DATE> w #' end as shape, count(*) as n, string_agg(case when k <= 2 then record end, '|' order by k) as samples from n group by 1")
def probe_shapes(spark, sf):
    found = x.probe(parsed(spark, sf), [*PAGE, "pos"])
    return found.select("shape", "n", F.array_join("samples", "|").alias("samples"))


@query(f"with {BOARD} select season, wk, part, count_if(kind = 5) as residual, count_if(kind = 0) as called_off, count_if(kind = 6) as placeholders from board group by all")
def residual_count(spark, sf):
    """What no pattern claimed, games called off and places held by nobody, by page."""
    return x.placeholders(parsed(spark, sf), PAGE)


@query(f"with {BOARD}, one as (select season, wk, count_if(kind = 1 or kind = 2 or kind > 6) as found from board where home % 20 = 7 group by all), every as (select season, wk, coalesce(found, 0) as found from (select season, unnest(range(1, last + 1)) as wk from (select season, max(wk) as last from one group by season)) left join one using (season, wk)), e as (select *, min(case when found = 0 then wk end) over (partition by season) as last from every) select season, cast(wk as int) as wk, coalesce(wk = last, false) as stop from e where last is null or wk <= last")
def week_stop(spark, sf):
    """A few clubs' pages week by week: reading ends at the first week of a season with neither games nor fixtures."""
    games = arena.dense_games(spark, sf).filter("home % 20 = 7").select("game_id")
    rows = parsed(spark, sf).filter("kind in ('game', 'fixture')").filter(x.plausible(F.col("home")) & (F.lower("home") != F.lower("away")) & ~x.placeholder(F.col("away")) & (F.coalesce("ascore", F.lit(0)) <= 120))
    mine = arena.dense_roster(spark, sf).filter("team % 20 = 7").select(F.when(F.col("team") % 11 == 0, rendered.school(F.col("team"))).otherwise(rendered.full_name(F.col("team"))).alias("home"))
    found = rows.join(mine, "home", "left_semi").groupBy("season", "wk").agg(F.count(F.lit(1)).alias("found"))
    every = arena.dense_games(spark, sf).join(games, "game_id", "left_semi").groupBy("season").agg(F.max("wk").alias("last")).select("season", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("wk"))
    return x.weeks_read(every.join(found, ["season", "wk"], "left").withColumn("found", F.coalesce("found", F.lit(0).cast("bigint"))), ["season"])


@query(f"with {ARENA_SQL} select team, {CLEAN('team')} as name, {STATE('team')} as state from roster")
def team_name_norm(spark, sf):
    name, state = x.team_name(F.col("raw"))
    rows = arena.dense_roster(spark, sf).select("team", rendered.raw_name(F.col("team")).alias("raw"))
    return rows.select("team", name.alias("name"), state.alias("state"))


NAMES_SQL = "select p_name as name from part union all select c_mktsegment from customer union all select text from documents union all select case when p_partkey % 2 = 0 then 'TBA' else 'Week ' || p_partkey end from part"
JUNKY = " or ".join(f"contains(lower(name), '{w}')" for w in x.JUNK)


@query(f"with n as ({NAMES_SQL}), p as (select coalesce(length(name) between 2 and 80 and regexp_matches(name, '[A-Za-z]') and len(string_split_regex(trim(name), '\\s+')) <= 12 and not ({JUNKY}), false) as plausible, coalesce(regexp_full_match(trim(name), '(?i)TBA|TBD|OPEN|BYE|Non[- ]varsity(\\s+opponent)?'), false) as placeholder from n) select plausible, placeholder, count(*) as n from p group by all")
def plausible_team(spark, sf):
    """What might be a team's name among part names, market segments, whole documents and headings."""
    part = arena.read(spark, sf, "part")
    names = part.select(F.col("p_name").alias("name")).union(arena.read(spark, sf, "customer").select("c_mktsegment")).union(arena.read(spark, sf, "documents").select("text")).union(part.select(F.when(F.col("p_partkey") % 2 == 0, "TBA").otherwise(F.concat(F.lit("Week "), F.col("p_partkey").cast("string")))))
    return names.select(x.plausible(F.col("name")).alias("plausible"), F.coalesce(x.placeholder(F.col("name")), F.lit(False)).alias("placeholder")).groupBy("plausible", "placeholder").agg(F.count(F.lit(1)).alias("n"))


STRIP = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<head\b[^>]*>.*?</head\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g'))".replace('\\"', '"')


@query(f"select page_id, md5({STRIP}) as digest, length({STRIP}) as n from pages")
def flat_text(spark, sf):
    flat = x.flat_text(F.col("html"))
    return arena.read(spark, sf, "pages").select("page_id", F.md5(flat).alias("digest"), F.length(flat).cast("bigint").alias("n"))


BREAKS = r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|tr|table|article|section|nav|footer|header|br|body|html)\b[^>]*>"
SILENT = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<head\b[^>]*>.*?</head\s*>"


@query(f"""with c as (select page_id, string_split(regexp_replace(regexp_replace(html, '{SILENT}', chr(10), 'g'), '{BREAKS}', chr(1), 'g'), chr(1)) as parts from pages),
l as (select page_id, unnest(parts) as html, unnest(range(len(parts))) as k from c), s as (select page_id, k, {STRIP} as line from l), f as (select page_id, line, min(k) as k from s where line <> '' group by page_id, line)
select page_id, cast(row_number() over (partition by page_id order by k) - 1 as int) as pos, line from f""")
def page_lines(spark, sf):
    """Each line of each page, by its place among the page's distinct lines."""
    return arena.read(spark, sf, "pages").select("page_id", F.posexplode(x.page_lines(F.col("html"))).alias("pos", "line"))


@query(f"with {RANKED}, c as (select region, part, team, rank || ',' || w || '-' || l || case when t > 0 then '-' || t else '' end || ',' || team || ',' || {CITY('team')} || ',' || {SCHOOL('team')} || ' &,' || printf('%.4f', average) as cells from ranked where form = 0) select region, part, 'Standing;Current Rank,Rated W-L,ID #,Mailing City,School:,Current Average;' || string_agg(cells, ';' order by team) as cells from c group by all")
def page_rows(spark, sf):
    rows = x.page_rows(F.col("html"))
    return rendered.rankings(spark, sf).select("region", "part", F.array_join(F.transform(rows, lambda r: F.array_join(r, ",")), ";").alias("cells")).filter("cells <> ''")


SHAPE = r"replace(replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\d{4}-\d{2}-\d{2}', chr(1), 'g'), '(?:\d{1,2}(?::\d{2})?\s*[apAP]\.?[mM]\.?|\d{1,2}:\d{2}|[Nn]oon|TBA|TBD)', chr(2), 'g'), '\d+', '#', 'g'), '[A-Za-z]+', 'w', 'g'), '(?:w ?)+', 'w ', 'g'), '\s+', ' ', 'g')), chr(1), '<DATE>'), chr(2), '<TIME>')"


@query(f"select md5({SHAPE}) as shape, count(*) as n from (select text as t from documents) group by 1")
def record_shape(spark, sf):
    """Formats of all documents, whole texts, as one would look for record formats on unknown pages."""
    return arena.read(spark, sf, "documents").select(x.shape(F.col("text")).alias("s")).groupBy(F.md5("s").alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {BOARD} select distinct {SCHOOL('t')} as school, {CITY('t')} as city from (select unnest([home, away]) as t from good) where t % 11 <> 0")
def known_pairs(spark, sf):
    """Schools with their cities, as the scoreboards name them."""
    return pairs(spark, sf)


def pairs(spark, sf):
    games = x.week_games(parsed(spark, sf), PAGE)
    return x.known_pairs(games.select(F.explode(F.array("home", "away")).alias("name")))


@query(f"with {RANKED} select region, part, rank, w, l, t, cast(team as varchar) as school_id, {CUT_SCHOOL} as school, {CUT_CITY} as city, average from ranked where form = 1")
def roster_flat(spark, sf):
    """Ranking rows of one line of text; where the city ends is learned from the scoreboards."""
    rows = x.ranking_rows(rendered.rankings(spark, sf).select("region", "part", x.flat_text(F.col("html")).alias("flat")).filter("flat not like '%Current Rank%'"))
    return x.split_city_school(rows, pairs(spark, sf)).select("region", "part", "rank", "w", "l", "t", "school_id", "school", "city", "average")


@query(f"with {RANKED} select region, part, {SCHOOL('team')} || ' &' as school, {CITY('team')} as city, cast(team as varchar) as school_id, w, l, t, average from ranked where form = 0")
def roster_table(spark, sf):
    return x.table_rows(rendered.rankings(spark, sf))


@query(f"with {RANKED} select region, part, case form when 0 then 'table' when 1 then 'flat' else 'text' end as tier, case when form = 0 then {SCHOOL('team')} || ' &' else {CUT_SCHOOL} end as school, case when form = 0 then {CITY('team')} else {CUT_CITY} end as city, cast(team as varchar) as school_id, w, l, t, average from ranked")
def roster_text(spark, sf):
    """Every ranking page by the first of three tiers that gives a row."""
    return x.ranking(rendered.rankings(spark, sf), pairs(spark, sf))


@query(f"with {RANKED} select region, case when region <= 4 then 'I' else 'II' end as division, case when form = 0 then {SCHOOL('team')} || ' & (' || {CITY('team')} || ')' else {CUT_SCHOOL} || ' (' || {CUT_CITY} || ')' end as name, cast(team as varchar) as school_id from ranked")
def region_division(spark, sf):
    """The roster of all ranking pages: names as scoreboards write them, once a region, with the division that four regions make."""
    rows = x.ranking(rendered.rankings(spark, sf), pairs(spark, sf))
    regions = sorted(r[0] for r in arena.dense_roster(spark, sf).filter("in_league").select("region").distinct().collect())
    return x.region_roster(rows, regions, arena.DIVISIONS).select("region", "division", "name", "school_id")


@query(f"with {PICKED} select wk, case when fav_home then {SHORT('home')} else {SHORT('away')} end as fav, case when fav_home then {SHORT('away')} else {SHORT('home')} end as dog, fav_home, margin, fav_p from picked")
def parse_picks(spark, sf):
    return x.parse_picks(rendered.picks(spark, sf)).drop("pick")


MATCHED = f"{PICKED}, uniq as (select distinct wk, home, away from fixtures), fit as (select p.*, case when fav_home then margin else -margin end as home_margin, round(case when fav_home then fav_p else 1 - fav_p end, 3) as home_p from picked p)"


@query(f"with {MATCHED} select wk, {FULL('home')} as home, {FULL('away')} as away, home_margin, home_p from fit")
def match_picks(spark, sf):
    """Every pick finds the one fixture of its week that its short names can mean, and is restated from the home side."""
    picks = x.parse_picks(rendered.picks(spark, sf))
    # picks of several pages of a week are told apart by their names
    w = Window.partitionBy("wk").orderBy("fav", "dog", "margin", "fav_p", "pick")
    picks = picks.withColumn("pick", F.row_number().over(w))
    fixtures = arena.fixtures(arena.dense_games(spark, sf)).select("wk", rendered.full_name(F.col("home")).alias("home"), rendered.full_name(F.col("away")).alias("away"))
    return x.match_picks(picks, fixtures).filter("n = 1").select("wk", "home", "away", "home_margin", "home_p")


WORDS = "string_split(lower({0}), ' ')"


@query("with p as (select p_partkey, p_name, p_type, array_to_string(list_transform(string_split(p_name, ' '), lambda w: w[1:3]), '. ') || '.' as short from part), w as (select p_partkey, string_split(trim(replace(lower(short), '.', '')), ' ') as a, string_split(lower(p_name), ' ') as b, string_split(lower(p_type), ' ') as c from p) select p_partkey, len(a) <= len(b) and len(list_filter(range(1, len(a) + 1), lambda i: not starts_with(b[i], a[i]))) = 0 as own, len(a) <= len(c) and len(list_filter(range(1, len(a) + 1), lambda i: not starts_with(coalesce(c[i], ''), a[i]))) = 0 as other from w")
def tokens_agree(spark, sf):
    """Part names cut to three letters a word against whole names, and against types."""
    short = F.concat(F.array_join(F.transform(F.split("p_name", " "), lambda w: F.substring(w, 1, 3)), ". "), F.lit("."))
    return arena.read(spark, sf, "part").select("p_partkey", x.tokens_agree(short, F.col("p_name")).alias("own"), x.tokens_agree(short, F.col("p_type")).alias("other"))


@query(f"with {ARENA_SQL}, m as (select *, game_id % 7 as form from games) select game_id, case when form = 4 then null when form = 0 then {FULL('away')} else {SCHOOL('away')} end as away, case when form <> 4 then aw end as ascore, case when form = 4 then null when form = 0 then {FULL('home')} else {SCHOOL('home')} end as home, case when form <> 4 then hs end as hscore, case when form <> 4 then form = 0 end as neutral from m")
def match_line(spark, sf):
    return rendered.lines(spark, sf).select("game_id", x.match_line(F.col("line")).alias("m")).select("game_id", "m.*")


@query("select page_id, cast((length(html) - length(replace(lower(html), '<tr', ''))) // 3 as bigint) as table_rows from pages")
def page_tables(spark, sf):
    """Table rows on the pages of the corpus."""
    return arena.read(spark, sf, "pages").select("page_id", F.size(x.page_rows(F.col("html"))).cast("bigint").alias("table_rows"))
