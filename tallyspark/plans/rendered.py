"""The arena's tables as the texts that the library reads: scoreboards, rankings, picks, single lines and files.

Every text is made from rows by column expressions, so it can be parsed and
the result held against those rows; the SQL constants say the same rows
without any text.  Faults are dealt by keys: called-off games, repeats, a
team against itself, scores too high, places held by nobody, notes that no
pattern knows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arena
from .arena import ARENA_SQL

#: Games by key: what their record is made into (7 and more: an ordinary record), orders a page, and teams a ranking page.
CALLED_OFF, FIXTURE, TWICE, SELF, HIGH, NOTE, BYE = range(7)
KINDS, PAGE_KEYS, PAGE_TEAMS = 13, 400_000, 200


# --- names ---------------------------------------------------------------------------------------------------------
def letters(n: Column) -> Column:
    return F.translate(n.cast("string"), "0123456789", "abcdefghij")


def school(t: Column) -> Column:
    """A name of one or two words; the x at its first word's end keeps it from being the start of another."""
    return F.concat(F.lit("V"), letters(t), F.lit("x"), F.when(t % 4 == 1, " Hill").otherwise(""))


def city(t: Column) -> Column:
    return F.concat(F.when(t % 4 == 2, "Upper ").otherwise(""), F.lit("C"), letters(t % 7))


def raw_name(t: Column) -> Column:
    """As a scoreboard writes it: the city empty, written twice or once, and a state's tag."""
    place = F.when(t % 11 == 0, " ()").when(t % 5 == 0, F.concat(F.lit(" ("), city(t), F.lit(") ("), city(t), F.lit(")"))).otherwise(F.concat(F.lit(" ("), city(t), F.lit(")")))
    return F.concat(school(t), place, F.when(t % 9 == 0, " [pa]").otherwise(""))


def full_name(t: Column) -> Column:
    return F.concat(school(t), F.lit(" ("), city(t), F.lit(")"))


SCHOOL = lambda t: f"('V' || translate(cast({t} as varchar), '0123456789', 'abcdefghij') || 'x' || case when {t} % 4 = 1 then ' Hill' else '' end)"
CITY = lambda t: f"(case when {t} % 4 = 2 then 'Upper ' else '' end || 'C' || translate(cast({t} % 7 as varchar), '0123456789', 'abcdefghij'))"
FULL = lambda t: f"({SCHOOL(t)} || ' (' || {CITY(t)} || ')')"
CLEAN = lambda t: f"({SCHOOL(t)} || case when {t} % 11 = 0 then '' else ' (' || {CITY(t)} || ')' end)"
STATE = lambda t: f"(case when {t} % 9 = 0 then 'PA' else '' end)"


# --- scoreboards -----------------------------------------------------------------------------------------------------
def day(season: Column, wk: Column) -> Column:
    return F.date_format(F.date_add(F.make_date(season, F.lit(1), F.lit(1)), 7 * (wk - 1)), "yyyy-MM-dd")


def kind_of(game: Column) -> Column:
    return F.floor(game / 7) % KINDS


def clock(game: Column) -> Column:
    return F.when(game % 4 == 0, "7pm").when(game % 4 == 1, "6:45pm").when(game % 4 == 2, "noon").otherwise("")


def scoreboards(spark: SparkSession, sf: str) -> DataFrame:
    """(season, wk, part, flat): pages of the records of at most 4,000 orders' games of a week, by game_id."""
    c = F.col
    k, game = kind_of(c("game_id")), c("game_id")
    head = F.concat(day(c("season"), c("wk")), F.lit(" "), F.when(clock(game) != "", F.concat(clock(game), F.lit(" "))).otherwise(""))
    sep = F.when(c("neutral"), " vs ").otherwise(" at ")
    home, away = raw_name(c("home")), raw_name(c("away"))
    told = lambda a, x, h, y: F.concat(head, a, F.lit(" "), x, sep, h, F.lit(" "), y)
    plain = told(away, c("aw").cast("string"), home, c("hs").cast("string"))
    text = (
        F.when(k == CALLED_OFF, F.concat(head, away, sep, home, F.lit(" postponed")))
        .when(k == FIXTURE, told(away, F.lit("***"), home, F.lit("***")))
        .when(k == TWICE, F.concat(plain, F.lit(" "), plain))
        .when(k == SELF, told(home, F.lit("3"), home, F.lit("10")))
        .when(k == HIGH, told(away, F.lit("155"), home, c("hs").cast("string")))
        .when(k == NOTE, F.concat(day(c("season"), c("wk")), F.when(game % 2 == 0, " idle week for all").otherwise(" no report of 12")))
        .when(k == BYE, told(F.lit("BYE ()"), F.lit("***"), home, F.lit("***")))
        .otherwise(plain)
    )
    rows = arena.dense_games(spark, sf).select("season", "wk", F.floor(game / PAGE_KEYS).alias("part"), "game_id", text.alias("text"))
    flat = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("game_id", "text"))), lambda r: r["text"]), " ")
    return rows.groupBy("season", "wk", "part").agg(F.concat(F.lit("Results "), flat).alias("flat"))


#: Games with their kind and page; ``good`` are those whose result a week's page gives, the first of each pair.
BOARD = f"""{ARENA_SQL}, board as (select *, (game_id // 7) % {KINDS} as kind, game_id // {PAGE_KEYS} as part, case game_id % 4 when 0 then '7pm' when 1 then '6:45pm' when 2 then 'noon' else '' end as clock,
cast(make_date(season, 1, 1) + 7 * (wk - 1) as varchar) as day from games),
good as (select * from board where kind = {TWICE} or kind > {BYE} qualify row_number() over (partition by season, wk, part, home, away order by game_id) = 1),
coming as (select * from board where kind = {FIXTURE} qualify row_number() over (partition by season, wk, part, home, away order by game_id) = 1)"""


# --- rankings --------------------------------------------------------------------------------------------------------
def ranked(spark: SparkSession, sf: str) -> DataFrame:
    """(region, part, team, form, rank, w, l, t, average): one row for each league team; form says how its page is written."""
    t = F.col("team")
    rows = arena.dense_roster(spark, sf).filter("in_league").select("region", F.floor(t / PAGE_TEAMS).alias("part"), "team")
    form = (F.col("region") + F.col("part")) % 3
    return rows.select("*", form.alias("form"), F.concat((t % PAGE_TEAMS + 1).cast("string"), F.when(t % 6 == 0, "t").otherwise("")).alias("rank"), (t % 11).alias("w"), (t % 5).alias("l"), F.when(t % 7 == 0, 1).otherwise(0).alias("t"), (t % 900 / 8.0 + 1.125).alias("average"))


def rankings(spark: SparkSession, sf: str) -> DataFrame:
    """(region, part, html): ranking pages, as tables, as one line of text, and as lines with averages of three decimals."""
    c = F.col
    record = F.concat(c("w").cast("string"), F.lit("-"), c("l").cast("string"), F.when(c("t") > 0, F.concat(F.lit("-"), c("t").cast("string"))).otherwise(""))
    cells = [c("rank"), record, c("team").cast("string"), city(c("team")), F.concat(school(c("team")), F.lit(" &amp; ")), F.format_string("%.4f", c("average"))]
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), x, F.lit("</td>")) for x in cells], F.lit("</tr>"))
    line = lambda digits: F.concat_ws(" ", c("rank"), record, c("team").cast("string"), city(c("team")), school(c("team")), F.format_string(f"%.{digits}f", c("average")))
    text = F.when(c("form") == 0, row).when(c("form") == 1, F.concat(line(4), F.lit(" "))).otherwise(F.concat(F.lit("<p>"), line(3), F.lit("</p>")))
    rows = ranked(spark, sf).select("region", "part", "form", "team", text.alias("text"))
    head = "<table><tr><td>Standing</td></tr><tr><th>Current Rank</th><th>Rated W-L</th><th>ID #</th><th>Mailing City</th><th>School:</th><th>Current Average</th></tr>"
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("team", "text"))), lambda r: r["text"]), "")
    return rows.groupBy("region", "part", "form").agg(whole.alias("all")).select("region", "part", F.when(c("form") == 0, F.concat(F.lit(head), "all", F.lit("</table>"))).otherwise(F.concat(F.lit("<p>Rank </p>"), "all")).alias("html"))


#: Teams with their ranking row, and whether the scoreboards name their school and city together.
RANKED = f"""{BOARD}, told as (select distinct team from (select unnest([home, away]) as team from good) where team % 11 <> 0),
ranked as (select r.region, r.team // {PAGE_TEAMS} as part, r.team, (r.region + r.team // {PAGE_TEAMS}) % 3 as form, cast(r.team % {PAGE_TEAMS} + 1 as varchar) || case when r.team % 6 = 0 then 't' else '' end as rank,
 cast(r.team % 11 as int) as w, cast(r.team % 5 as int) as l, case when r.team % 7 = 0 then 1 else 0 end as t, cast(r.team % 900 as double) / 8 + 1.125 as average, t.team is not null or r.team % 4 <> 2 as whole_city from roster r left join told t on t.team = r.team where in_league)"""
#: School and city of a row of text: right where the city is one word or known, else the first word is the city.
CUT_SCHOOL = f"case when whole_city then {SCHOOL('team')} else substr({CITY('team')}, 7) || ' ' || {SCHOOL('team')} end"
CUT_CITY = f"case when whole_city then {CITY('team')} else 'Upper' end"


# --- picks and lines -----------------------------------------------------------------------------------------------
def picks(spark: SparkSession, sf: str) -> DataFrame:
    """(part, flat): a rival's picks of the coming games, favourite first, under days."""
    c = F.col
    game = c("game_id")
    home_first, short = game % 3 == 0, lambda t: F.when(t % 2 == 0, F.concat(city(t), F.lit(" "), school(t))).otherwise(school(t))
    fav, dog = F.when(home_first, short(c("home"))).otherwise(short(c("away"))), F.when(home_first, short(c("away"))).otherwise(short(c("home")))
    text = F.concat(F.when(game % 5 == 0, "Friday ").otherwise(""), F.when(game % 8 == 0, "#3 ").otherwise(""), fav, F.lit(" (3-2) by "), (game % 40 + 1).cast("string"), F.lit(" ("), (F.lit(50) + game % 51).cast("string"), F.lit("%) "), F.when(home_first, "vs ").otherwise("at "), dog, F.lit(" (2-3)"))
    rows = arena.fixtures(arena.dense_games(spark, sf)).select("wk", F.floor(game / PAGE_KEYS).alias("part"), "game_id", text.alias("text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("game_id", "text"))), lambda r: r["text"]), " ")
    return rows.groupBy("wk", "part").agg(F.concat(F.lit("Picks for week #"), F.col("wk").cast("string"), F.lit(" Updated Tue Friday "), whole).alias("flat"))


SHORT = lambda t: f"(case when {t} % 2 = 0 then {CITY(t)} || ' ' else '' end || {SCHOOL(t)})"
PICKED = f"""{ARENA_SQL}, picked as (select *, game_id % 3 = 0 as fav_home, cast(game_id % 40 + 1 as int) as margin, greatest(0.01, least(0.99, (50 + game_id % 51) / 100.0::double)) as fav_p from fixtures)"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """(game_id, line): a game a line, in four forms, some after a date and a time."""
    c = F.col
    x, y, form = c("aw").cast("string"), c("hs").cast("string"), c("game_id") % 7
    bare = lambda t: school(t)
    text = (
        F.when(form == 0, F.concat(day(c("season"), c("wk")), F.lit(" 7pm "), full_name(c("away")), F.lit(" "), x, F.lit(" vs "), full_name(c("home")), F.lit(" "), y))
        .when(form == 1, F.concat(bare(c("away")), F.lit(" at "), bare(c("home")), F.lit(" "), x, F.lit(" "), y))
        .when(form == 2, F.concat(bare(c("away")), F.lit(" "), x, F.lit(" "), bare(c("home")), F.lit(" "), y))
        .when(form == 3, F.concat(F.lit("Sat "), bare(c("away")), F.lit(" "), x, F.lit(" at "), bare(c("home")), F.lit(" "), y))
        .when(form == 4, F.lit("nothing was played"))
        .otherwise(F.concat(bare(c("away")), F.lit(" "), x, F.lit(" at "), bare(c("home")), F.lit(" "), y))
    )
    return arena.dense_games(spark, sf).select("game_id", text.alias("line"))
