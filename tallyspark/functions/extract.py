"""Records out of flattened pages: games, fixtures, called-off games, ranking rows and picks.

A flat page is cut in front of every ISO date, so each record is a row of its
own and no pattern can run from one record into the next.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The grammar of the records as the pages write them.
TEAM = r"[A-Za-z](?:[A-Za-z0-9'&.,\-/ ]|\([^()]{1,30}\)){0,60}?\([^()]{0,40}\)(?:\s*\[[A-Za-z][A-Za-z .'\-]{1,19}\])?"
TIME = r"(?:\d{1,2}(?::\d{2})?\s*[apAP]\.?[mM]\.?|\d{1,2}:\d{2}|[Nn]oon|TBA|TBD)"
DATE = r"\d{4}-\d{2}-\d{2}"
OFF = r"(?:cancel(?:l?ed)?|ppd|postponed|forfeit(?:ed)?|no\s+contest)"
PLACEHOLDER = r"(?i)^(?:TBA|TBD|OPEN|BYE|Non[- ]varsity(?:\s+opponent)?)$"
JUNK = ("copyright", "rankings", "scoreboard", "click", "week ", "http", "all rights", "powered by", "search", "select", "printable")
RANKING = r"(\d{1,3}t?)\s+(\d{1,2})-(\d{1,2})(?:-(\d{1,2}))?\s+(\d{1,6})\s+([A-Za-z][A-Za-z0-9'&.,\-/ ]{1,70}?)\s+(\d+\.\d{4})(?!\d)"
PICK_NAME = r"[A-Za-z][A-Za-z0-9'&.\-/ ]{0,38}?"
PICK = rf"(?:#\d+\s+)?({PICK_NAME})\s*\(\d{{1,2}}-\d{{1,2}}\)\s+by\s+(\d{{1,3}})\s+\((\d{{1,3}})%\)\s+(at|vs)\s+(?:#\d+\s+)?({PICK_NAME})\s*\(\d{{1,2}}-\d{{1,2}}\)"
DAY = r"(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day"

HEAD = rf"(?i)^({DATE})\s+(?:({TIME})\s+)?"
GAME = HEAD + rf"({TEAM})\s+(\d{{1,3}}|\*\*\*)\s+(at|vs\.?)\s+({TEAM})\s+(\d{{1,3}}(?!\d)|\*\*\*)"
CALLED_OFF = HEAD + rf"({TEAM})\s+(?:\*\*\*\s+)?(at|vs\.?)\s+({TEAM})\s+(?:\*\*\*\s+)?{OFF}"


def flat_text(html: Column) -> Column:
    """The page as one line: scripts, styles and the head gone, tags made spaces, the common entities decoded."""
    c = F.regexp_replace(html, r"(?is)<(script|style|head)\b[^>]*>.*?</\1\s*>", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def page_rows(html: Column) -> Column:
    """The page's table rows, each an array of its cells' text."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1))
    cells = lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(cells(r), flat_text))


def page_lines(html: Column) -> Column:
    """The text of each block of the page, in order, each line once."""
    c = F.regexp_replace(html, r"(?is)<(script|style|head)\b[^>]*>.*?</\1\s*>", "\n")
    c = F.regexp_replace(c, r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|tr|table|article|section|nav|footer|header|br|body|html)\b[^>]*>", "\u0001")
    return F.array_distinct(F.filter(F.transform(F.split(c, "\u0001"), flat_text), lambda x: x != ""))


def clean_name(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"\s+", " "), F.lit(" .-–—"))


def team_name(raw: Column) -> tuple[Column, Column]:
    """(name, state): the state tag split off, a city that is written twice or is empty dropped."""
    tag = r"\s*\[([A-Za-z][A-Za-z .'\-]{1,19})\]\s*$"
    name = F.regexp_replace(raw, tag, "")
    name = F.regexp_replace(name, r"\(([^()]{1,40})\)\s*\(\1\)\s*$", "($1)")
    return clean_name(F.regexp_replace(name, r"\s*\(\s*\)\s*$", "")), F.upper(F.regexp_extract(raw, tag, 1))


def placeholder(name: Column) -> Column:
    return F.trim(name).rlike(PLACEHOLDER)


def plausible(name: Column) -> Column:
    low = F.lower(name)
    clean = F.lit(True)
    for word in JUNK:
        clean = clean & ~F.contains(low, F.lit(word))
    return F.coalesce(F.length(name).between(2, 80) & name.rlike("[A-Za-z]") & (F.size(F.split(F.trim(name), r"\s+")) <= 12) & clean, F.lit(False))


def shape(c: Column) -> Column:
    """A record's format: dates, times, numbers and words each made one sign."""
    c = F.regexp_replace(F.regexp_replace(c, DATE, "\u0001"), TIME, "\u0002")
    c = F.regexp_replace(F.regexp_replace(c, r"\d+", "#"), "[A-Za-z]+", "w")
    c = F.trim(F.regexp_replace(F.regexp_replace(c, "(?:w ?)++", "w "), r"\s+", " "))
    return F.replace(F.replace(c, F.lit("\u0001"), F.lit("<DATE>")), F.lit("\u0002"), F.lit("<TIME>"))


def page_records(pages: DataFrame, flat_col: str = "flat") -> DataFrame:
    """pages with pos and record: what stands from each ISO date to the next."""
    return pages.select("*", F.posexplode(F.split(flat_col, rf"(?={DATE})")).alias("pos", "record")).filter(F.col("record").rlike(f"^{DATE}"))


def parse_records(records: DataFrame) -> DataFrame:
    """records with kind (game, fixture, called off, unrecognised), date, time, away, away_state, home, home_state, ascore, hscore, neutral."""
    off, game = F.col("record").rlike(CALLED_OFF), F.col("record").rlike(GAME)
    part = lambda i, j: F.when(off, F.regexp_extract("record", CALLED_OFF, j)).when(game, F.regexp_extract("record", GAME, i))
    rows = records.withColumns({"date": F.regexp_extract("record", f"^({DATE})", 1), "time": part(2, 2), "raw_away": part(3, 3), "sep": part(5, 4), "raw_home": part(6, 5), "sa": F.when(game & ~off, F.regexp_extract("record", GAME, 4)), "sh": F.when(game & ~off, F.regexp_extract("record", GAME, 7))})
    stars = (F.col("sa") == "***") & (F.col("sh") == "***")
    scores = F.col("sa").rlike(r"^\d") & F.col("sh").rlike(r"^\d")
    kind = F.when(off, "called off").when(stars, "fixture").when(scores, "game").otherwise("unrecognised")
    (away, away_state), (home, home_state) = team_name(F.col("raw_away")), team_name(F.col("raw_home"))
    number = lambda c: F.when(F.col(c).rlike(r"^\d+$"), F.expr(f"try_cast({c} as int)"))
    return rows.withColumns({"kind": kind, "away": away, "away_state": away_state, "home": home, "home_state": home_state, "ascore": number("sa"), "hscore": number("sh"), "neutral": F.lower("sep").startswith("vs")}).drop("raw_away", "raw_home", "sep", "sa", "sh")


def first_of_each(rows: DataFrame, page: list[str]) -> DataFrame:
    """One row for each pair of names on a page (case ignored): the first."""
    w = Window.partitionBy(*page, F.lower("away"), F.lower("home")).orderBy("pos")
    return rows.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def week_games(parsed: DataFrame, page: list[str], most: int = 120) -> DataFrame:
    """A page's games: no placeholders, no self-games, no implausible names or scores, each pair once."""
    good = (F.col("kind") == "game") & ~placeholder(F.col("away")) & ~placeholder(F.col("home")) & plausible(F.col("away")) & plausible(F.col("home")) & (F.lower("away") != F.lower("home")) & (F.col("ascore") <= most) & (F.col("hscore") <= most)
    return first_of_each(parsed.filter(good), page)


def week_fixtures(parsed: DataFrame, page: list[str]) -> DataFrame:
    good = (F.col("kind") == "fixture") & ~placeholder(F.col("away")) & ~placeholder(F.col("home")) & plausible(F.col("away")) & plausible(F.col("home")) & (F.lower("away") != F.lower("home"))
    return first_of_each(parsed.filter(good), page)


def placeholders(parsed: DataFrame, page: list[str]) -> DataFrame:
    """(page, residual, called_off, placeholders): records that no pattern claimed, called-off games, and records with a side that is nobody."""
    nobody = placeholder(F.col("away")) | placeholder(F.col("home"))
    return parsed.groupBy(*page).agg(F.count_if(F.col("kind") == "unrecognised").alias("residual"), F.count_if(F.col("kind") == "called off").alias("called_off"), F.count_if(nobody & F.col("kind").isin("game", "fixture")).alias("placeholders"))


def probe(parsed: DataFrame, order: list[str]) -> DataFrame:
    """(shape, n, samples): the formats of what no pattern claimed, with the first two records of each by ``order``."""
    rest = parsed.filter("kind = 'unrecognised'").withColumn("shape", shape(F.col("record")))
    w = Window.partitionBy("shape").orderBy(*order)
    two = rest.withColumn("__k", F.row_number().over(w)).filter("__k <= 2").groupBy("shape").agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", "record"))), lambda r: F.trim(r["record"])).alias("samples"))
    return rest.groupBy("shape").agg(F.count(F.lit(1)).alias("n")).join(two, "shape")


def weeks_read(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, wk, stop) of (keys, wk, found): weeks in order up to the first whose page has neither games nor fixtures, which stops the reading."""
    end = found.filter("found = 0").groupBy(*keys).agg(F.min("wk").alias("end"))
    return found.join(end, keys, "left").filter("end is null or wk <= end").select(*keys, "wk", F.coalesce(F.col("wk") == F.col("end"), F.lit(False)).alias("stop"))


def unplayed(fixtures: DataFrame, games: DataFrame) -> DataFrame:
    """Fixtures (wk, away, home, ...) without those that stand among the games, by week and names, case ignored."""
    key = lambda df: df.select(F.col("wk").alias("__w"), F.lower("away").alias("__a"), F.lower("home").alias("__h")).distinct()
    played = key(games)
    return fixtures.join(played, (F.col("wk") == F.col("__w")) & (F.lower("away") == F.col("__a")) & (F.lower("home") == F.col("__h")), "left_anti")


def known_pairs(names: DataFrame, col: str = "name") -> DataFrame:
    """(school, city): the distinct pairs in names of the form ``School (City)``."""
    form = r"^(.*?)\s*\(([^)]*)\)$"
    return names.filter(F.col(col).rlike(form)).select(F.regexp_extract(col, form, 1).alias("school"), F.regexp_extract(col, form, 2).alias("city")).filter("school <> '' and city <> ''").distinct()


def team_key(school: Column, city: Column) -> Column:
    """The name as scoreboards write it: ``School (City)``, or the school alone."""
    s, c = clean_name(school), clean_name(city)
    return F.when(c != "", F.concat(s, F.lit(" ("), c, F.lit(")"))).otherwise(s)


def region_roster(rows: DataFrame, regions: list[int], divisions: tuple[str, ...], each: int = 4) -> DataFrame:
    """rows (region, school, city, ...) with name and division, each name once a region (the first by school_id); a region without a row stops the query."""
    found = rows.select("region").distinct()
    missing = found.sparkSession.createDataFrame([(r,) for r in regions], "region int").join(found, "region", "left_anti").agg(F.array_join(F.array_sort(F.collect_list("region")), ",").alias("missing"))
    named = rows.withColumns({"name": team_key(F.col("school"), F.col("city")), "division": F.get(F.array(*map(F.lit, divisions)), F.floor((F.col("region") - 1) / each).cast("int"))})
    w = Window.partitionBy("region", "name").orderBy("school_id")
    first = named.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")
    # one row
    checked = first.join(F.broadcast(missing)).filter(F.when(F.col("missing") == "", True).otherwise(F.raise_error(F.concat(F.lit("regions without a team: "), "missing")).cast("boolean")))
    return checked.drop("missing")


def ranking_rows(pages: DataFrame, flat_col: str = "flat") -> DataFrame:
    """pages with (rank, w, l, t, school_id, middle, average) of each ranking row of the flat text."""
    g = lambda i: F.regexp_extract_all(flat_col, F.lit(RANKING), F.lit(i))
    keep = [c for c in pages.columns if c != flat_col]
    rows = pages.select(*keep, F.explode(F.arrays_zip(*[g(i).alias(n) for i, n in enumerate(("rank", "w", "l", "t", "school_id", "middle", "average"), 1)])).alias("r"))
    return rows.select(*keep, "r.rank", F.col("r.w").cast("int").alias("w"), F.col("r.l").cast("int").alias("l"), F.expr("coalesce(try_cast(r.t as int), 0)").alias("t"), "r.school_id", "r.middle", F.col("r.average").cast("double").alias("average")).filter("w <= 16 and l <= 16")


def split_city_school(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """rows with school and city: the first cut of middle whose (school, city) is known, else the first word is the city."""
    words = F.split("middle", " ")
    cut = rows.withColumns({"words": words, "n": F.size(words)})
    tries = cut.select("middle", "words", F.explode(F.sequence(F.lit(1), F.greatest(F.col("n") - 1, F.lit(1)))).alias("cut")).filter("cut < size(words)").distinct()
    tries = tries.select("middle", "cut", F.lower(F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ")).alias("c"), F.lower(F.array_join(F.expr("slice(words, cut + 1, size(words) - cut)"), " ")).alias("s"))
    known = tries.join(pairs.select(F.lower("school").alias("s"), F.lower("city").alias("c")).distinct(), ["s", "c"]).groupBy("middle").agg(F.min("cut").alias("cut"))
    at = F.coalesce("cut", F.lit(1))
    return cut.join(known, "middle", "left").withColumns({"school": F.when(F.col("n") > 1, F.array_join(F.slice("words", at + 1, F.col("n")), " ")).otherwise(F.col("middle")), "city": F.when(F.col("n") > 1, F.array_join(F.slice("words", F.lit(1), at), " ")).otherwise("")}).drop("words", "n", "cut")


def parse_picks(pages: DataFrame, flat_col: str = "flat") -> DataFrame:
    """(wk, pick, fav, dog, fav_home, margin, fav_p): the favourite is named first, and ``at`` means that it is away."""
    g = lambda i: F.regexp_extract_all(flat_col, F.lit(PICK), F.lit(i))
    rows = pages.select(F.expr(f"try_cast(regexp_extract({flat_col}, '[Pp]icks for week\\\\s*#?\\\\s*(\\\\d{{1,2}})', 1) as int)").alias("wk"), F.posexplode(F.arrays_zip(*[g(i).alias(n) for i, n in enumerate(("fav", "margin", "prob", "sep", "dog"), 1)])).alias("pick", "r"))
    bare = lambda c: F.btrim(F.regexp_replace(F.trim(c), rf"^.*?{DAY}\s+", ""), F.lit(" ."))
    out = rows.select("wk", "pick", bare(F.col("r.fav")).alias("fav"), bare(F.col("r.dog")).alias("dog"), (F.col("r.sep") == "vs").alias("fav_home"), F.col("r.margin").cast("int").alias("margin"), F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("r.prob").cast("int") / 100.0)).alias("fav_p"))
    return out.filter("fav <> '' and dog <> '' and lower(fav) <> lower(dog)")


def tokens(name: Column) -> Column:
    """The words of a name as they are compared: lower case, without apostrophes, dots and hyphens as spaces."""
    return F.split(F.trim(F.regexp_replace(F.replace(F.regexp_replace(F.lower(name), r"[.\-]", " "), F.lit("'"), F.lit("")), r"\s+", " ")), " ")


def tokens_agree(short: Column, long: Column) -> Column:
    """Every word of the short name starts the word at its place in the long one."""
    a, b = tokens(short), tokens(long)
    return (a[0] != "") & (F.size(a) <= F.size(b)) & F.forall(F.zip_with(a, F.slice(b, F.lit(1), F.size(a)), lambda x, y: F.coalesce(F.startswith(y, x), F.lit(False))), lambda x: x)


def parts(full: Column) -> tuple[Column, Column]:
    """School and city of ``School (City)``; the city is empty where there is none."""
    return tuple(F.regexp_extract(full, r"^(.*?)(?: \(([^()]*)\))?$", k) for k in (1, 2))


def own_parts(short: Column) -> tuple[Column, Column]:
    """The same of a short name; both are empty where it has no city in brackets."""
    return tuple(F.regexp_extract(F.trim(short), r"^(.*?)\s*\(([^)]+)\)$", k) for k in (1, 2))


def compatible(short: Column, full: Column) -> Column:
    """Whether a bare name may mean ``School (City)``: by school, by city and school in either order, or by an abbreviated city."""
    (school, city), (own, own_city) = parts(full), own_parts(short)
    with_city = (city != "") & (tokens_agree(short, F.concat_ws(" ", city, school)) | tokens_agree(short, F.concat_ws(" ", school, city)))
    abbreviated = (own != "") & (city != "") & tokens_agree(own, school) & tokens_agree(own_city, city)
    return tokens_agree(short, school) | with_city | abbreviated


def meanings(shorts: DataFrame, fulls: DataFrame) -> DataFrame:
    """(short, full): every full name that each short name may mean.

    A word of the short name starts the word at its place in the full name, so
    names meet on a place with the start of a word, each short name on the one
    of its words that starts the fewest names; then the full rule is asked.
    """
    school, city = parts(F.col("full"))
    forms = F.array(tokens(school), tokens(F.concat_ws(" ", city, school)), tokens(F.concat_ws(" ", school, city)))
    starts = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda n: F.substring(w, 1, n))
    words = fulls.select("full", F.explode(F.array_distinct(forms)).alias("words")).select("full", F.posexplode("words").alias("place", "word"))
    keys = words.select("full", "place", F.explode(starts(F.col("word"))).alias("start")).distinct()
    ways = shorts.select("short", F.explode(F.array_distinct(F.array(F.col("short"), F.when(own_parts(F.col("short"))[0] != "", own_parts(F.col("short"))[0]).otherwise(F.col("short"))))).alias("way"))
    asked = ways.select("short", "way", F.posexplode(tokens(F.col("way"))).alias("place", "start")).join(keys.groupBy("place", "start").agg(F.count(F.lit(1)).alias("n")), ["place", "start"])
    rarest = asked.groupBy("short", "way").agg(F.min(F.struct("n", "place", "start")).alias("k")).select("short", "k.place", "k.start")
    return rarest.join(keys, ["place", "start"]).select("short", "full").distinct().filter(compatible(F.col("short"), F.col("full")))


def match_picks(picks: DataFrame, fixtures: DataFrame) -> DataFrame:
    """picks with n, home, away, home_margin, home_p: a pick that fits one fixture of its week is restated from the home side; others keep nulls.

    What a short name may mean is found once for all weeks; a pick then meets
    the fixtures of those names in its week, never all of its week.
    """
    sides = picks.select("wk", "pick", F.when(F.col("fav_home"), F.col("fav")).otherwise(F.col("dog")).alias("ph"), F.when(F.col("fav_home"), F.col("dog")).otherwise(F.col("fav")).alias("pa"))
    fx = fixtures.select("wk", "home", "away").distinct()
    either = lambda df, a, b, name: df.select(F.explode(F.array(a, b)).alias(name)).filter(F.col(name).isNotNull()).distinct()
    mean = meanings(either(sides, "ph", "pa", "short"), either(fx, "home", "away", "full"))
    side = lambda short, full: mean.select(F.col("short").alias(short), F.col("full").alias(full))
    pairs = sides.join(side("ph", "home"), "ph").join(fx, ["wk", "home"]).join(side("pa", "away"), ["pa", "away"])
    found = pairs.groupBy("wk", "pick").agg(F.count_distinct("home", "away").alias("n"), F.min("home").alias("home"), F.min("away").alias("away"))
    rows = picks.join(found, ["wk", "pick"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    one = F.col("n") == 1
    return rows.withColumns({"home": F.when(one, F.col("home")), "away": F.when(one, F.col("away")), "home_margin": F.when(one, F.when(F.col("fav_home"), F.col("margin")).otherwise(-F.col("margin"))), "home_p": F.when(one, F.round(F.when(F.col("fav_home"), F.col("fav_p")).otherwise(1 - F.col("fav_p")), 3))})


# Single-line results, what may stand in front of one, and the headings of ranking tables.
LINE_NAME = r"[A-Za-z][A-Za-z0-9'&.\-/ ]*?(?:\([^)]*\))?"
LEAD = rf"(?i)^\s*(?:{DATE}\s+)?(?:(?:Mon|Tues?|Wed(?:nes)?|Thur?s?|Fri|Sat(?:ur)?|Sun)(?:day)?\.?,?\s+)?(?:(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?\s+\d{{1,2}}(?:,?\s*\d{{4}})?\s+)?(?:\d{{1,2}}[/-]\d{{1,2}}(?:[/-]\d{{2,4}})?\s+)?(?:{TIME}\s+)?"
LINES = (
    (rf"(?i)^\s*(?:\d+\.?\s+)?({LINE_NAME})\s+(\d{{1,3}})\s+(at|vs\.?|@)\s+({LINE_NAME})\s+(\d{{1,3}})(?!\d)", (1, 2, 3, 4, 5)),
    (rf"(?i)^\s*(?:\d+\.?\s+)?({LINE_NAME})\s+(at|vs\.?|@)\s+({LINE_NAME})\s+(\d{{1,3}})\s+(\d{{1,3}})(?!\d)", (1, 4, 2, 3, 5)),
    (rf"^\s*(?:\d+\.?\s+)?({LINE_NAME})\s+(\d{{1,3}})\s+({LINE_NAME})\s+(\d{{1,3}})(?!\d)", (1, 2, None, 3, 4)),
)
HEADINGS = {"record": ("rated w-l", "rated wl", "w-l", "record"), "sid": ("id #", "id#", "id"), "city": ("mailing city", "city"), "school": ("school", "team"), "average": ("current average", "average", "harbin")}


def line_game(line: Column, most: int = 120) -> Column:
    """(away, ascore, home, hscore, neutral) of one line: the first form that gives plausible, different names and scores; else null."""
    found = []
    for pattern, (away, ascore, sep, home, hscore) in LINES:
        get = partial(F.regexp_extract, line, pattern)
        a, h = clean_name(get(away)), clean_name(get(home))
        x, y = get(ascore).try_cast("int"), get(hscore).try_cast("int")
        neutral = F.lower(get(sep)).startswith("vs") if sep else F.lit(False)
        good = line.rlike(pattern) & plausible(a) & plausible(h) & (F.lower(a) != F.lower(h)) & (x <= most) & (y <= most)
        found.append(F.when(good, F.struct(a.alias("away"), x.alias("ascore"), h.alias("home"), y.alias("hscore"), neutral.alias("neutral"))))
    return F.coalesce(*found)


def match_line(line: Column) -> Column:
    """line_game of the line, or of the line without its date and time where that only shortens the first name."""
    raw, bare = line_game(line), line_game(F.regexp_replace(line, LEAD, ""))
    shorter = F.lower(raw["away"]).endswith(F.lower(bare["away"])) & (F.length(bare["away"]) < F.length(raw["away"]))
    return F.when(raw.isNull() | F.coalesce(shorter, F.lit(False)), F.coalesce(bare, raw)).otherwise(raw)


def table_rows(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with (school, city, school_id, w, l, t, average) from ranking tables: columns by their headings, rows that do not fit left out."""
    keep = [c for c in pages.columns if c != html_col]
    rows = pages.select(*keep, F.posexplode(page_rows(F.col(html_col))).alias("pos", "cells"))
    heads = F.transform("cells", lambda c: F.rtrim(F.lower(F.trim(c)), F.lit(":")))
    place = lambda names: F.array_min(F.filter(F.transform(heads, lambda h, i: F.when(h.isin(*names), i)), lambda i: i.isNotNull()))
    at = rows.select(*keep, "pos", *[place(names).alias(f"at_{k}") for k, names in HEADINGS.items()]).filter("at_record is not null and at_school is not null and at_average is not null")
    first = at.groupBy(*keep).agg(F.min_by(F.struct("pos", *[f"at_{k}" for k in HEADINGS]), "pos").alias("h")).select(*keep, F.col("h.pos").alias("head"), *[f"h.at_{k}" for k in HEADINGS])
    cell = lambda k: F.coalesce(F.trim(F.try_element_at("cells", F.col(f"at_{k}") + 1)), F.lit(""))
    record = r"^(\d{1,2})-(\d{1,2})(?:-(\d{1,2}))?$"
    part = lambda i: F.coalesce(F.regexp_extract(cell("record"), record, i).try_cast("int"), F.lit(0))
    out = rows.join(first, keep).filter((F.col("pos") > F.col("head")) & cell("record").rlike(record) & plausible(cell("school")))
    out = out.select(*keep, clean_name(cell("school")).alias("school"), clean_name(cell("city")).alias("city"), cell("sid").alias("school_id"), part(1).alias("w"), part(2).alias("l"), part(3).alias("t"), cell("average").try_cast("double").alias("average"))
    return out.filter("average is not null and w <= 16 and l <= 16")


#: The text tier: one ranking row a line, averages of three or four decimals.
RANKING_LINE = r"^\s*(\d{1,3}t?)\s+(\d{1,2})-(\d{1,2})(?:-(\d{1,2}))?\s+(\d{1,6})\s+(.+?)\s+(\d+\.\d{3,4})(?!\d)"


def line_rows(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with (rank, w, l, t, school_id, middle, average) of each line that is a ranking row."""
    keep = [c for c in pages.columns if c != html_col]
    rows = pages.select(*keep, F.explode(page_lines(F.col(html_col))).alias("line")).filter(F.col("line").rlike(RANKING_LINE))
    g = lambda i: F.regexp_extract("line", RANKING_LINE, i)
    return rows.select(*keep, g(1).alias("rank"), g(2).cast("int").alias("w"), g(3).cast("int").alias("l"), F.coalesce(g(4).try_cast("int"), F.lit(0)).alias("t"), g(5).alias("school_id"), clean_name(g(6)).alias("middle"), g(7).cast("double").alias("average"))


def ranking(pages: DataFrame, pairs: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with (tier, school, city, school_id, w, l, t, average): from the table where the page has one, else from its flat text, else from its lines."""
    keep = [c for c in pages.columns if c != html_col]
    columns = [*keep, "tier", "school", "city", "school_id", "w", "l", "t", "average"]
    without = lambda found: pages.join(found.select(*keep).distinct(), keep, "left_anti")
    split = lambda rows, tier: split_city_school(rows, pairs).withColumn("tier", F.lit(tier)).filter(plausible(F.col("school"))).select(*columns)
    by_table = table_rows(pages, html_col).withColumn("tier", F.lit("table")).select(*columns)
    by_flat = split(ranking_rows(without(by_table).select(*keep, flat_text(F.col(html_col)).alias("flat"))), "flat")
    by_line = split(line_rows(without(by_table.select(*keep).union(by_flat.select(*keep))), html_col), "text")
    return by_table.unionByName(by_flat).unionByName(by_line)
