"""Text extraction on pages written by hand: invented schools in the formats that are read."""

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import extract as x
from tallyspark.sources import files

#: A called-off record before a game, tags, brackets in names, a record twice, a team against itself, a score too high, and no record at all.
PAGES = [
    (1, "Results 2031-10-03 8pm Vellmar (Ostrand) at Quillby (Tarn) postponed 2031-10-03 7:15pm North-Hask (Lower Dene) 31 at Marl Fenwick (Corrow) 27 2031-10-04 Osk (Bramley) 0 vs Thornway (Elling) 3"),
    (2, "2031-10-10 6:45pm Lark Hill (Penwick) *** at Dunmere (Penwick) *** 2031-10-11 noon St Orin (Kessel) (Kessel) [ky] *** vs Pell (Penwick) *** 2031-10-11 7pm Graymoor () [WV] *** at Halden Ridge (Halden) [WV] ***"),
    (3, "2031-10-17 7pm Wexcombe (Ardle) 13 at Rook Lane (annex) (Penwick) 12 2031-10-17 7pm Wexcombe (Ardle) 13 at Rook Lane (annex) (Penwick) 12 2031-10-17 Ivo (Ivo) 3 at Ivo (Ivo) 10 2031-10-18 7pm Sable (Norrin) 155 at Tamsin (Tamsin) 6 2031-10-18 idle week for all"),
]
GAMES = [(1, "North-Hask (Lower Dene)", "", 31, "Marl Fenwick (Corrow)", "", 27, False), (1, "Osk (Bramley)", "", 0, "Thornway (Elling)", "", 3, True), (3, "Wexcombe (Ardle)", "", 13, "Rook Lane (annex) (Penwick)", "", 12, False)]
FIXTURES = [("Lark Hill (Penwick)", "", "Dunmere (Penwick)", "", "6:45pm", False), ("Graymoor", "WV", "Halden Ridge (Halden)", "WV", "7pm", False), ("St Orin (Kessel)", "KY", "Pell (Penwick)", "", "noon", True)]
NAMES = [("St Orin (Kessel) (Kessel) [ky]", "St Orin (Kessel)", "KY"), ("Graymoor () [WV]", "Graymoor", "WV"), ("  Elm   Bank (Sorrel) [PA] ", "Elm Bank (Sorrel)", "PA"), ("Bare -", "Bare", "")]
PLAUSIBLE = [("Q", False), ("Ivo (Ivo)", True), ("99 12", False), ("Search here", False), ("one two three four five six seven eight nine ten eleven twelve thirteen", False), ("TBA", True)]
RANKS = "Rank 3t 4-1 1507 Tamsin Tamsin 12.2500 5 2-2-1 88 Norrin Sable 9.1000 41 0-5 612 Upper Corrow Corrow Lake Friends School 1.0625"
PAIRS = [("Sable", "Norrin"), ("Corrow Lake Friends School", "Upper Corrow")]
PICKS = "Picks for week #7 Updated Tue Friday Lark Hill (3-2) by 10 (71%) at Dunmere (2-3) Osk (5-0) by 31 (96%) at Elling Thornway (1-4) #3 Sable (4-1) by 5 (60%) at Tamsin (4-1) Saturday Fenwick Science Acad. (2-3) by 14 (80%) vs Rook Lane (0-5)"
NEXT = [("Dunmere (Penwick)", "Lark Hill (Penwick)"), ("Thornway (Elling)", "Osk (Bramley)"), ("Tamsin (Tamsin)", "Sable (Norrin)"), ("Fenwick Science Academy (Corrow)", "Rook Lane (Penwick)")]
AGREE = [("Corrow Lk. Friends", "Corrow Lake Friends School", False), ("Corrow La. Friends", "Corrow Lake Friends School", True), ("Holy Spring-Sac. Grove", "Holy Spring-Sacred Grove", True), ("Ivory", "Ivo", False), ("", "Ivo", False), ("Pell North", "Pell", False)]
LINES = [("Osk 20 at Pell 17", "Osk", 20, "Pell", 17, False), ("2031-10-04 7pm Osk (Bramley) 20 vs Pell (Penwick) 17", "Osk (Bramley)", 20, "Pell (Penwick)", 17, True), ("Osk at Pell 20 17", "Osk", 20, "Pell", 17, False), ("Osk 20 Pell 17", "Osk", 20, "Pell", 17, False), ("Sat Osk 20 at Pell 17", "Osk", 20, "Pell", 17, False), ("Twin 9 at twin 6", "Twin", 9, "at twin", 6, False), ("nothing was played", None, None, None, None, None)]
TABLE = "<table><tr><td>Week 7</td></tr><tr><th>Current Rank</th><th>Rated W-L</th><th>ID #</th><th>Mailing City</th><th>School:</th><th>Current Average</th></tr><tr><td>3t</td><td>4-1</td><td>1507</td><td>Tamsin</td><td>Tamsin</td><td>12.2500</td></tr><tr><td>5</td><td>2-2-2</td><td>88</td><td>Norrin</td><td>Sable</td><td>9.1</td></tr><tr><td>6</td><td>18-0</td><td>2</td><td>Y</td><td>Played Too Often</td><td>4.5</td></tr><tr><td>7</td><td>none</td></tr></table>"
RANKED = [(1, "table", "Tamsin", "Tamsin", "1507", 4, 1, 0, 12.25), (1, "table", "Sable", "Norrin", "88", 2, 2, 2, 9.1), (2, "flat", "Tamsin", "Tamsin", "1507", 4, 1, 0, 12.25), (2, "flat", "Sable", "Norrin", "88", 2, 2, 1, 9.1), (2, "flat", "Corrow Lake Friends School", "Upper Corrow", "612", 0, 5, 0, 1.0625)]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def parsed(spark):
    return x.parse_records(x.page_records(spark.createDataFrame(PAGES, "page int, flat string")).drop("flat")).cache()


def test_records(parsed):
    assert rows(x.week_games(parsed, ["page"]).select("page", "away", "away_state", "ascore", "home", "home_state", "hscore", "neutral")) == sorted(GAMES, key=str)
    assert rows(x.week_fixtures(parsed, ["page"]).select("away", "away_state", "home", "home_state", "time", "neutral")) == sorted(FIXTURES, key=str)
    assert rows(parsed.groupBy("page", "kind").count()) == [(1, "called off", 1), (1, "game", 2), (2, "fixture", 3), (3, "game", 4), (3, "unrecognised", 1)]
    assert rows(parsed.filter("kind = 'called off'").select("home", "away")) == [("Quillby (Tarn)", "Vellmar (Ostrand)")]
    assert rows(x.probe(parsed, ["page", "pos"])) == [("<DATE> w", 1, ["2031-10-18 idle week for all"])]
    assert rows(x.placeholders(parsed, ["page"])) == [(1, 0, 1, 0), (2, 0, 0, 0), (3, 1, 0, 0)]


def test_names(spark):
    name, state = x.team_name(F.col("raw"))
    assert rows(spark.createDataFrame([(n[0],) for n in NAMES], "raw string").select("raw", name, state)) == sorted(NAMES, key=str)
    got = spark.createDataFrame([(n,) for n, _ in PLAUSIBLE], "name string").select("name", x.plausible(F.col("name")), x.placeholder(F.col("name")))
    assert rows(got) == sorted([(n, p, n == "TBA") for n, p in PLAUSIBLE], key=str)
    agree = spark.createDataFrame([r[:2] for r in AGREE], "a string, b string").select("a", "b", x.tokens_agree(F.col("a"), F.col("b")))
    assert rows(agree) == sorted(AGREE, key=str)
    keys = spark.createDataFrame([("Sable ", " Norrin"), ("Osk", ""), ("Pell.", "-")], "s string, c string").select(x.team_key(F.col("s"), F.col("c")))
    assert rows(keys) == [("Osk",), ("Pell",), ("Sable (Norrin)",)]


def test_lines(spark):
    got = spark.createDataFrame([(r[0],) for r in LINES], "line string").select("line", x.match_line(F.col("line")).alias("m")).select("line", "m.*")
    assert rows(got) == sorted(LINES, key=str)


def test_picks(spark):
    picks = x.parse_picks(spark.createDataFrame([(PICKS,)], "flat string"))
    assert rows(picks.drop("pick")) == [(7, "Fenwick Science Acad", "Rook Lane", True, 14, 0.8), (7, "Lark Hill", "Dunmere", False, 10, 0.71), (7, "Osk", "Elling Thornway", False, 31, 0.96), (7, "Sable", "Tamsin", False, 5, 0.6)]
    got = x.match_picks(picks, spark.createDataFrame([(7, h, a) for h, a in NEXT], "wk int, home string, away string")).select("home", "away", "home_margin", "home_p")
    assert rows(got) == sorted([("Dunmere (Penwick)", "Lark Hill (Penwick)", -10, 0.29), ("Thornway (Elling)", "Osk (Bramley)", -31, 0.04), ("Tamsin (Tamsin)", "Sable (Norrin)", -5, 0.4), ("Fenwick Science Academy (Corrow)", "Rook Lane (Penwick)", 14, 0.8)], key=str)


def test_rankings_by_three_tiers(spark):
    pairs = spark.createDataFrame(PAIRS, "school string, city string")
    lines = "<p>Standing</p><p>3t 4-1 1507 Tamsin Tamsin 12.250</p><p>41 0-5 612 Upper Corrow Corrow Lake Friends School 1.063 more</p><p>7 18-0 2 Y Played 4.5</p>"
    pages = spark.createDataFrame([(1, TABLE), (2, f"<p>{RANKS}</p>"), (3, lines), (4, "<p>nothing</p>")], "page int, html string")
    by_line = [(3, "text", "Tamsin", "Tamsin", "1507", 4, 1, 0, 12.25), (3, "text", "Corrow Lake Friends School", "Upper Corrow", "612", 0, 5, 0, 1.063)]
    assert rows(x.ranking(pages, pairs)) == sorted([*RANKED, *by_line], key=str)
    names = spark.createDataFrame([("Sable (Norrin)",), ("Osk",), ("Rook Lane (annex) (Penwick)",), ("Sable (Norrin)",)], "name string")
    assert rows(x.known_pairs(names)) == [("Rook Lane (annex)", "Penwick"), ("Sable", "Norrin")]


def test_a_roster_of_all_regions(spark):
    rows_ = spark.createDataFrame([(1, "Osk", "Pell", "2"), (1, "Osk", "Pell", "1"), (2, "Osk", "", "3"), (5, "Ivo", "Ivo", "4")], "region int, school string, city string, school_id string")
    got = x.region_roster(rows_, [1, 2, 5], ("I", "II")).select("region", "name", "division", "school_id")
    assert rows(got) == [(1, "Osk (Pell)", "I", "1"), (2, "Osk", "I", "3"), (5, "Ivo (Ivo)", "II", "4")]
    with pytest.raises(Exception, match="regions without a team: 3"):
        x.region_roster(rows_, [1, 2, 3, 5], ("I", "II")).collect()


def test_reading_stops_at_an_empty_week(spark):
    found = spark.createDataFrame([("a", 1, 4), ("a", 2, 2), ("a", 3, 0), ("a", 4, 5), ("a", 5, 0), ("b", 1, 1)], "s string, wk int, found int")
    assert rows(x.weeks_read(found, ["s"])) == [("a", 1, False), ("a", 2, False), ("a", 3, True), ("b", 1, False)]


def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "log")
    assert files.current(spark, path) is None and files.read_current(spark, path, "id bigint").count() == 0
    files.write_guarded(spark.range(100), path)
    files.stage(spark.range(7), path)  # written, but never committed
    assert files.read_current(spark, path, "id bigint").count() == 100
    with pytest.raises(ValueError, match="far fewer"):
        files.write_guarded(spark.range(79), path)
    assert files.read_current(spark, path, "id bigint").count() == 100
    assert files.write_guarded(spark.range(80), path) == 80 and files.read_current(spark, path, "id bigint").count() == 80
    with pytest.raises(ValueError, match="no games"):
        files.write_guarded(spark.range(0), path)


GUARDS = [(0, 10, "games", "no games"), (79, 100, "games", "far fewer games than before"), (80, 100, "games", None), (5, 40, "games", None), (0, 51, "fixtures", "all fixtures gone"), (0, 50, "fixtures", None)]


def test_guards_names_and_retries(spark):
    one = spark.range(1)
    assert [one.select(files.verdict(F.lit(n), F.lit(b), k)).first()[0] for n, b, k, _ in GUARDS] == [g[3] for g in GUARDS]
    names = spark.createDataFrame([("1999/games_2025.csv",), ("x/schedule_1999_2.csv",), ("games.csv",)], "f string")
    assert [r[0] for r in names.select(files.season_of(F.col("f"))).collect()] == [2025, 1999, None]
    status = spark.createDataFrame([(500,), (404,), (None,)], "s int")
    assert [(r[0], r[1]) for r in status.select(files.retries(F.col("s")), files.waits(F.col("s"))).collect()] == [(True, [1.5, 3.0]), (False, []), (True, [1.5, 3.0])]


def test_a_document_of_many_lines(spark, tmp_path):
    (tmp_path / "prior.json").write_text('{\n "meta": {"season": 2030, "carry": 0.6},\n "divisionEffects": {"I": 5.25},\n "prior": {"1507": 3.125, "88": -14.0}\n}')
    effects, devs = files.prior_table(files.read_document(spark, str(tmp_path / "prior.json"), files.PRIOR))
    assert rows(effects) == [(2030, "I", 5.25)] and rows(devs) == [(2030, "1507", 3.125), (2030, "88", -14.0)]
    assert files.read_document(spark, str(tmp_path / "none.json"), files.PRIOR).count() == 0
