"""Invariants of the operators on tiny seasons."""

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import extract, scales
from tallyspark.operators import compare, forecast, history, identity, lineage, qualifier, ratings, records, simulate

GAMES = "season int, wk int, game_id bigint, home bigint, away bigint, hs int, aw int, neutral boolean"
ROSTER = "team bigint, name string, school_id string, division string, region int, in_league boolean"


def games(spark, rows):
    return spark.createDataFrame([(2000, wk, k, h, a, hs, aw, n) for k, (wk, h, a, hs, aw, n) in enumerate(rows)], GAMES)


def fitted(spark, rows, **more):
    return {r["team"]: r["rating"] for r in ratings.fit(games(spark, rows), ["season"], **more).collect()}


def test_winner_is_rated_above_and_ratings_are_centred(spark):
    for kind in ("margin", "binary", "points"):
        r = fitted(spark, [(1, 1, 2, 21, 7, True), (1, 3, 4, 30, 0, True)], kind=kind)
        assert r[1] > r[2] and r[3] > r[4] and abs(sum(v for k, v in r.items() if k > 0)) < 1e-6


def test_neutral_games_give_no_home_advantage(spark):
    assert fitted(spark, [(1, 1, 2, 21, 7, True)])[-1] == 0
    assert fitted(spark, [(1, 1, 2, 21, 7, False), (2, 2, 1, 21, 7, False)])[-1] > 0


def test_binary_ignores_margins(spark):
    a, b = fitted(spark, [(1, 1, 2, 1, 0, True)], kind="binary"), fitted(spark, [(1, 1, 2, 49, 0, True)], kind="binary")
    assert a[1] == pytest.approx(b[1])


def test_newton_against_gradient(spark):
    rng = np.random.default_rng(1)
    home, away = rng.integers(0, 12, 80), rng.integers(0, 12, 80)
    keep = home != away
    home, away = home[keep], away[keep]
    y, n, w = rng.random(len(home)), np.zeros(len(home), bool), np.ones(len(home))
    x, h = ratings.newton(home, away, n, y, w, 12, 0.1)
    p = 1 / (1 + np.exp(-(x[home] - x[away] + h)))
    g = np.bincount(home, p - y, 12) - np.bincount(away, p - y, 12) + 0.1 * x
    assert np.abs(g).max() < 1e-7 and abs((p - y).sum()) < 1e-7


def test_rounds_reach_the_same_fit(spark):
    rows = [(1, a, b, (a * 7 + b * 3) % 30, (b * 5 + a) % 30, False) for a, b in itertools.permutations(range(1, 6), 2)]
    one = fitted(spark, rows)
    many = {r["team"]: r["rating"] for r in ratings.fit_by_rounds(games(spark, rows)).collect()}
    assert one.keys() == many.keys() and all(abs(one[t] - many[t]) < 1e-3 for t in one)


@pytest.mark.parametrize("kind", ["margin", "points", "binary"])
def test_a_large_fit_goes_by_rounds_and_ends_alike(spark, monkeypatch, kind):
    rows = [(1, a, b, (a * 7 + b * 3) % 30, (b * 5 + a) % 30, a == 1) for a, b in itertools.permutations(range(1, 5), 2)]
    prior = spark.createDataFrame([(2000, 9, 6.0), (2000, 1, -3.0)], "season int, team bigint, prior double") if kind == "margin" else None
    one = fitted(spark, rows, kind=kind, priors=prior)
    monkeypatch.setattr(ratings, "PAIRS", 3)
    many = fitted(spark, rows, kind=kind, priors=prior)
    assert one.keys() == many.keys() and all(abs(one[t] - many[t]) < 1e-3 for t in one)


def test_thirty_rounds_cost_the_same_each(spark):
    """A loop of joins over tables of Rounds: the last ten of thirty take no longer than three times the first ten."""
    tables = lineage.Rounds(spark)
    state, took = tables.write("state", spark.range(50).selectExpr("id", "0D as x")), []
    for _ in range(30):
        began = time.time()
        step = state.join(state.select((F.col("id") + 1).alias("id"), F.col("x").alias("y")), "id", "left")
        state = tables.write("state", step.select("id", (F.coalesce("y", F.lit(0.0)) + 1).alias("x")))
        took.append(time.time() - began)
    assert sum(took[-10:]) < 3 * sum(took[:10])
    assert {r.id: r.x for r in state.collect()} == {k: min(k + 1, 30) for k in range(50)}


def test_a_long_chain_is_one_component(spark):
    order = np.random.default_rng(1).permutation(5000).tolist()
    edges = spark.createDataFrame([*zip(order, order[1:]), (9001, 9000), (9002, 9002)], "a bigint, b bigint")
    got = {r.node: r.root for r in forecast.components(edges).collect()}
    assert got == {**dict.fromkeys(range(5000), 0), 9000: 9000, 9001: 9000, 9002: 9002}


def test_ten_thousand_teams_in_one_task():
    """No matrix of teams by teams: the gradient vanishes on a graph of 10,000 teams."""
    rng = np.random.default_rng(2)
    n = 10_000
    home, away = rng.integers(0, n, 60_000), rng.integers(0, n, 60_000)
    keep = home != away
    home, away = home[keep], away[keep]
    y, w, neutral = rng.random(len(home)), rng.integers(1, 4, len(home)).astype(float), rng.random(len(home)) < 0.2
    x, h = ratings.newton(home, away, neutral, y, w, n, 0.125)
    p = 1 / (1 + np.exp(-(x[home] - x[away] + np.where(neutral, 0, h))))
    g = np.bincount(home, w * (p - y), n) - np.bincount(away, w * (p - y), n) + 0.125 * x
    assert np.abs(g).max() < 1e-7 and abs((w * (p - y))[~neutral].sum()) < 1e-6


def test_a_prior_holds_a_team_without_games(spark):
    prior = spark.createDataFrame([(2000, 9, 10.0), (2000, 1, 0.0)], "season int, team bigint, prior double")
    r = {x["team"]: x["rating"] for x in ratings.fit(games(spark, [(1, 1, 2, 7, 7, True)]), ["season"], priors=prior).collect()}
    assert r[9] > r[1] and 9 in r


def roster(spark, rows):
    return spark.createDataFrame([(t, f"T{t}", str(t), d, r, lg) for t, d, r, lg in rows], ROSTER)


def test_qualifier_arithmetic(spark):
    teams = roster(spark, [(1, "V", 1, True), (2, "V", 1, True), (3, "I", 1, True), (4, None, 1, False), (5, "II", 1, True)])
    season = games(spark, [(1, 1, 2, 20, 10, True), (1, 2, 3, 20, 10, True), (2, 5, 4, 7, 7, True), (3, 5, 3, 9, 0, True), (41, 1, 3, 9, 0, True)])
    p = {r["team"]: r["points"] for r in qualifier.points(teams, qualifier.regular(season)).collect()}
    assert p[1] == 4.5 + 6.5 and p[2] == 6.5 / 2 and p[5] == 6.5 / 2 and p[4] == 0.0
    assert [r["team"] for r in qualifier.leans_outside(teams, season).collect()] == []
    top = qualifier.qualifiers(teams, qualifier.points(teams, season), per_region=2).collect()
    assert [(r["seed"], r["team"]) for r in sorted(top, key=lambda r: r["seed"])][0] == (1, 1) and len(top) == 2


def test_every_projection_is_plausible(spark):
    grid = spark.range(-140, 141).select((F.col("id") / 2).alias("m"), F.explode(F.sequence(F.lit(10), F.lit(100))).alias("t"))
    rows = grid.select("m", forecast.projected_score(F.col("m"), F.col("t").cast("double")).alias("s")).select("m", "s.h", "s.a")
    bad = rows.filter(F.col("h").isin(*forecast.IMPLAUSIBLE) | F.col("a").isin(*forecast.IMPLAUSIBLE) | (F.abs(F.col("h") - F.col("a") - F.col("m")) > 1.1) | ((F.abs("m") >= 0.5) & (F.signum(F.col("h") - F.col("a")) != F.signum("m"))))
    assert bad.count() == 0


def toy(spark, n):
    teams = roster(spark, [(t, "V", 1 + (t > 4), True) for t in range(1, 9)])
    pairs = [p for ts in ((1, 2, 3, 4), (5, 6, 7, 8)) for p in itertools.combinations(ts, 2)]
    open_games = spark.createDataFrame([(k, h, a, 0.5) for k, (h, a) in enumerate(pairs)], "game_id bigint, home bigint, away bigint, p double")
    drawn = simulate.draws(open_games, n).checkpoint()
    return open_games, drawn, simulate.seeds(simulate.simulate(teams, games(spark, []), drawn, n), n).checkpoint()


def test_odds_add_up_and_even_teams_are_even(spark):
    n = 1500
    open_games, drawn, seeded = toy(spark, n)
    odds = simulate.summary(simulate.by_run(seeded), per_region=2).collect()
    assert sum(r["playoff"] for r in odds) == pytest.approx(4, abs=0.01)
    assert all(abs(r["playoff"] - 0.5) < 0.07 for r in odds)
    own = {(r["team"], r["game_id"]): r for r in simulate.own_swings(seeded, drawn, n, per_region=2).collect()}
    assert len(own) == 24 and all(r["swing"] > 0 for r in own.values())
    assert simulate.own_swings(seeded, drawn, n, per_region=2, least=n).count() == 0


def by_hand(spark, drawn, seeded, n, per_region):
    """{(team, game_id): (odds given a home win, given an away win)} over the regions that a game touches, from single runs."""
    won = {r.game_id: (r.home, r.away, [r.won[s // 64] >> (s % 64) & 1 for s in range(n)]) for r in drawn.collect()}
    runs = {}
    for r in simulate.by_run(seeded).collect():
        runs.setdefault((r.team, r.region), {})[r.sim] = r.seed <= per_region
    region = {t: g for t, g in runs}
    out = {}
    for (team, place), q in runs.items():
        for game, (home, away, w) in won.items():
            if place in (region.get(home), region.get(away)):
                mean = lambda x: sum(x) / len(x)
                out[team, game] = tuple(mean([q[s] for s in range(n) if w[s] == side]) for side in (1, 0))
    return out, won


def test_tiles_keep_what_a_whole_table_would(spark, monkeypatch):
    n = 1000
    _, drawn, seeded = toy(spark, n)
    odds, won = by_hand(spark, drawn, seeded, n, simulate.PER_REGION)
    assert len(odds) == 8 * 6
    monkeypatch.setattr(simulate, "TEAMS", 3)
    monkeypatch.setattr(simulate, "GAMES", 2)
    monkeypatch.setattr(simulate, "PER_REGION", 2)
    monkeypatch.setattr(simulate.tiles, "__defaults__", (2, 300))
    odds, _ = by_hand(spark, drawn, seeded, n, 2)
    want = []
    for team in range(1, 9):
        others = sorted((-abs(round(h - a, 9)), g) for (t, g), (h, a) in odds.items() if t == team and team not in won[g][:2] and abs(round(h - a, 9)) >= 0.005)
        want += [(team, k + 1, g) for k, (_, g) in enumerate(others[:3])]
    got = sorted((r.team, r["rank"], r.game_id) for r in simulate.scoreboard_watch(seeded, drawn, n).collect())
    assert got == sorted(want)
    (r,) = simulate.total_probability(seeded, drawn, n).collect()
    assert (r.pairs, r.broken) == (48, 0)


def test_draws_do_not_depend_on_partitions(spark):
    g = spark.createDataFrame([(k, 1, 2, 0.3) for k in range(40)], "game_id bigint, home bigint, away bigint, p double")
    key = lambda df: sorted(map(tuple, simulate.draws(df, 90).collect()))
    assert key(g.repartition(1)) == key(g.repartition(7))


def test_record_freezes_what_was_played(spark):
    kind = "season int, through int, kind string, pred array<struct<wk:int,home:bigint,away:bigint,margin:double,p:double>>"
    log = spark.createDataFrame([(2000, 1, "live", [(2, 1, 2, 3.0, 0.6)])], kind)
    new = spark.createDataFrame([(2000, 1, "live", [(2, 1, 2, 9.0, 0.9)])], kind)
    none = spark.createDataFrame([], "season int, wk int, home bigint, away bigint")
    done = spark.createDataFrame([(2000, 2, 1, 2)], none.schema)
    assert history.record(log, new, none).first()["action"] == "replaced"
    assert history.record(log, new, done).first()["action"] == "kept"
    assert history.record(log.limit(0), new, done).first()["action"] == "appended"


def test_streamed_log_is_the_batch_log(spark, tmp_path):
    from tallyspark.streaming.log import latest, run_log

    kind = "season int, through int, kind string, pred array<struct<wk:int,home:bigint,away:bigint,margin:double,p:double>>"
    first, second = spark.createDataFrame([(2000, 1, "live", [(2, 1, 2, 3.0, 0.6)])], kind), spark.createDataFrame([(2000, 1, "live", [(2, 1, 2, 9.0, 0.9)]), (2000, 2, "live", [(3, 1, 2, 1.0, 0.5)])], kind)
    none = spark.createDataFrame([], "season int, wk int, home bigint, away bigint")
    source, folder = str(tmp_path / "in"), str(tmp_path / "log")
    for df in (first, second):
        df.write.mode("append").json(source)
        run_log(spark.readStream.schema(kind).json(source), none, folder, str(tmp_path / "cp")).awaitTermination()
    log, version = latest(spark, folder, first.schema)
    assert version == 1 and sorted((r["through"], r["pred"][0]["margin"]) for r in log.collect()) == [(1, 9.0), (2, 1.0)]


def test_exact_p(spark):
    p = lambda b, c: spark.range(1).select(compare.binomial_p(F.lit(b).cast("bigint"), F.lit(c).cast("bigint")).alias("p")).first()["p"]
    assert p(1, 0) == 1.0 and p(0, 0) == 1.0 and p(50, 0) < 1e-10 and p(8, 2) == pytest.approx(0.109375) and p(1500, 1400) == pytest.approx(0.0662, abs=0.002)


def test_no_record_reaches_into_the_next(spark):
    flat = "2031-09-12 7pm Quillby (Tarn) at Vellmar (Ostrand) cancel 2031-09-12 8pm Marl Fenwick (Corrow) 6 at Thornway (Elling) 41"
    rows = extract.parse_records(extract.page_records(spark.createDataFrame([(1, flat)], "page int, flat string"))).collect()
    assert [(r["kind"], r["away"], r["home"]) for r in rows] == [("called off", "Quillby (Tarn)", "Vellmar (Ostrand)"), ("game", "Marl Fenwick (Corrow)", "Thornway (Elling)")]


def test_a_page_that_cannot_be_parsed_is_fast(spark):
    import time

    flat = " ".join(f"2023-10-06 7pm Some Long Name Without A City {k} at nowhere in particular" for k in range(400))
    began = time.time()
    assert extract.parse_records(extract.page_records(spark.createDataFrame([(1, flat)], "page int, flat string"))).filter("kind <> 'unrecognised'").count() == 0
    assert time.time() - began < 10


def test_identity_splits_same_week_games_and_loses_none(spark):
    rows = [(2000, 1, 1, "Perry", "A"), (2000, 1, 2, "Perry", "B"), (2000, 2, 3, "Perry", "A"), (2000, 2, 4, "Out", "B")]
    g = spark.createDataFrame(rows, "season int, wk int, game_id bigint, home string, away string")
    slots = spark.createDataFrame([("Perry", "1", "V", 1), ("Perry", "2", "V", 9), ("A", "3", "I", 1), ("B", "4", "I", 9)], "name string, school_id string, division string, region int")
    apps = identity.named_appearances(g)
    settled = identity.classes(apps, slots)
    kinds = {r["name"]: r["class"] for r in settled.collect()}
    assert kinds == {"Perry": "deferred", "A": "one", "B": "one", "Out": "outside"}
    log_p = identity.region_log_p(identity.region_counts(g, identity.settled_regions(settled, slots)))
    assigned = identity.assign(apps, settled, slots, log_p)
    out = {r["game_id"]: r for r in identity.resolve_games(g, apps, settled, assigned, slots).collect()}
    assert len(out) == 4 and out[1]["home"] != out[2]["home"] and out[4]["home"] == "OOS::Out"


def test_scales(spark):
    rows = spark.range(0, 17).select(scales.prob_scale(F.col("id").cast("double"), F.lit(False)).alias("s")).collect()
    assert rows[0]["s"] == 9.0 and all(a["s"] >= b["s"] for a, b in zip(rows[1:], rows[2:]))


def test_ranks_follow_ratings(spark):
    r = spark.createDataFrame([(t, float(t % 7) * 3.3) for t in range(1, 40)], "team bigint, rating double")
    teams = roster(spark, [(t, "V", 1, True) for t in range(1, 40)])
    rec = r.select("team", F.lit(1).alias("games"))
    got = [x["team"] for x in records.ranks(r, teams, rec).orderBy("overall").collect()]
    assert got == [x["team"] for x in r.orderBy(F.desc("rating"), "team").collect()]


@pytest.mark.parametrize("largest,teams,n_games,label", [(10, 10, 9, "none"), (10, 10, 10, "medium"), (10, 10, 19, "medium"), (10, 10, 20, "high"), (9, 10, 20, "high"), (89, 100, 700, "medium"), (60, 100, 700, "medium"), (59, 100, 700, "low"), (55, 100, 350, "low"), (25, 100, 700, "low"), (24, 100, 700, "none")])
def test_connectivity_labels_at_their_borders(spark, largest, teams, n_games, label):
    # what is not in the largest component is in pairs and single teams
    labels = [(k, 0) for k in range(largest)] + [(k, k - (k - largest) % 2) for k in range(largest, teams)]
    got = forecast.connectivity(spark.createDataFrame(labels, "node bigint, root bigint"), spark.range(n_games)).first()
    assert (got.teams, got.largest, got.label) == (teams, largest, label)


def test_shapes_of_very_long_records(spark):
    rows = spark.createDataFrame([("word " * 500_000 + "7",), ("2024-09-01 7pm A b 12",)], "t string")
    assert [r.s for r in rows.select(extract.shape(F.col("t")).alias("s")).collect()] == ["w #", "<DATE> <TIME> w #"]
