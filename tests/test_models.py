"""Choice and calibration of models, priors across seasons, identity, named forecasts and the rules of the report, on small tables."""

import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.functions.scales import CONFIG
from tallyspark.operators import audit, calibrate, forecast, identity, priors, ratings, tuning
from tallyspark.plans import arena

GAMES = "season int, wk int, game_id bigint, home bigint, away bigint, hs int, aw int, neutral boolean"


def test_the_grid_is_what_single_fits_give(spark, sf):
    """Shared sums, columns side by side and warm starts against one walk-forward run of every configuration."""
    configs = [(i, *c) for i, c in enumerate(product((6.0, 10.0), (0.1, 0.75), (0.5, 0.9), (0.0, 1.5)))]
    games, roster = arena.dense_games(spark, sf), arena.dense_roster(spark, sf)
    frame = spark.createDataFrame(configs, "config int, scale double, prior_games double, carry double, division_weight double")
    one = tuning.losses(tuning.walk_forward(games, [4, 30], roster, frame, (1999, 2000))).groupBy("config", "season", F.col("wk").alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.sum("loss").alias("loss"), F.sum("right").alias("right"), F.sum("error").alias("error"))
    want = {(r.config, r.season, r.fold): r for r in one.collect()}
    got = {(r.config, r.season, r.fold): r for r in tuning.grid_losses(games, [4, 30], roster, configs, (1999, 2000)).collect()}
    assert set(got) == set(want) and len(got) == 16 * 4
    for k, w in want.items():
        assert got[k].n == w.n and got[k].right == w.right
        assert got[k].loss == pytest.approx(w.loss, rel=1e-6) and got[k].error == pytest.approx(w.error, rel=1e-6)


def test_many_fits_at_once_are_single_fits():
    rng = np.random.default_rng(0)
    home, away, neutral = rng.integers(0, 30, 300), rng.integers(30, 60, 300), rng.random(300) < 0.3
    y, w, centres = rng.random(300), rng.integers(1, 4, 300).astype(float), rng.normal(size=(60, 4))
    theta = ratings.newton_many(home, away, neutral, y, w, 60, 0.2, centres)
    for k in range(4):
        x, hfa = ratings.newton(home, away, neutral, y, w, 60, 0.2, centres[:, k])
        assert np.allclose(theta[:60, k] - theta[:60, k].mean(), x, atol=1e-7) and theta[60, k] == pytest.approx(hfa, abs=1e-7)


def test_three_fits_at_once_are_three_fits(spark):
    rng = np.random.default_rng(2)
    rows = [(2000 + k % 2, 1, k, int(a), int(b), int(x), int(y), bool(k % 3 == 0)) for k, (a, b, x, y) in enumerate(zip(rng.integers(1, 7, 120), rng.integers(7, 12, 120), rng.integers(0, 90, 120), rng.integers(0, 40, 120)))]
    games = spark.createDataFrame(rows, GAMES)
    prior = spark.createDataFrame([(2000, 1, 8.0), (2000, 50, -4.0), (2001, 2, 3.0)], "season int, team bigint, prior double")
    got = {(r.season, r.team): r for r in ratings.rate(games, ["season"], priors=prior).collect()}
    for kind, column in (("margin", "bt_margin"), ("binary", "bt_binary"), ("points", "massey")):
        one = {(r.season, r.team): r.rating for r in ratings.fit(games, ["season"], kind=kind, priors=prior).collect()}
        assert set(one) == set(got) and (2000, 50) in got
        assert {k: got[k][column] for k in got} == pytest.approx(one, abs=1e-6)
    level = {r.team: r.rating for r in ratings.fit(games.filter("season = 2000"), ["season"], advantage=False).collect()}
    assert level[-1] == 0.0


def test_the_curve_is_the_minimum(spark):
    rng = np.random.default_rng(5)
    n = 6000
    behind, margin = rng.integers(0, 12, n), np.round(rng.normal(0, 14, n), 3)
    true = np.where(behind < 1, CONFIG.scale, np.sqrt(30 + 90 / np.maximum(behind, 1)))
    actual = np.where(rng.random(n) < 1 / (1 + np.exp(-margin / true)), 3, -3)
    rows = spark.createDataFrame([(2000 + int(k) % 2, int(k) % 20, int(b), float(m), int(a)) for k, (b, m, a) in enumerate(zip(behind, margin, actual))], "season int, wk int, behind int, margin double, actual int")
    (best,) = calibrate.fit_curve(calibrate.binned(rows, []), []).collect()

    def loss(a, b):
        use = behind >= 1
        s = np.clip(np.sqrt(max(a, 0.1) + max(b, 0) / behind[use]), CONFIG.prob_min, CONFIG.prob_max)
        q = np.clip(1 / (1 + np.exp(-margin[use] / s)), 1e-6, 1 - 1e-6)
        return -np.where(actual[use] > 0, np.log(q), np.log(1 - q)).mean()

    least, at = min((loss(a, b), (a, b)) for a in np.arange(0.5, 80, 1.0) for b in np.arange(0, 260, 2.0))
    for width in (1.0, 0.25, 0.06, 0.015):
        least, at = min((loss(at[0] + i * width, at[1] + j * width * 4), (at[0] + i * width, at[1] + j * width * 4)) for i in range(-8, 9) for j in range(-8, 9))
    assert best.loss == pytest.approx(least, abs=1e-5)
    assert loss(best.a, best.b) == pytest.approx(least, abs=1e-6)
    assert calibrate.fit_curve(calibrate.binned(rows.limit(400), []), []).count() == 0
    report = calibrate.calibrate(rows).first()
    assert report.n == n and report.fitted <= report.flat and report.cv_fitted == pytest.approx(report.fitted, abs=0.01)


def test_a_school_is_followed_by_its_key(spark):
    # team, name, id, division; the second season has other numbers, names and divisions
    before = spark.createDataFrame([(k, f"S{k}", str(k) if k % 2 else "", "I" if k <= 10 else "II", 1, True) for k in range(1, 21)], "team bigint, name string, school_id string, division string, region int, in_league boolean")
    rated = spark.createDataFrame([(k, float(k)) for k in range(1, 21)], "team bigint, rating double")
    rows = [(101, "Other", "1", "II"), (102, "S2", " ", "I"), (103, "S3 new", "", "I"), (104, "New", "99", "II")]
    now = spark.createDataFrame([(*r, 1, True) for r in rows], before.schema)
    got = {r.team: r.prior for r in priors.starting_points(rated, before, now, carry=0.5).collect()}
    effect = {"I": -5.0, "II": 5.0}
    dev = lambda k, d: max(-14, min(14, 0.5 * (k - 10.5 - effect[d])))
    raw = {101: effect["II"] + dev(1, "I"), 102: effect["I"] + dev(2, "I"), 103: effect["I"], 104: effect["II"]}
    mean = sum(raw.values()) / 4
    assert got == pytest.approx({k: v - mean for k, v in raw.items()})


def test_four_games_make_a_season(spark):
    rows = [(2000, w, w, 1, 2, 20, 10, True) for w in range(1, 4)] + [(2000, 9, 9, 1, 3, 20, 10, True)]
    games = spark.createDataFrame(rows, GAMES)
    roster = spark.createDataFrame([(k, "n", str(k), "I", 1, k != 4) for k in range(1, 5)], "team bigint, name string, school_id string, division string, region int, in_league boolean")
    rated = spark.createDataFrame([(k, 1.0) for k in (-1, 1, 2, 3, 4)], "team bigint, rating double")
    assert [r.team for r in priors.full_season(rated, games, roster).collect()] == [1]


def test_ids_and_confidence(spark):
    slots = spark.createDataFrame([("Ada", "1", "V", 3), ("Ada", "2", "V", 3), ("Ada", "3", None, None)], "name string, school_id string, division string, region int")
    settled = spark.createDataFrame([("Ada", 3, 4, 4, "deferred", None), ("Out", 0, 2, 2, "outside, several", None), ("Eve", 2, 1, 2, "ambiguous", "Eve|?")], "name string, slots bigint, most bigint, n bigint, class string, id string")
    ids = sorted((r.k, r.id) for r in identity.entities(settled, slots).collect())
    assert ids == [(0, "Ada|V-3"), (1, "Ada|V-3#2"), (2, "Ada|None-None"), (3, "OOS::Ada#4")]
    weeks = lambda *gaps: spark.createDataFrame([("Ada", 2000, k, [0], g) for k, g in enumerate(gaps)], "name string, season int, wk int, order array<int>, gap double")
    for gaps, sure in (((1.5, 0.5), True), ((1.5, 0.4), False), ((None, 1.0), True), ((None,), False)):
        found = identity.confidence(weeks(*gaps))
        assert found.first().confident is sure
        kinds = {(r["name"], r.kind, r.n) for r in identity.conflicts(settled, found).collect()}
        assert kinds == {("Out", "oos-duplicate", 2), ("Eve", "ambiguous", 2)} | (set() if sure else {("Ada", "low-confidence", 4)})
        flags = {r.id: r.ambiguous for r in identity.teams(settled, slots, found).filter("name = 'Ada'").collect()}
        assert flags == {"Ada|V-3": not sure, "Ada|V-3#2": not sure, "Ada|None-None": not sure, "OOS::Ada#4": True}


def test_named_sides(spark):
    roster = spark.createDataFrame([(1, "One", True), (2, "Two", True), (3, "Two", False), (4, "Six", True), (5, "Six", True), (6, "Far", True)], "team bigint, name string, in_league boolean")
    rated = spark.createDataFrame([(k, float(k)) for k in (1, 2, 3, 4, 5)] + [(-1, 2.0)], "team bigint, rating double")
    played = spark.createDataFrame([(k, 5) for k in range(1, 6)], "team bigint, games bigint")
    profile = spark.createDataFrame([(k, 0.0, 0.0, 25.0) for k in range(1, 6)], "team bigint, offense double, defense double, league_ppg double")
    asked = spark.createDataFrame([(1, 9, "One", "Two", False), (2, 9, "One", "Six", False), (3, 9, "Far", "One", True), (4, 9, "Six", "Nobody", True)], "game_id bigint, wk int, home_name string, away_name string, neutral boolean")
    spare = spark.createDataFrame([(3.0,)], "rating double")
    got = {r.game_id: r for r in forecast.predict_named(asked, roster, rated, played, profile, stand_in=spare).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "assumed", 2: "ambiguous", 3: "stand-in", 4: "ambiguous"}
    assert (got[1].home, got[1].away, got[1].margin) == (1, 2, 1.0) and got[2].p is None and got[2].h is None and got[3].margin == 2.0
    without = {r.game_id: r.status for r in forecast.predict_named(asked, roster, rated, played, profile).collect()}
    assert without == {1: "assumed", 2: "ambiguous", 3: "unknown", 4: "ambiguous"}


def test_every_rule_sees_its_offender(spark):
    ok = {"p": 0.7, "shown": 4.0, "h": 24, "a": 20, "status": "rated", "home": 1, "away": 2, "home_known": True, "away_known": True, "was_played": False}
    wrong = [
        ({"p": 1.0}, "a probability is no probability"), ({"shown": -4.0, "h": 20, "a": 24}, "a probability contradicts its margin"), ({"h": None}, "a forecast has no score"), ({"h": -1, "a": -5}, "a score is below zero"),
        ({"h": 27}, "a score drifts from its margin"), ({"h": 9, "a": 5}, "a score is implausible"), ({"shown": 0.6, "h": 21, "a": 21}, "a favourite is not ahead"), ({"p": None, "h": None, "a": None}, "a fixture without a forecast has no reason"),
        ({"p": None, "shown": None, "status": "ambiguous"}, "a fixture without a forecast has a score"), ({"away_known": False}, "a side is on no roster"), ({"away": 1}, "a team meets itself"), ({"was_played": True}, "a game already played is still a fixture"),
    ]
    kind = "p double, shown double, h int, a int, status string, home bigint, away bigint, home_known boolean, away_known boolean, was_played boolean"
    frame = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows], kind)
    clean = audit.audit(audit.forecast_rules(), {"forecasts": frame([ok] * 20)})
    assert clean.filter("n <> 0").count() == 0 and audit.refuse(clean).count() == len(audit.forecast_rules())
    for change, rule in wrong:
        report = audit.audit(audit.forecast_rules(), {"forecasts": frame([ok] * 20 + [{**ok, **change}])})
        assert rule in [r.rule for r in report.filter("n = 1").collect()], rule
    with pytest.raises(ValueError, match=r"a team meets itself \(2\)"):
        audit.refuse(audit.audit(audit.forecast_rules(), {"forecasts": frame([ok, {**ok, "away": 1}, {**ok, "away": 1}])}))
    scans = audit.audit(audit.rating_rules(), {"ratings": spark.createDataFrame([(1, math.nan), (2, 90.0), (-1, 7.0)], "team bigint, rating double")})
    assert {r.rule: r.n for r in scans.collect()} == {"a rating is no number": 1, "a rating is out of reach": 2, "ratings are not centred": 1, "there is no home advantage": 0, "the home advantage is out of its band": 1, "few teams are rated": 1}
