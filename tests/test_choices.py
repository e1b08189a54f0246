"""The choices among configurations read the shared search, not one fit for each configuration."""

from itertools import product

import pytest

from tallyspark.operators import ratings, tuning
from tallyspark.plans import arena
from tallyspark.plans import queries_tuning as q


def test_losses_of_each_game_are_those_of_single_fits(spark, sf):
    configs = [(i, *c) for i, c in enumerate(product((6.0, 10.0), (0.1, 0.75), (0.5, 0.9), (0.0, 1.5)))]
    games, roster = arena.dense_games(spark, sf), arena.dense_roster(spark, sf)
    one = tuning.losses(tuning.walk_forward(games, [4, 30], roster, spark.createDataFrame(configs, q.CONFIGS), (1999, 2000)))
    want = {(r.config, r.season, r.wk, r.game_id): r.loss for r in one.collect()}
    got = {(r.config, r.season, r.wk, r.game_id): r.loss for r in tuning.grid_losses(games, [4, 30], roster, configs, (1999, 2000), each=True).collect()}
    assert got.keys() == want.keys() and got
    assert all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want)


@pytest.mark.parametrize("name", ["tied_with_best", "select_config", "grid_edges", "leaderboard", "marginal_se", "stability"])
def test_no_choice_fits_configuration_by_configuration(spark, sf, monkeypatch, name):
    def fit(*_, **__):
        raise AssertionError("one fit for each configuration")

    monkeypatch.setattr(tuning, "fit", fit)
    monkeypatch.setattr(ratings, "fit", fit)
    assert q.QUERIES[name](spark, sf).count() > 0
