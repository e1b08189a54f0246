"""The model's scales as column expressions; margins are seen from the home side."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    """Constants of the model: fit scale and cap, prior weight, and the curve from margin to probability."""

    scale: float = 9.0
    cap: float = 49.0
    prior_games: float = 0.5
    prob_a: float = 19.6807
    prob_b: float = 82.7213
    prob_min: float = 3.0
    prob_max: float = 20.0
    margin_scale: float = 1.4708


CONFIG = Config()


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def squash(margin: Column, scale: float, cap: float) -> Column:
    """A margin as a share of a win: capped, then through the logistic."""
    return logistic(F.greatest(F.lit(-cap), F.least(F.lit(cap), margin)) / F.lit(scale))


def prob_scale(games: Column, stand_in: Column, cfg: Config = CONFIG) -> Column:
    """Points per logit: flatter the fewer games stand behind the thinner side; flattest for a stand-in."""
    curve = F.sqrt(F.lit(max(cfg.prob_a, 0.1)) + F.lit(max(cfg.prob_b, 0.0)) / F.greatest(games, F.lit(1.0)))
    return F.when(stand_in, cfg.prob_max).when(games < 1, cfg.scale).otherwise(F.greatest(F.lit(cfg.prob_min), F.least(F.lit(cfg.prob_max), curve)))


def win_probability(margin: Column, games: Column, stand_in: Column, cfg: Config = CONFIG) -> Column:
    return logistic(margin / prob_scale(games, stand_in, cfg))


def log_loss(p: Column, won: Column, floor: float = 1e-6) -> Column:
    q = F.greatest(F.lit(floor), F.least(F.lit(1 - floor), p))
    return -F.when(won, F.ln(q)).otherwise(F.ln(1 - q))
