"""Walk-forward evaluation, the grid of configurations, and the choice among them.

A fold holds out one week and trains on the weeks before it, from what the
season before says of every team.  Folds are
exploded onto the games of their season (an equi-join on season after a small
explode, not a range join), and every (configuration, fold) is one group of
one grouped fit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scales import CONFIG, Config, log_loss, logistic, win_probability
from ..plans.arena import safe_round
from .lineage import cut
from .priors import CARRY, CLIP, DIVISION_WEIGHT, LEAST_TEAMS
from .ratings import HFA, fit, newton_many
from .records import appearances

#: Training games under which the prior itself is the forecast, the home advantage where no season came before, and games that make a team's last season count.
LEAST_TRAIN, FIRST_ADVANTAGE, LEAST_LAST = 50, 1.5, 4
#: Numbers that a block of fits solved side by side may have, pairs times fits.
COLUMNS = 4_000_000
KNOBS = ("scale", "prior_games", "carry", "division_weight")


def folds_of(games: DataFrame, holdouts: list[int]) -> DataFrame:
    """games once for each fold that may learn from them: (fold, ...)."""
    return games.withColumn("fold", F.explode(F.filter(F.array(*map(F.lit, holdouts)), lambda f: f > F.col("wk"))))


def starts(rated: DataFrame, before: DataFrame, roster: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, season, team, in_league, effect, dev): what fits (keys, season, team, rating) of the season before say of every team of the roster.

    effect is the division's, 0 where it has too few teams; dev is a league
    team's distance from the mean and from that, null under LEAST_LAST games.
    """
    often = appearances(before).join(before.select("game_id", F.col("season")).distinct(), ["game_id", "season"]).groupBy("season", "team").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_LAST).select("season", "team")
    league = rated.join(roster.filter("in_league").select("team", "division"), "team").join(often, ["season", "team"])
    means = league.groupBy(*keys, "season").agg(F.avg("rating").alias("mean"))
    steps = league.filter("division is not null").groupBy(*keys, "season", "division").agg(F.avg("rating").alias("level"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_TEAMS)
    effects = steps.join(steps.groupBy(*keys, "season").agg(F.avg("level").alias("mid")), [*keys, "season"]).select(*keys, "season", "division", (F.col("level") - F.col("mid")).alias("effect"))
    base = means.join(roster.select("team", "division", "in_league")).join(effects, [*keys, "season", "division"], "left").join(league.select(*keys, "season", "team", "rating"), [*keys, "season", "team"], "left").withColumn("effect", F.coalesce("effect", F.lit(0.0)))
    return base.select(*keys, "season", "team", "in_league", "effect", (F.col("rating") - F.col("mean") - F.col("effect")).alias("dev"))


def last_seasons(games: DataFrame, roster: DataFrame, configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Starting points (config, season, team, prior) and advantages (config, season, hfa) that the season before each season of ``games`` gives.

    The season before is fitted once for each scale and prior weight.  A league
    team of four games or more carries its distance from the mean and from its
    division's effect, clipped; every team starts at its division's effect
    times the weight plus that, about the mean of all teams.
    """
    fits = configs.select("scale", "prior_games").distinct()
    before = games.withColumn("season", F.col("season") + 1)
    rated = fit(before.join(F.broadcast(fits.withColumn("fit", F.xxhash64("scale", "prior_games")))), ["fit", "season"])
    known = configs.withColumn("fit", F.xxhash64("scale", "prior_games"))
    own = F.coalesce(F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), F.col("dev") * F.col("carry"))), F.lit(0.0))
    raw = starts(rated, before, roster, ["fit"]).join(F.broadcast(known), "fit").select("config", "season", "team", F.when(F.col("in_league"), F.col("effect") * F.col("division_weight") + F.when(F.col("dev").isNotNull(), own).otherwise(0.0)).otherwise(0.0).alias("raw"))
    middle = raw.groupBy("config", "season").agg(F.avg("raw").alias("mid"))
    priors = raw.join(F.broadcast(middle), ["config", "season"]).select("config", "season", "team", (F.col("raw") - F.col("mid")).alias("prior"))
    return priors, rated.filter(F.col("team") == HFA).join(F.broadcast(known), "fit").select("config", "season", F.col("rating").alias("hfa"))


def met_sums(games: DataFrame, keys: list[str], cfg: Config = CONFIG) -> DataFrame:
    """(keys, home, away, neutral, m, n): how often each pair met with each capped margin; what any scale's targets are made of."""
    m = F.greatest(F.lit(-cfg.cap), F.least(F.lit(cfg.cap), (F.col("hs") - F.col("aw")).cast("double")))
    return games.groupBy(*keys, F.col("home").cast("long").alias("home"), F.col("away").cast("long").alias("away"), "neutral", m.alias("m")).agg(F.count(F.lit(1)).cast("double").alias("n"))


class Meetings:
    """Summed games of one fit as arrays, whatever the scale."""

    def __init__(self, home: np.ndarray, away: np.ndarray, neutral: np.ndarray, m: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        pair = np.stack([np.searchsorted(ids, home), np.searchsorted(ids, away), neutral.astype(np.int64)])
        pairs, self.at = np.unique(pair, axis=1, return_inverse=True)
        self.at = self.at.ravel()
        self.home, self.away, self.neutral = pairs[0], pairs[1], pairs[2].astype(bool)
        self.m, self.n, self.weight, self.teams = m, n, np.bincount(self.at, n, pairs.shape[1]), len(ids)

    def solve(self, scale: float, prior_games: float, centres: np.ndarray, start: np.ndarray | None) -> np.ndarray:
        y = np.bincount(self.at, self.n / (1 + np.exp(-self.m / scale)), len(self.weight)) / self.weight
        wide = max(1, COLUMNS // max(len(self.weight), 1))
        parts = [newton_many(self.home, self.away, self.neutral, y, self.weight, self.teams, 0.25 * prior_games, centres[:, k : k + wide], None if start is None else start[:, k : k + wide]) for k in range(0, centres.shape[1], wide)]
        return np.hstack(parts)


def grid_losses(games: DataFrame, holdouts: list[int], roster: DataFrame, configs: list[tuple], seasons: tuple[int, ...], each: bool = False) -> DataFrame:
    """(config, season, fold, n, loss, loss2, called, right, error): sums over the held-out games of each fold, for every configuration; with ``each``, (config, season, wk, game_id, loss) of every game.

    configs: (config, scale, prior_games, carry, division_weight).  Games are
    summed once by pair, ground and capped margin, before any configuration
    comes in; a fold's sums meet each scale in one task, which solves all
    configurations of a scale side by side, each prior weight from the
    solution of the one before.  The same forecasts as walk_forward(), so a
    season whose summed pairs do not fit a task is searched with that.
    """
    games = cut(games)
    scales = sorted({c[1] for c in configs})
    weights = {s: sorted({c[2] for c in configs if c[1] == s}) for s in scales}
    chosen = {(s, w): [(c[0], c[3], c[4]) for c in configs if c[1] == s and c[2] == w] for s in scales for w in weights[s]}
    every_scale = F.explode(F.array(*[F.lit(float(s)) for s in scales])).alias("scale")
    before = games.withColumn("season", F.col("season") + 1).filter(F.col("season").isin(*seasons))

    def last(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids, scale = np.unique(np.concatenate([rows.home, rows.away])), float(key[1])
        met, theta, out = Meetings(rows.home.to_numpy(), rows.away.to_numpy(), rows.neutral.to_numpy(bool), rows.m.to_numpy(), rows.n.to_numpy(), ids), None, []
        for w in weights[scale]:
            theta = met.solve(scale, w, np.zeros((len(ids), 1)), theta)
            x = theta[:, 0] * scale
            x[:-1] -= x[:-1].mean()
            out.append(pd.DataFrame({"season": key[0], "scale": scale, "prior_games": w, "team": np.append(ids, HFA), "rating": x}))
        return pd.concat(out)

    rated = cut(met_sums(before, ["season"]).select("*", every_scale).groupBy("season", "scale").applyInPandas(last, "season int, scale double, prior_games double, team bigint, rating double"))
    said = starts(rated, before, roster, ["scale", "prior_games"])
    pool = games.filter(F.col("season").isin(*seasons))
    # a game is summed with the first fold that may learn from it, then handed to the later ones
    sums = cut(met_sums(pool.withColumn("first", F.array_min(F.filter(F.array(*map(F.lit, holdouts)), lambda f: f > F.col("wk")))).filter("first is not null"), ["season", "first"]))
    folds = F.array(*map(F.lit, holdouts))
    none = lambda kind: F.lit(None).cast(kind)
    # never null: a null would make floats of all ids
    no_game = F.lit(0).cast("bigint").alias("game_id")
    # one table of four kinds of row: learning games, held-out games, what is said of teams, last season's advantage
    learn = sums.select("season", F.explode(F.filter(folds, lambda f: f >= F.col("first"))).alias("fold"), every_scale, "home", "away", "neutral", "m", "n").select("season", "fold", "scale", F.lit(0).alias("kind"), none("double").alias("weight"), "home", "away", F.col("neutral").alias("flag"), F.col("m").alias("x"), F.col("n").alias("y"), no_game)
    test = pool.filter(F.col("wk").isin(*holdouts)).select("season", F.col("wk").alias("fold"), every_scale, "game_id", "home", "away", "neutral", "hs", "aw").select("season", "fold", "scale", F.lit(1).alias("kind"), none("double").alias("weight"), F.col("home").cast("bigint").alias("home"), F.col("away").cast("bigint").alias("away"), F.col("neutral").alias("flag"), (F.col("hs") - F.col("aw")).cast("double").alias("x"), none("double").alias("y"), F.col("game_id").cast("bigint").alias("game_id"))
    each_fold = F.explode(folds).alias("fold")
    teams = said.select("season", each_fold, "scale", F.lit(2).alias("kind"), F.col("prior_games").alias("weight"), F.col("team").cast("bigint").alias("home"), none("bigint").alias("away"), F.col("in_league").alias("flag"), F.col("effect").alias("x"), F.col("dev").alias("y"), no_game)
    ground = rated.filter(F.col("team") == HFA).select("season", each_fold, "scale", F.lit(3).alias("kind"), F.col("prior_games").alias("weight"), none("bigint").alias("home"), none("bigint").alias("away"), none("boolean").alias("flag"), F.col("rating").alias("x"), none("double").alias("y"), no_game)
    # teams that no season before spoke of are there too, with nothing said
    unsaid = roster.select(F.explode(F.array(*[F.lit(int(s)).cast("int") for s in seasons])).alias("season"), F.col("team").cast("bigint").alias("home")).select("season", each_fold, every_scale, "home").select("season", "fold", "scale", F.lit(4).alias("kind"), none("double").alias("weight"), "home", none("bigint").alias("away"), none("boolean").alias("flag"), none("double").alias("x"), none("double").alias("y"), no_game)
    schema = "season int, fold int, scale double, prior_games double, game_id bigint, losses array<double>" if each else "config int, season int, fold int, n bigint, loss double, loss2 double, called bigint, right bigint, error double"
    names = [c.split()[0] for c in schema.split(", ")]

    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        season, fold, scale = int(key[0]), int(key[1]), float(key[2])
        of = {k: rows[rows.kind == k] for k in range(5)}
        if of[1].empty:
            return pd.DataFrame({n: [] for n in names})
        ids = np.unique(np.concatenate([of[4].home, of[0].home, of[0].away]).astype(np.int64))
        place = lambda c: np.searchsorted(ids, c.to_numpy(np.int64))
        enough = of[0].y.sum() >= LEAST_TRAIN
        if enough:
            g = of[0].sort_values(["home", "away", "flag", "x"])
            met = Meetings(g.home.to_numpy(np.int64), g.away.to_numpy(np.int64), g.flag.to_numpy(bool), g.x.to_numpy(), g.y.to_numpy(), ids)
        h, a, away_ground, actual = place(of[1].home), place(of[1].away), ~of[1].flag.to_numpy(bool), of[1].x.to_numpy()
        won, tie = actual > 0, actual == 0
        theta, out = None, []
        for w in weights[scale]:
            ours = of[2][of[2].weight == w]
            at, league, effect, dev = place(ours.home), ours.flag.to_numpy(bool), ours.x.to_numpy(), ours.y.to_numpy(float)
            raw = np.zeros((len(ids), len(chosen[scale, w])))
            for k, (_, carry, share) in enumerate(chosen[scale, w]):
                raw[at, k] = np.where(league, effect * share + np.nan_to_num(np.clip(dev * carry, -CLIP, CLIP)), 0.0)
            prior = np.zeros_like(raw)
            # the mean is that of the teams that were spoken of; the others start at 0
            if len(at):
                prior[at] = raw[at] - raw[at].mean(0)
            if enough:
                theta = met.solve(scale, w, prior / scale, theta if theta is not None and theta.shape[1] == raw.shape[1] else None)
                x = theta[:-1] * scale
                x, ground_ = x - x.mean(0), theta[-1] * scale
            else:
                first = of[3].x[of[3].weight == w]
                x, ground_ = prior, np.full(raw.shape[1], float(first.iloc[0]) if len(first) else FIRST_ADVANTAGE)
            margin = x[h] - x[a] + away_ground[:, None] * ground_
            q = np.clip(1 / (1 + np.exp(-margin / scale)), 1e-6, 1 - 1e-6)
            loss = np.where(tie[:, None], -(np.log(q) + np.log(1 - q)) / 2, -np.log(np.where(won[:, None], q, 1 - q)))
            if each:
                out.append(pd.DataFrame({"season": season, "fold": fold, "scale": scale, "prior_games": w, "game_id": of[1].game_id.to_numpy(np.int64), "losses": list(loss)}))
                continue
            right = ((margin > 0) == won[:, None]) & ~tie[:, None]
            out.append(pd.DataFrame({"config": [c[0] for c in chosen[scale, w]], "season": season, "fold": fold, "n": len(actual), "loss": loss.sum(0), "loss2": (loss * loss).sum(0), "called": int((~tie).sum()), "right": right.sum(0), "error": np.abs(margin - actual[:, None]).sum(0)}))
        return pd.concat(out)

    table = learn.unionByName(test).unionByName(teams).unionByName(ground).unionByName(unsaid)
    found = table.groupBy("season", "fold", "scale").applyInPandas(search, schema)
    if not each:
        return found
    # a game's losses stay beside each other in the table that is written
    known = games.sparkSession.createDataFrame([(float(s), float(w), [int(c[0]) for c in chosen[s, w]]) for s, w in chosen], "scale double, prior_games double, configs array<int>")
    pairs = F.explode(F.arrays_zip("configs", "losses")).alias("c")
    return cut(found).join(F.broadcast(known), ["scale", "prior_games"]).select("season", F.col("fold").alias("wk"), "game_id", pairs).select("c.configs", "season", "wk", "game_id", "c.losses").toDF("config", "season", "wk", "game_id", "loss")


def mean_losses(sums: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, m): mean losses from the sums of grid_losses(), to nine decimals."""
    return sums.groupBy(*keys).agg(F.round(F.sum("loss") / F.sum("n"), 9).alias("m"))


def evaluate_sums(sums: DataFrame, keys: list[str]) -> DataFrame:
    """As evaluate(), from the sums of grid_losses()."""
    n, s, ss = F.sum("n"), F.sum("loss"), F.sum("loss2")
    var = F.greatest(F.lit(0.0), (ss - s * s / n) / F.greatest(n - 1, F.lit(1)))
    return sums.groupBy(*keys).agg(n.alias("games"), safe_round(s / n, 4).alias("logloss"), safe_round(F.sqrt(var / n), 4).alias("se"), safe_round(F.sum("right") / F.sum("called"), 4).alias("accuracy"), safe_round(F.sum("error") / n, 2).alias("mae"))


def walk_forward(games: DataFrame, holdouts: list[int], roster: DataFrame, configs: DataFrame | None = None, seasons: tuple[int, ...] | None = None, cfg: Config = CONFIG) -> DataFrame:
    """(config, season, wk, game_id, home, away, behind, margin, p, shown_p, actual): forecasts of every held-out game by every configuration.

    configs has config and the four KNOBS; the defaults make one if not given.
    Every team of the roster is in every fit, pulled towards what last season
    says of it, so no held-out game is left out.  A fold of fewer than
    LEAST_TRAIN games is forecast by the prior and last season's advantage.
    p is on the configuration's own scale, shown_p on the published curve;
    behind is how many games the thinner side had played.
    """
    # read by the season before, the folds, the tests and the counts
    spark, games = games.sparkSession, cut(games)
    configs = configs if configs is not None else spark.createDataFrame([(0, cfg.scale, cfg.prior_games, CARRY, DIVISION_WEIGHT)], "config int, scale double, prior_games double, carry double, division_weight double")
    pool = games.filter(F.col("season").isin(*seasons)) if seasons else games
    found, advantage = last_seasons(games, roster, configs)
    every = pool.select("season").distinct().join(roster.select("team")).join(F.broadcast(configs.select("config")))
    priors = every.join(found, ["config", "season", "team"], "left").withColumn("prior", F.coalesce("prior", F.lit(0.0)))
    train = folds_of(pool, holdouts)
    test = pool.filter(F.col("wk").isin(*holdouts)).withColumn("fold", F.col("wk"))
    sizes = test.select("season", "fold").distinct().join(train.groupBy("season", "fold").agg(F.count(F.lit(1)).alias("n")), ["season", "fold"], "left").select("season", "fold", (F.coalesce("n", F.lit(0)) >= LEAST_TRAIN).alias("enough"))
    sizes = cut(sizes)
    enough, few = sizes.filter("enough").select("season", "fold"), sizes.filter("not enough").select("season", "fold")
    fitted = fit(train.join(F.broadcast(enough), ["season", "fold"]).join(F.broadcast(configs.select("config", "scale", "prior_games"))), ["config", "season", "fold"], priors=priors.join(F.broadcast(enough), "season"))
    plain = priors.join(F.broadcast(few), "season").select("config", "season", "fold", "team", F.col("prior").alias("rating"))
    first = few.join(F.broadcast(configs.select("config"))).join(advantage, ["config", "season"], "left").select("config", "season", "fold", F.lit(HFA).cast("bigint").alias("team"), F.coalesce("hfa", F.lit(FIRST_ADVANTAGE)).alias("rating"))
    ratings = fitted.unionByName(plain).unionByName(first)
    behind = train.select("season", "fold", F.explode(F.array("home", "away")).alias("team")).groupBy("season", "fold", "team").agg(F.count(F.lit(1)).alias("n"))
    hfa = ratings.filter(F.col("team") == HFA).select("config", "season", "fold", F.col("rating").alias("hfa"))
    side = lambda c, r: ratings.select("config", "season", "fold", F.col("team").alias(c), F.col("rating").alias(r))
    n = lambda c, r: behind.select("season", "fold", F.col("team").alias(c), F.col("n").alias(r))
    rows = test.join(n("home", "nh"), ["season", "fold", "home"], "left").join(n("away", "na"), ["season", "fold", "away"], "left")
    rows = rows.join(side("home", "rh"), ["season", "fold", "home"]).join(side("away", "ra"), ["config", "season", "fold", "away"]).join(hfa, ["config", "season", "fold"]).join(F.broadcast(configs.select("config", "scale")), "config")
    margin = F.col("rh") - F.col("ra") + F.when(F.col("neutral"), 0.0).otherwise(F.col("hfa"))
    least = F.least(F.coalesce("nh", F.lit(0)), F.coalesce("na", F.lit(0)))
    shown = win_probability(margin, least.cast("double"), F.lit(False), cfg)
    return rows.select("config", "season", "wk", "game_id", "home", "away", least.alias("behind"), margin.alias("margin"), logistic(margin / F.col("scale")).alias("p"), shown.alias("shown_p"), (F.col("hs") - F.col("aw")).alias("actual"))


def losses(forecasts: DataFrame) -> DataFrame:
    """forecasts with loss (ties count half each way) and right (null for ties)."""
    tie = F.col("actual") == 0
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("p")))
    won = F.col("actual") > 0
    return forecasts.withColumns({"loss": F.when(tie, -(F.ln(q) + F.ln(1 - q)) / 2).otherwise(log_loss(F.col("p"), won)), "right": F.when(~tie, ((F.col("margin") > 0) == won).cast("int")), "error": F.abs(F.col("margin") - F.col("actual"))})


def evaluate(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, games, logloss, se, accuracy, mae): se from the sum and the sum of squares."""
    n, s, ss = F.count(F.lit(1)), F.sum("loss"), F.sum(F.col("loss") * F.col("loss"))
    var = F.greatest(F.lit(0.0), (ss - s * s / n) / F.greatest(n - 1, F.lit(1)))
    return scored.groupBy(*keys).agg(n.alias("games"), safe_round(s / n, 4).alias("logloss"), safe_round(F.sqrt(var / n), 4).alias("se"), safe_round(F.avg("right"), 4).alias("accuracy"), safe_round(F.avg("error"), 2).alias("mae"))


def tied_with_best(scored: DataFrame) -> DataFrame:
    """(config, gap, se, tied): configurations whose paired loss beside the best is within one standard error of it."""
    mean = scored.groupBy("config").agg(F.avg("loss").alias("mean"))
    best = mean.agg(F.min_by("config", F.struct(F.round("mean", 9), "config")).alias("config"))
    base = scored.join(F.broadcast(best), "config").select("season", "game_id", F.col("loss").alias("base"))
    d = scored.join(base, ["season", "game_id"]).select("config", (F.col("loss") - F.col("base")).alias("d"))
    out = d.groupBy("config").agg(F.avg("d").alias("gap"), (F.coalesce(F.stddev_samp("d"), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return out.select("config", safe_round(F.col("gap"), 5).alias("gap"), safe_round(F.col("se"), 5).alias("se"), (F.col("gap") <= F.col("se") + 1e-12).alias("tied"))


def select_config(tied: DataFrame, configs: DataFrame, ranges: dict[str, float], cfg: Config = CONFIG) -> DataFrame:
    """One row: of the tied configurations, the one nearest the defaults, each distance in units of its range."""
    usual = {"carry": CARRY, "division_weight": DIVISION_WEIGHT}
    away = sum((F.abs(F.col(c) - usual.get(c, getattr(cfg, c, 0.0))) / width for c, width in ranges.items()), F.lit(0.0))
    rows = tied.filter("tied").join(configs, "config").withColumn("away", F.round(away, 9))
    return rows.agg(F.min_by(F.struct("config", *ranges), F.struct("away", "config")).alias("b")).select("b.*")


def grid_edges(chosen: DataFrame, configs: DataFrame, names: list[str]) -> DataFrame:
    """(name, value, on_edge): whether a chosen value is the least or the most that was tried."""
    ends = configs.agg(*[f(c).alias(f"{k}_{c}") for c in names for k, f in (("lo", F.min), ("hi", F.max))])
    one = chosen.join(F.broadcast(ends))
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value"), ((F.col(c) == F.col(f"lo_{c}")) | (F.col(c) == F.col(f"hi_{c}"))).alias("on_edge")) for c in names])
    return one.select(F.explode(cells).alias("e")).select("e.*")


def stability(means: DataFrame) -> DataFrame:
    """(season, config): the best configuration of each season, of means (season, config, m)."""
    return means.groupBy("season").agg(F.min_by("config", F.struct("m", "config")).alias("config"))


def margin_scale(forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, games, slope, mae_raw, mae_fit, bias): least squares through the origin of actual on forecast margins."""
    slope = F.sum(F.col("margin") * F.col("actual")) / F.sum(F.col("margin") * F.col("margin"))
    s = forecasts.groupBy(*keys).agg(slope.alias("slope"))
    rows = forecasts.join(F.broadcast(s), keys) if keys else forecasts.join(F.broadcast(s))
    fitted = F.col("margin") * F.col("slope")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("games"), safe_round(F.first("slope"), 4).alias("slope"), safe_round(F.avg(F.abs(F.col("margin") - F.col("actual"))), 2).alias("mae_raw"), safe_round(F.avg(F.abs(fitted - F.col("actual"))), 2).alias("mae_fit"), safe_round(F.avg(fitted - F.col("actual")), 3).alias("bias"))


def curve_losses(forecasts: DataFrame, curves: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, games, loss): mean loss of the curve sqrt(a + b / behind) for every pair (a, b), ties left out."""
    rows = forecasts.filter("actual <> 0 and behind >= 1").join(F.broadcast(curves))
    scale = F.greatest(F.lit(CONFIG.prob_min), F.least(F.lit(CONFIG.prob_max), F.sqrt(F.col("a") + F.col("b") / F.col("behind"))))
    p = 1 / (1 + F.exp(-F.col("margin") / scale))
    return rows.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("games"), F.avg(log_loss(p, F.col("actual") > 0)).alias("loss"))


def fit_prob_scale(forecasts: DataFrame, curves: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, games, loss): the pair of least loss; ties to the smaller a, then b."""
    best = curve_losses(forecasts, curves, keys).groupBy(*keys).agg(F.min(F.struct(F.round("loss", 9).alias("loss"), "a", "b", "games")).alias("m"))
    return best.select(*keys, "m.a", "m.b", "m.games", safe_round(F.col("m.loss"), 5).alias("loss"))


def cross_validate(forecasts: DataFrame, curves: DataFrame) -> DataFrame:
    """(season, a, b, loss): each season's loss under the curve that the other seasons choose."""
    by = curve_losses(forecasts, curves, ["season"])
    seasons = by.select("season").distinct()
    w = Window.partitionBy("a", "b")
    others = by.withColumns({"all_loss": F.sum(F.col("loss") * F.col("games")).over(w), "all_games": F.sum("games").over(w)})
    rest = (F.col("all_loss") - F.col("loss") * F.col("games")) / (F.col("all_games") - F.col("games"))
    best = others.groupBy("season").agg(F.min(F.struct(F.round(rest, 9).alias("rest"), "a", "b", "loss", "games")).alias("m"))
    return best.select("season", "m.a", "m.b", "m.games", safe_round(F.col("m.loss"), 5).alias("loss"))
