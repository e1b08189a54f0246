"""Rating fits: penalised Bradley-Terry on squashed margins or results, and ridge least squares on margins.

Many fits at once (seasons, folds, configurations) are one grouped job: each
fit's games, first summed by pair and target, go to one task that solves its
sparse Newton system by conjugate gradients, so memory grows with the pairs
and not with the square of the teams.  A fit of more pairs than a task should
hold is solved by rounds of shuffles, the same Newton steps and the same
conjugate gradients with a row a team and a row a pair.  Both ways reach the
same optimum.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scales import CONFIG, squash
from .lineage import Rounds, cut

#: Summed pairs that one task may hold (some 60 bytes each); larger fits are solved by rounds.
PAIRS = 2_000_000
#: Rounds settle when no rating moves by more than this, in the fit's own units.
SETTLED = 1e-5
#: Newton steps are solved until this share of the squared residual is left, least squares until EXACT of it; no step moves a rating further than FURTHEST.
LEFT, EXACT, FURTHEST = 1e-6, 1e-20, 2.0
HFA = -1


def with_targets(games: DataFrame, scale: float = CONFIG.scale, cap: float = CONFIG.cap, kind: str = "margin") -> DataFrame:
    """games with y: the squashed margin, the result (0, 0.5, 1), or the capped margin."""
    m = F.col("hs") - F.col("aw")
    y = {"margin": squash(m, scale, cap), "binary": F.when(m > 0, 1.0).when(m < 0, 0.0).otherwise(0.5), "points": F.greatest(F.lit(-cap), F.least(F.lit(cap), m)).cast("double")}[kind]
    return games.withColumn("y", y)


def design(games: DataFrame) -> DataFrame:
    """(game_id, col, val): the incidence of sides and, unless neutral, of the home advantage (-1), in coordinate form."""
    cell = lambda c, v: F.struct(c.cast("long").alias("col"), F.lit(v).alias("val"))
    return games.select("game_id", F.explode(F.array(cell(F.col("home"), 1), cell(F.col("away"), -1), cell(F.lit(HFA), 1))).alias("c"), "neutral").filter((F.col("c.col") != HFA) | ~F.col("neutral")).select("game_id", "c.col", "c.val")


def newton(home: np.ndarray, away: np.ndarray, neutral: np.ndarray, y: np.ndarray, weight: np.ndarray, n: int, penalty: float, centre: np.ndarray | None = None, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Logits of n teams and the home advantage: the minimum of weighted cross entropy plus half penalty times squared distance from the centre.

    Recentred to mean zero. Without a game on home ground the advantage stays 0.
    """
    centre = np.zeros(n) if centre is None else centre - centre.mean()
    theta = np.append(centre, 0.0)
    at_home = (~neutral).astype(float)
    free = at_home.any()
    pen = np.append(np.full(n, max(penalty, 1e-9)), 1e-12)
    aim = np.append(centre, 0.0)

    def loss(t: np.ndarray) -> float:
        z = t[home] - t[away] + at_home * t[n]
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (pen * (t - aim) ** 2).sum())

    for _ in range(rounds):
        z = theta[home] - theta[away] + at_home * theta[n]
        p = 1 / (1 + np.exp(-z))
        r, c = weight * (p - y), weight * p * (1 - p)
        g = pen * (theta - aim) + np.bincount(home, r, n + 1) - np.bincount(away, r, n + 1)
        g[n] = g[n] + (r * at_home).sum() if free else 0.0
        step, now, length = solved(home, away, at_home, c, pen, g), loss(theta), 1.0
        while loss(theta - length * step) > now + 1e-12 and length > 1e-6:
            length /= 2
        theta = theta - length * step
        if np.abs(step).max() < 1e-10:
            break
    return theta[:n] - theta[:n].mean(), float(theta[n])


def solved(home: np.ndarray, away: np.ndarray, at_home: np.ndarray, c: np.ndarray, pen: np.ndarray, g: np.ndarray) -> np.ndarray:
    """x with (design' diag(c) design + diag(pen)) x = g, by conjugate gradients scaled by the diagonal; nothing but vectors is kept."""
    n = len(pen) - 1

    def times(x: np.ndarray) -> np.ndarray:
        t = c * (x[home] - x[away] + at_home * x[n])
        out = pen * x + np.bincount(home, t, n + 1) - np.bincount(away, t, n + 1)
        out[n] += (t * at_home).sum()
        return out

    scale = pen + np.bincount(home, c, n + 1) + np.bincount(away, c, n + 1)
    scale[n] = max(pen[n] + (c * at_home).sum(), 1e-12)
    x, r = np.zeros(n + 1), g.copy()
    z = r / scale
    d, now = z.copy(), float(r @ z)
    least = max(now * 1e-26, 1e-30)
    for _ in range(20 * (n + 1)):
        if now <= least:
            break
        q = times(d)
        a = now / float(d @ q)
        x, r = x + a * d, r - a * q
        z = r / scale
        before, now = now, float(r @ z)
        d = z + now / before * d
    return x


def newton_many(home: np.ndarray, away: np.ndarray, neutral: np.ndarray, y: np.ndarray, weight: np.ndarray, n: int, penalty: float, centres: np.ndarray, start: np.ndarray | None = None, rounds: int = 40) -> np.ndarray:
    """As newton() for every column of centres (teams by fits) at once, from ``start``: logits of the teams and, in the last row, the advantages; not recentred.

    All columns share the games, so each pass over them serves every fit.
    """
    k = centres.shape[1]
    aim = np.vstack([centres - centres.mean(0), np.zeros(k)])
    theta = (aim if start is None else start).copy()
    at_home, w = (~neutral).astype(float)[:, None], weight[:, None]
    pen = np.append(np.full(n, max(penalty, 1e-9)), 1e-12)[:, None]
    cells = np.arange(k)
    hi, ai = (home[:, None] * k + cells).ravel(), (away[:, None] * k + cells).ravel()

    def across(x: np.ndarray) -> np.ndarray:
        return x[home] - x[away] + at_home * x[n]

    def down(t: np.ndarray, sign: float) -> np.ndarray:
        flat, size = t.ravel(), (n + 1) * k
        out = (np.bincount(hi, flat, size) + sign * np.bincount(ai, flat, size)).reshape(n + 1, k)
        out[n] += (t * at_home).sum(0)
        return out

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-across(theta)))
        c = w * p * (1 - p)
        r = pen * (theta - aim) + down(w * (p - y[:, None]), -1)
        if not at_home.any():
            r[n] = 0
        scale = np.maximum(pen + down(c, 1), 1e-12)
        step, z = np.zeros_like(r), r / scale
        d, now = z.copy(), (r * z).sum(0)
        least = np.maximum(now * 1e-16, 1e-300)
        for _ in range(20 * (n + 1)):
            if (now <= least).all():
                break
            q = pen * d + down(c * across(d), -1)
            dq = (d * q).sum(0)
            a = np.where(dq > 0, now / np.where(dq > 0, dq, 1), 0)
            step, r = step + a * d, r - a * q
            z = r / scale
            before, now = now, (r * z).sum(0)
            d = z + np.where(before > 0, now / np.where(before > 0, before, 1), 0) * d
        size = np.abs(step).max(0)
        theta = theta - step * np.minimum(1, FURTHEST / np.maximum(size, 1e-300))
        if size.max() < 1e-9:
            break
    return theta


def ridge(home: np.ndarray, away: np.ndarray, neutral: np.ndarray, y: np.ndarray, weight: np.ndarray, n: int, penalty: float, centre: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Least squares on margins with the penalty on every team's distance from its centre; the advantage is 0 without a game on home ground."""
    at_home = (~neutral).astype(float)
    b = np.bincount(home, weight * y, n + 1) - np.bincount(away, weight * y, n + 1)
    if centre is not None:
        b[:n] += max(penalty, 1e-9) * (centre - centre.mean())
    b[n] = (weight * y * at_home).sum()
    x = solved(home, away, at_home, weight, np.append(np.full(n, max(penalty, 1e-9)), 0.0 if at_home.any() else 1.0), b)
    return x[:n] - x[:n].mean(), float(x[n])


def fit(games: DataFrame, keys: list[str], *, kind: str = "margin", scale: float = CONFIG.scale, prior_games: float = CONFIG.prior_games, priors: DataFrame | None = None, advantage: bool = True) -> DataFrame:
    """(keys, team, rating): one fit for each value of ``keys``, team -1 is the home advantage; ratings in points.

    games needs keys, home, away, neutral, hs, aw; columns ``scale`` and
    ``prior_games`` of games, where there, override the arguments fit by fit.
    priors (keys, team, prior) are the centres, in points; a team in neither
    games nor priors is in no fit.  Games are summed by pair, ground and
    target before the shuffle, so a fit's rows are bounded by its pairs, and
    the sums are written once: their count says which fits are solved in a
    task and which by rounds.  Without ``advantage`` all ground is neutral.  ``weight`` of games, where there, counts a game
    that many times.
    """
    for name, value in (("scale", scale), ("prior_games", prior_games)):
        if name not in games.columns:
            games = games.withColumn(name, F.lit(float(value)))
    m = F.col("hs") - F.col("aw")
    capped = F.greatest(F.lit(-CONFIG.cap), F.least(F.lit(CONFIG.cap), m))
    y = {"margin": 1.0 / (1.0 + F.exp(-capped / F.col("scale"))), "binary": F.when(m > 0, 1.0).when(m < 0, 0.0).otherwise(0.5), "points": capped.cast("double")}[kind]
    pairs = games.select(*keys, "scale", "prior_games", F.col("home").cast("long").alias("home"), F.col("away").cast("long").alias("away"), (F.col("neutral") if advantage else F.lit(True)).alias("neutral"), y.alias("y"), (F.col("weight").cast("double") if "weight" in games.columns else F.lit(1.0)).alias("w"))
    pairs = pairs.groupBy(*keys, "scale", "prior_games", "home", "away", "neutral").agg((F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("y"), F.sum("w").alias("weight")).filter("weight > 0")
    if priors is not None:
        # a prior travels as a row of its own: home is the team, y its centre, weight 0
        known = pairs.groupBy(*keys).agg(F.first("scale").alias("scale"), F.first("prior_games").alias("prior_games"))
        centre = priors.join(known, keys).select(*keys, "scale", "prior_games", F.col("team").cast("long").alias("home"), F.lit(None).cast("long").alias("away"), F.lit(True).alias("neutral"), F.col("prior").cast("double").alias("y"), F.lit(0.0).alias("weight"))
        pairs = pairs.unionByName(centre)

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        prior, met = rows[rows.away.isna()], rows[rows.away.notna()].sort_values(["home", "away", "neutral"])
        ids = np.unique(np.concatenate([met.home.to_numpy(np.int64), met.away.to_numpy(np.int64), prior.home.to_numpy(np.int64)]))
        s, pg = float(rows.scale.iloc[0]), float(rows.prior_games.iloc[0])
        at = lambda c: np.searchsorted(ids, c.to_numpy(np.int64))
        home, away, neutral, target, weight = at(met.home), at(met.away), met.neutral.to_numpy(bool), met.y.to_numpy(float), met.weight.to_numpy(float)
        centre = np.zeros(len(ids))
        centre[at(prior.home)] = prior.y.to_numpy(float) / (1.0 if kind == "points" else s)
        if kind == "points":
            x, hfa = ridge(home, away, neutral, target, weight, len(ids), pg, centre)
        else:
            x, hfa = newton(home, away, neutral, target, weight, len(ids), 0.25 * pg, centre)
            x, hfa = x * s, hfa * s
        out = pd.DataFrame({"team": np.append(ids, HFA), "rating": np.append(x, hfa)})
        for name, value in zip(keys, key):
            out[name] = value
        return out[[*keys, "team", "rating"]]

    kinds = dict(games.dtypes)
    pairs = cut(pairs)
    large = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PAIRS).select(*keys)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", team bigint, rating double"
    if large.isEmpty():
        return pairs.groupBy(*keys).applyInPandas(solve, schema)
    small = pairs.join(F.broadcast(large), keys, "left_anti").groupBy(*keys).applyInPandas(solve, schema)
    return small.unionByName(by_rounds(pairs.join(F.broadcast(large), keys, "left_semi"), keys, kind))


def rate(games: DataFrame, keys: list[str], *, scale: float = CONFIG.scale, prior_games: float = CONFIG.prior_games, priors: DataFrame | None = None) -> DataFrame:
    """(keys, team, bt_margin, bt_binary, massey): the three fits of fit() at once, in points, all about the same priors.

    Games are summed once by pair, ground and capped margin, which holds all
    three targets, and a group of keys is one task; fits of more pairs than a
    task should hold are made one by one with fit().
    """
    m = F.greatest(F.lit(-CONFIG.cap), F.least(F.lit(CONFIG.cap), (F.col("hs") - F.col("aw")).cast("double")))
    met = games.groupBy(*keys, F.col("home").cast("long").alias("home"), F.col("away").cast("long").alias("away"), "neutral", m.alias("m")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    if priors is not None:
        none = lambda kind: F.lit(None).cast(kind)
        met = met.unionByName(priors.join(met.select(*keys).distinct(), keys, "left_semi").select(*keys, F.col("team").cast("long").alias("home"), none("bigint").alias("away"), F.lit(True).alias("neutral"), F.col("prior").cast("double").alias("m"), F.lit(0.0).alias("n")))

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        prior, met = rows[rows.away.isna()], rows[rows.away.notna()].sort_values(["home", "away", "neutral", "m"])
        ids = np.unique(np.concatenate([met.home.to_numpy(np.int64), met.away.to_numpy(np.int64), prior.home.to_numpy(np.int64)]))
        at = lambda c: np.searchsorted(ids, c.to_numpy(np.int64))
        home, away, neutral, m, n = at(met.home), at(met.away), met.neutral.to_numpy(bool), met.m.to_numpy(float), met.n.to_numpy(float)
        centre = np.zeros(len(ids))
        centre[at(prior.home)] = prior.m.to_numpy(float)
        margin, hm = newton(home, away, neutral, 1 / (1 + np.exp(-m / scale)), n, len(ids), 0.25 * prior_games, centre / scale)
        binary, hb = newton(home, away, neutral, (np.sign(m) + 1) / 2, n, len(ids), 0.25 * prior_games, centre / scale)
        points, hp = ridge(home, away, neutral, m, n, len(ids), prior_games, centre)
        out = pd.DataFrame({"team": np.append(ids, HFA), "bt_margin": np.append(margin, hm) * scale, "bt_binary": np.append(binary, hb) * scale, "massey": np.append(points, hp)})
        for name, value in zip(keys, key):
            out[name] = value
        return out[[*keys, "team", "bt_margin", "bt_binary", "massey"]]

    kinds = dict(games.dtypes)
    return met.groupBy(*keys).applyInPandas(solve, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", team bigint, bt_margin double, bt_binary double, massey double")


def by_rounds(pairs: DataFrame, keys: list[str], kind: str = "margin", *, most: int = 1000) -> DataFrame:
    """(keys, team, rating) of the summed pairs of fit(), by Newton steps that conjugate gradients solve, each round a few joins and sums.

    For graphs of any size: a round keeps a row a team (place, step, residual,
    direction, and the system's product with the direction) and a row a pair
    (its curvature), both written as tables.  The products that give a round's
    two lengths are one sum over teams, a row for each fit; there are fewer
    such rows than there are millions of pairs, so they and the home
    advantages are broadcast.  A step is at most FURTHEST logits; the fit ends when none moves
    by more than SETTLED, and raises if that takes more than ``most`` rounds.
    """
    tables, points = Rounds(pairs.sparkSession), kind == "points"
    met, centres = pairs.filter("away is not null"), pairs.filter("away is null")
    unit = F.lit(1.0) if points else F.col("scale")
    teams = met.select(*keys, "scale", "prior_games", F.explode(F.array("home", "away")).alias("team")).union(centres.select(*keys, "scale", "prior_games", "home")).distinct()
    aims = teams.join(centres.select(*keys, F.col("home").alias("team"), (F.col("y") / unit).alias("aim")), [*keys, "team"], "left").withColumn("aim", F.coalesce("aim", F.lit(0.0)))
    aims = aims.join(F.broadcast(aims.groupBy(*keys).agg(F.avg("aim").alias("mid"))), keys).withColumn("aim", F.col("aim") - F.col("mid")).drop("mid")
    pen = F.greatest(F.col("prior_games") * (1.0 if points else 0.25), F.lit(1e-9))
    rows = aims.select(*keys, "team", "scale", pen.alias("pen"), "aim")
    advantage = aims.select(*keys, "scale").distinct().select(*keys, F.lit(HFA).cast("bigint").alias("team"), "scale", F.lit(1e-12).alias("pen"), F.lit(0.0).alias("aim"))
    theta = tables.write("theta", rows.unionByName(advantage).withColumn("th", F.col("aim")))
    met = tables.write("met", met.select(*keys, "home", "away", "neutral", "y", "weight"))

    def across(pairs: DataFrame, state: DataFrame, value: str) -> DataFrame:
        """pairs with t: the difference of the sides' values, plus the advantage's unless neutral."""
        at = lambda c, r: state.filter(F.col("team") != HFA).select(*keys, F.col("team").alias(c), F.col(value).alias(r))
        sides = pairs.join(at("home", "a"), [*keys, "home"]).join(at("away", "b"), [*keys, "away"])
        sides = sides.join(F.broadcast(state.filter(F.col("team") == HFA).select(*keys, F.col(value).alias("f"))), keys)
        return sides.withColumn("t", F.col("a") - F.col("b") + F.when(F.col("neutral"), 0.0).otherwise(F.col("f"))).drop("a", "b", "f")

    def by_team(pairs: DataFrame, **sums: Column) -> DataFrame:
        """Sums over the pairs of every team; those named signed_ count the away side negative."""
        term = lambda t, s: F.struct(t.cast("long").alias("team"), *[(F.lit(s) * c if n.startswith("signed_") else c).alias(n.removeprefix("signed_")) for n, c in sums.items()])
        cells = F.array(term(F.col("home"), 1), term(F.col("away"), -1), term(F.when(F.col("neutral"), -2).otherwise(HFA), 1))
        names = [n.removeprefix("signed_") for n in sums]
        return pairs.select(*keys, F.explode(cells).alias("e")).select(*keys, "e.*").groupBy(*keys, "team").agg(*[F.sum(n).alias(n) for n in names])

    def product(name: str, state: DataFrame, curved: DataFrame) -> DataFrame:
        """state with q, the system's product with the direction d."""
        q = by_team(across(curved, state, "d"), signed_q=F.col("c") * F.col("t"))
        return tables.write(name, state.join(q, [*keys, "team"], "left").withColumn("q", F.coalesce("q", F.lit(0.0)) + F.col("pen") * F.col("d")))

    rounds = 0
    while True:
        z = across(met, theta, "th")
        p = F.col("t") if points else 1 / (1 + F.exp(-F.col("t")))
        curved = tables.write("curved", z.select(*keys, "home", "away", "neutral", (F.col("weight") * (p - F.col("y"))).alias("g"), (F.col("weight") * (F.lit(1.0) if points else p * (1 - p))).alias("c")))
        sums = by_team(curved, signed_g=F.col("g"), diagonal=F.col("c"))
        r = -(F.coalesce("g", F.lit(0.0)) + F.col("pen") * (F.col("th") - F.col("aim")))
        m = F.greatest(F.coalesce("diagonal", F.lit(0.0)) + F.col("pen"), F.lit(1e-12))
        state = theta.join(sums, [*keys, "team"], "left").select(*keys, "team", "pen", m.alias("m"), F.lit(0.0).alias("x"), r.alias("r"), (r / m).alias("d"))
        first = None
        while True:
            state = product("state", state, curved)
            rounds += 1
            if rounds > most:
                raise RuntimeError(f"ratings did not settle in {most} rounds")
            rz, dq, qz, qq = (F.sum(F.col(a) * F.col(b) / c) for a, b, c in (("r", "r", F.col("m")), ("d", "q", F.lit(1.0)), ("q", "r", F.col("m")), ("q", "q", F.col("m"))))
            dots = tables.write("dots", state.groupBy(*keys).agg(rz.alias("rz"), dq.alias("dq"), qz.alias("qz"), qq.alias("qq")))
            first = tables.write("first", dots.select(*keys, F.col("rz").alias("rz0"))) if first is None else first
            length = F.when(F.col("dq") > 1e-300, F.col("rz") / F.col("dq")).otherwise(0.0)
            after = F.greatest(F.col("rz") - 2 * F.col("length") * F.col("qz") + F.col("length") * F.col("length") * F.col("qq"), F.lit(0.0))
            ways = dots.withColumn("length", length).withColumn("after", after).withColumn("turn", F.when(F.col("rz") > 1e-300, F.col("after") / F.col("rz")).otherwise(0.0))
            left = ways.join(F.broadcast(first), keys).agg(F.max(F.when(F.col("rz0") > 1e-300, F.col("after") / F.col("rz0")).otherwise(0.0))).first()[0]
            now = state.join(F.broadcast(ways.select(*keys, "length", "turn")), keys)
            residual = F.col("r") - F.col("length") * F.col("q")
            state = now.select(*keys, "team", "pen", "m", (F.col("x") + F.col("length") * F.col("d")).alias("x"), residual.alias("r"), (residual / F.col("m") + F.col("turn") * F.col("d")).alias("d"))
            if left <= (EXACT if points else LEFT):
                break
        step = tables.write("step", state.select(*keys, "team", "x"))
        size = step.groupBy(*keys).agg(F.max(F.abs("x")).alias("size"))
        share = F.lit(1.0) if points else F.least(F.lit(1.0), FURTHEST / F.greatest(F.col("size"), F.lit(1e-300)))
        theta = tables.write("theta", theta.join(step, [*keys, "team"]).join(F.broadcast(size), keys).withColumn("th", F.col("th") + F.col("x") * share).drop("x", "size"))
        if points or size.agg(F.max("size")).first()[0] <= SETTLED:
            middle = theta.filter(F.col("team") != HFA).groupBy(*keys).agg(F.avg("th").alias("mid"))
            centred = F.col("th") - F.when(F.col("team") == HFA, 0.0).otherwise(F.col("mid"))
            return theta.join(F.broadcast(middle), keys).select(*keys, "team", (centred * unit).alias("rating"))


def fit_by_rounds(games: DataFrame, *, scale: float = CONFIG.scale, prior_games: float = CONFIG.prior_games) -> DataFrame:
    """(team, rating): one margin fit of all games by rounds, whatever its size."""
    y = squash(F.col("hs") - F.col("aw"), scale, CONFIG.cap)
    pairs = games.groupBy(F.lit(0).alias("fit"), F.col("home").cast("long").alias("home"), F.col("away").cast("long").alias("away"), "neutral").agg(F.avg(y).alias("y"), F.count(F.lit(1)).cast("double").alias("weight"))
    pairs = cut(pairs.withColumns({"scale": F.lit(float(scale)), "prior_games": F.lit(float(prior_games))}))
    return by_rounds(pairs, ["fit"]).drop("fit")


def predict_margin(games: DataFrame, ratings: DataFrame) -> DataFrame:
    """games with margin: difference of ratings, plus the home advantage unless neutral; rows whose sides are not both rated go."""
    # the advantage is one row
    hfa = F.broadcast(ratings.filter(F.col("team") == HFA).select(F.col("rating").alias("hfa")))
    return (
        games.join(ratings.select(F.col("team").alias("home"), F.col("rating").alias("rh")), "home")
        .join(ratings.select(F.col("team").alias("away"), F.col("rating").alias("ra")), "away")
        .join(hfa)
        .withColumn("margin", F.col("rh") - F.col("ra") + F.when(F.col("neutral"), 0.0).otherwise(F.col("hfa")))
        .drop("rh", "ra", "hfa")
    )
