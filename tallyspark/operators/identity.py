"""Who a name is: one school, several, or one outside the league; never merged on a guess."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REGIONS, ALPHA, CONFIDENT = 28, 0.5, 1.0
#: Costs are whole numbers of 1 / UNIT, so that sums are exact; orders within TIE of these are level.
UNIT, TIE = 10**12, 500


def team_identity(name: Column, state: Column) -> Column:
    tag = F.upper(F.trim(F.coalesce(state, F.lit(""))))
    return F.when(tag != "", F.concat(F.trim(name), F.lit(" ["), tag, F.lit("]"))).otherwise(F.trim(name))


def named_appearances(games: DataFrame) -> DataFrame:
    """(season, wk, game_id, seq, name, opp, nth, place): each side's name; nth counts a name's appearances, place those of one week, in file order, home first."""
    side = lambda seq, n, o: F.struct(F.lit(seq).alias("seq"), F.col(n).alias("name"), F.col(o).alias("opp"))
    rows = games.select("season", "wk", "game_id", F.explode(F.array(side(0, "home", "away"), side(1, "away", "home"))).alias("s")).select("season", "wk", "game_id", "s.*")
    order = ["game_id", "seq"]
    return rows.withColumns({"nth": F.row_number().over(Window.partitionBy("name").orderBy(*order)) - 1, "place": F.row_number().over(Window.partitionBy("name", "season", "wk").orderBy(*order)) - 1})


def spread(place: Column, n: Column) -> Column:
    """The entity of a same-week appearance: round robin, the last takes the rest."""
    return F.least(place, n - 1)


def classes(apps: DataFrame, roster: DataFrame) -> DataFrame:
    """(name, slots, most, n, class, id): how each name is settled; id where it is one entity."""
    most = apps.groupBy("name", "season", "wk").agg(F.count(F.lit(1)).alias("k")).groupBy("name").agg(F.max("k").alias("most"))
    slots = roster.groupBy("name").agg(F.count(F.lit(1)).alias("slots"), F.min("division").alias("division"), F.min("region").alias("region"))
    rows = most.join(slots, "name", "full_outer").select("name", F.coalesce("slots", F.lit(0).cast("long")).alias("slots"), F.coalesce("most", F.lit(0).cast("long")).alias("most"), "division", "region")
    kind = F.when((F.col("slots") == 0) & (F.col("most") <= 1), "outside").when(F.col("slots") == 0, "outside, several").when((F.col("most") <= 1) & (F.col("slots") == 1), "one").when(F.col("most") <= 1, "ambiguous").otherwise("deferred")
    one = F.concat("name", F.lit("|"), F.coalesce("division", F.lit("None")), F.lit("-"), F.col("region").cast("string"))
    ident = F.when(kind == "outside", F.concat(F.lit("OOS::"), "name")).when(kind == "one", one).when(kind == "ambiguous", F.concat("name", F.lit("|?")))
    return rows.select("name", "slots", "most", F.greatest("most", "slots", F.lit(1)).alias("n"), kind.alias("class"), ident.alias("id"))


def settled_regions(settled: DataFrame, roster: DataFrame) -> DataFrame:
    """(name, region) of names that are one school."""
    return settled.filter("class = 'one'").select("name").join(roster.select("name", "region"), "name").filter("region is not null")


def region_counts(games: DataFrame, regions: DataFrame) -> DataFrame:
    """(ra, rb, n): how often regions met, both ways round; a game inside a region counts twice."""
    side = lambda c, r: regions.select(F.col("name").alias(c), F.col("region").alias(r))
    met = games.join(side("home", "ra"), "home").join(side("away", "rb"), "away").groupBy("ra", "rb").agg(F.count(F.lit(1)).alias("n"))
    return met.union(met.select("rb", "ra", "n")).groupBy("ra", "rb").agg(F.sum("n").alias("n"))


def region_log_p(counts: DataFrame) -> DataFrame:
    """(ra, rb, log_p): smoothed log share of ra's games that are against rb, for regions that met any."""
    total = counts.groupBy("ra").agg(F.sum("n").alias("total"))
    every = total.select("ra", "total", F.explode(F.sequence(F.lit(1), F.lit(REGIONS))).alias("rb"))
    return every.join(counts, ["ra", "rb"], "left").select("ra", "rb", F.ln((F.coalesce("n", F.lit(0)) + ALPHA) / (F.col("total") + ALPHA * REGIONS)).alias("log_p"))


def carried(supply: list[int], cost: list[list[int | None]], room: list[int]) -> int | None:
    """The least cost of bringing all supply into kinds with room, cost being null where that is barred; null if it cannot be (cheapest paths, one after another)."""
    supply, room, total = list(supply), list(room), 0
    flow = [[0] * len(room) for _ in supply]
    while any(supply):
        near, far = [0 if n else None for n in supply], [None] * len(room)
        back, by, moved = [None] * len(supply), [None] * len(room), True
        while moved:
            moved = False
            for i, d in enumerate(near):
                for k, c in enumerate(cost[i]):
                    if d is not None and c is not None and (far[k] is None or d + c < far[k]):
                        far[k], by[k], moved = d + c, i, True
            for k, d in enumerate(far):
                for i in range(len(supply)):
                    if d is not None and flow[i][k] and (near[i] is None or d - cost[i][k] < near[i]):
                        near[i], back[i], moved = d - cost[i][k], k, True
        end = min((k for k in range(len(room)) if room[k] and far[k] is not None), key=lambda k: far[k], default=None)
        if end is None:
            return None
        way, k = [], end
        while True:
            i = by[k]
            way.append((i, k, back[i]))
            if back[i] is None:
                break
            k = back[i]
        most = min([room[end], supply[i], *(flow[i][b] for i, _, b in way if b is not None)])
        for i, k, b in way:
            flow[i][k] += most
            if b is not None:
                flow[i][b] -= most
        supply[way[-1][0]] -= most
        room[end] -= most
        total += most * far[end]
    return total


def best_order(score: dict[tuple[int, int], float], rows: int, n: int) -> tuple[list[int], float | None]:
    """The order of highest score, of level ones the first; and how far the next best lies behind, null if there is no other."""
    alike: dict[tuple, list[int]] = {}
    for s in range(n):
        alike.setdefault(tuple(round(-score.get((p, s), 0.0) * UNIT) for p in range(rows)), []).append(s)
    return order_of_kinds(list(alike), list(alike.values()), rows)


def order_of_kinds(costs: list[tuple[int, ...]], members: list[list[int]], rows: int) -> tuple[list[int], float | None]:
    """best_order() of entities that come in kinds: costs has a kind's cost at every place, members its entities in order.

    Entities of a kind stand for each other, so work grows with kinds and
    places, not with entities.  Where every place can have its cheapest kind,
    that is the optimum; else places that cost alike are carried to the kinds
    together.
    """
    kinds = range(len(costs))
    left = [len(m) for m in members]

    def least_of(places: list[int], barred: tuple[int, int] | None = None) -> int | None:
        """The least cost of the places with what is left of the kinds, place and kind of ``barred`` apart; null if there is none."""
        alike: dict[tuple, int] = {}
        for p in places:
            row = tuple(None if (p, k) == barred else costs[k][p] for k in kinds)
            alike[row] = alike.get(row, 0) + 1
        return carried(list(alike.values()), [list(r) for r in alike], left)

    places = list(range(rows))
    # what every place and all after it cost at their cheapest, and how many of a kind these take
    ahead = [(0, [0] * len(costs))]
    for p in reversed(places):
        k = min(kinds, key=lambda k: costs[k][p])
        total, used = ahead[-1]
        ahead.append((total + costs[k][p], [u + (j == k) for j, u in enumerate(used)]))

    def least_from(p: int) -> int | None:
        total, used = ahead[rows - p]
        return total if all(u <= n for u, n in zip(used, left)) else least_of(places[p:])

    least, spent, order, chosen = least_from(0), 0, [], []
    for p in places:
        for k in sorted((k for k in kinds if left[k]), key=lambda k: members[k][-left[k]]):
            left[k] -= 1
            rest = least_from(p + 1)
            if rest is not None and spent + costs[k][p] + rest <= least + TIE:
                order.append(members[k][-left[k] - 1])
                chosen.append(k)
                spent += costs[k][p]
                break
            left[k] += 1
    if sum(map(len, members)) < 2:
        return order, None
    if any(len(members[k]) > 1 for k in chosen):
        # an entity gives way to another of its kind
        return order, (least - spent) / UNIT
    # another order leaves at least one chosen cell, so each is forbidden in turn
    left = [len(m) for m in members]
    others = [total for total in (least_of(places, (p, chosen[p])) for p in places) if total is not None]
    return order, (min(others) - spent) / UNIT


def assign(apps: DataFrame, settled: DataFrame, roster: DataFrame, log_p: DataFrame) -> DataFrame:
    """(name, season, wk, order, gap): for each week of a deferred name, which entity each appearance is, and how far the next best order lies behind.

    A group is one name's games in one week; its best order is a linear
    assignment, exact for any number of entities.  A group has its places and
    the regions of its name's entries, never a row for each of their pairs;
    the table of regions is REGIONS squared at most and goes with the code.
    """
    slots = roster.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct(*[c for c in ("school_id", "region", "division") if c in roster.columns]))), lambda s: s["region"]).alias("slot_regions"))
    regions = settled_regions(settled, roster).select(F.col("name").alias("opp"), F.col("region").alias("opp_region"))
    rows = apps.join(settled.filter("class = 'deferred'").select("name", "n"), "name").join(regions, "opp", "left")
    grouped = rows.groupBy("name", "season", "wk", "n").agg(F.collect_list(F.struct("place", "opp_region")).alias("places")).join(slots, "name")
    known = {(r["ra"], r["rb"]): round(-r["log_p"] * UNIT) for r in log_p.collect()}

    @F.arrow_udf("struct<order:array<int>,gap:double>")
    def best(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for counts, tables, entries in batches:
            out = []
            for n, table, own in zip(counts.to_pylist(), tables.to_pylist(), entries.to_pylist()):
                met = [c["opp_region"] for c in sorted(table, key=lambda c: c["place"])][:n]
                of: dict[int | None, list[int]] = {}
                for s in range(n):
                    of.setdefault(own[s] if s < len(own) else None, []).append(s)
                alike: dict[tuple, list[int]] = {}
                for r, entities in of.items():
                    alike.setdefault(tuple(known.get((r, o), 0) for o in met), []).extend(entities)
                order, gap = order_of_kinds(list(alike), [sorted(e) for e in alike.values()], len(met))
                out.append({"order": order, "gap": gap})
            yield pa.array(out, pa.struct([("order", pa.list_(pa.int32())), ("gap", pa.float64())]))

    # few bytes stand for much work here, so partitions are not to be merged by size
    session = grouped.sparkSession
    grouped = grouped.repartition(max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))), "name", "wk")
    return grouped.select("name", "season", "wk", best("n", "places", "slot_regions").alias("b")).select("name", "season", "wk", "b.order", "b.gap")


def entities(settled: DataFrame, roster: DataFrame) -> DataFrame:
    """(name, k, id, school_id, division, region): every entity of a deferred name.

    The first are the roster's entries, in the order of their school ids:
    ``name|division-region``, with #2, #3 and so on where that is taken; those
    beyond them are schools outside the league, ``OOS::name#k``.
    """
    deferred = settled.filter("class = 'deferred'").select("name", "n", "slots")
    base = F.concat("name", F.lit("|"), F.coalesce("division", F.lit("None")), F.lit("-"), F.coalesce(F.col("region").cast("string"), F.lit("None")))
    slots = roster.join(deferred.select("name"), "name", "left_semi").select("name", "school_id", "division", "region", base.alias("base"))
    slots = slots.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("school_id", "region", "division")) - 1)
    bump = F.row_number().over(Window.partitionBy("name", "base").orderBy("k"))
    own = slots.select("name", "k", F.when(bump > 1, F.concat("base", F.lit("#"), bump.cast("string"))).otherwise(F.col("base")).alias("id"), "school_id", "division", "region")
    none = lambda c: F.lit(None).cast(dict(roster.dtypes)[c]).alias(c)
    beyond = deferred.filter("n > slots").select("name", F.explode(F.sequence(F.col("slots").cast("int"), (F.col("n") - 1).cast("int"))).alias("k"))
    outside = beyond.select("name", "k", F.concat(F.lit("OOS::"), "name", F.lit("#"), (F.col("k") + 1).cast("string")).alias("id"), none("school_id"), none("division"), none("region"))
    return own.unionByName(outside)


def confidence(assigned: DataFrame) -> DataFrame:
    """(name, weeks, mean_gap, confident): how far, in log units, the best order of a week lies before the next, on the mean of a name's weeks that leave a choice; sure from CONFIDENT on."""
    mean = F.coalesce(F.avg("gap"), F.lit(0.0))
    return assigned.groupBy("name").agg(F.count("gap").alias("weeks"), mean.alias("mean_gap")).withColumn("confident", F.round("mean_gap", 9) >= CONFIDENT)


def conflicts(settled: DataFrame, sure: DataFrame) -> DataFrame:
    """(name, kind, n): names that are several schools outside the league, or one school that cannot be told, or that were split on thin evidence."""
    known = settled.filter("class in ('outside, several', 'ambiguous')").select("name", F.when(F.col("class") == "ambiguous", "ambiguous").otherwise("oos-duplicate").alias("kind"), F.col("n").cast("bigint").alias("n"))
    thin = settled.filter("class = 'deferred'").join(sure.filter("confident"), "name", "left_anti").select("name", F.lit("low-confidence").alias("kind"), F.col("n").cast("bigint").alias("n"))
    return known.unionByName(thin)


def teams(settled: DataFrame, roster: DataFrame, sure: DataFrame) -> DataFrame:
    """(id, name, division, region, in_league, ambiguous): every entity that the names come to; ambiguous where who it is was guessed."""
    r = roster.groupBy("name").agg(F.min("division").alias("division"), F.min("region").alias("region"), F.count_distinct("division").alias("divisions"), F.count_distinct("region").alias("regions"))
    single = settled.filter("id is not null").join(r, "name", "left")
    only = lambda c, n: F.when((F.col("class") == "one") | (F.col(n) == 1), F.col(c)).alias(c)
    one = single.select("id", "name", only("division", "divisions"), only("region", "regions"), (F.col("class") != "outside").alias("in_league"), (F.col("class") == "ambiguous").alias("ambiguous"))
    several = settled.filter("class = 'outside, several'").select("name", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"))
    none = lambda c: F.lit(None).cast(dict(roster.dtypes)[c]).alias(c)
    outside = several.select(F.concat(F.lit("OOS::"), "name", F.lit("#"), F.col("k").cast("string")).alias("id"), "name", none("division"), none("region"), F.lit(False).alias("in_league"), F.lit(True).alias("ambiguous"))
    split = entities(settled, roster).join(sure.select("name", "confident"), "name", "left")
    league = ~F.col("id").startswith("OOS::")
    many = split.select("id", "name", "division", "region", league.alias("in_league"), (~league | ~F.coalesce("confident", F.lit(False))).alias("ambiguous"))
    return one.unionByName(outside).unionByName(many)


def resolve_games(games: DataFrame, apps: DataFrame, settled: DataFrame, assigned: DataFrame, roster: DataFrame) -> DataFrame:
    """(season, wk, game_id, home, away): names replaced by entity ids, each appearance by its own."""
    rows = apps.join(settled.select("name", "n", "class", "id"), "name").join(assigned.select("name", "season", "wk", "order"), ["name", "season", "wk"], "left")
    at = F.coalesce(F.try_element_at("order", F.col("place") + 1), spread(F.col("place"), F.col("n")).cast("int"))
    rows = rows.withColumn("k", at).join(entities(settled, roster).select("name", "k", F.col("id").alias("entity")), ["name", "k"], "left")
    ident = F.when(F.col("id").isNotNull(), F.col("id")).when(F.col("class") == "outside, several", F.concat(F.lit("OOS::"), "name", F.lit("#"), (spread(F.col("place"), F.col("n")) + 1).cast("string"))).otherwise(F.col("entity"))
    ids = rows.select("season", "wk", "game_id", "seq", ident.alias("id"))
    return ids.groupBy("season", "wk", "game_id").agg(F.max(F.when(F.col("seq") == 0, F.col("id"))).alias("home"), F.max(F.when(F.col("seq") == 1, F.col("id"))).alias("away"))
