"""Games, rosters and fixtures derived from the star schema, the same in Spark and in SQL.

Dense arena: consecutive line items of an order are a match between their
suppliers.  Sparse arena: orders of one week are paired, customers are teams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The season that forecasts are made for, its last played week, and the last regular week.
SEASON, PLAYED_TO, LAST_REGULAR_WEEK = 2000, 26, 40
DIVISIONS = ("I", "II", "III", "IV", "V", "VI", "VII")
#: Names are shared by the keys with the same remainder, so that identity has work to do.
NAMES = 0.9


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def week_of(date: Column) -> Column:
    return F.ceil(F.dayofyear(date) / 7.0).cast("int")


def safe_round(c: Column, n: int) -> Column:
    """Rounds exact decimal ties up, alike in every engine, and never gives a negative zero."""
    return F.round(c + F.lit(1e-9), n) + F.lit(0.0)


def dense_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(season, wk, game_id, home, away, hs, aw, neutral): one shuffle, on the order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax")
    items = read(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.row_number().over(w).alias("rn"),
        F.col("l_suppkey").alias("home"),
        F.lead("l_suppkey").over(w).alias("away"),
        F.col("l_quantity").cast("int").alias("hs"),
        F.lead("l_quantity").over(w).cast("int").alias("aw"),
    )
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return (
        items.filter("rn % 2 = 1 and away is not null and home <> away")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.year("o_orderdate").alias("season"),
            week_of(F.col("o_orderdate")).alias("wk"),
            (F.col("l_orderkey") * 100 + F.col("rn")).alias("game_id"),
            "home",
            "away",
            "hs",
            "aw",
            (F.col("l_orderkey") % 10 == 0).alias("neutral"),
        )
    )


def sparse_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders paired within a week by their keys: the fragmented graph of a season's first weeks."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("season"), week_of(F.col("o_orderdate")).alias("wk"), (F.floor("o_totalprice") % 57).cast("int").alias("pts"))
    w = Window.partitionBy("season", "wk").orderBy("o_orderkey")
    paired = o.select("season", "wk", "o_orderkey", F.row_number().over(w).alias("rn"), F.col("o_custkey").alias("home"), F.lead("o_custkey").over(w).alias("away"), F.col("pts").alias("hs"), F.lead("pts").over(w).alias("aw"))
    return paired.filter("rn % 2 = 1 and away is not null and home <> away").select("season", "wk", F.col("o_orderkey").alias("game_id"), "home", "away", "hs", "aw", (F.col("o_orderkey") % 10 == 0).alias("neutral"))


def division_of(key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DIVISIONS)), (key % 7 + 1).cast("int"))


def dense_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(team, name, school_id, division, region, in_league): suppliers as teams."""
    return roster_of(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("team"), F.col("s_nationkey").alias("nation")), read(spark, sf_dir, "nation"))


def sparse_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roster_of(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("team"), F.col("c_nationkey").alias("nation")), read(spark, sf_dir, "nation"))


def roster_of(keys: DataFrame, nation: DataFrame) -> DataFrame:
    # 25 nations whatever the scale: a broadcast of a fixed size
    regions = F.broadcast(nation.select(F.col("n_nationkey").alias("nation"), (F.col("n_regionkey") + 1).cast("int").alias("region")))
    return keys.join(regions, "nation").select(
        "team",
        F.concat(F.lit("Team "), (F.col("team") - F.col("team") % 10 * (F.col("team") % 3 == 0).cast("int")).cast("string")).alias("name"),
        F.col("team").cast("string").alias("school_id"),
        F.when(F.col("nation") != 24, division_of(F.col("nation"))).alias("division"),
        "region",
        (F.col("nation") != 24).alias("in_league"),
    )


def played(games: DataFrame) -> DataFrame:
    return games.filter((F.col("season") == SEASON) & (F.col("wk") <= PLAYED_TO))


def fixtures(games: DataFrame) -> DataFrame:
    """Games still to be played: no score columns, so none can leak into a fit."""
    return games.filter((F.col("season") == SEASON) & (F.col("wk") > PLAYED_TO)).select("season", "wk", "game_id", "home", "away", "neutral")


#: The same tables in SQL, to stand in front of a query.
ARENA_SQL = f"""
items as (select l_orderkey, row_number() over w as rn, l_suppkey as home, lead(l_suppkey) over w as away, cast(l_quantity as int) as hs, cast(lead(l_quantity) over w as int) as aw
  from lineitem window w as (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax)),
games as (select cast(year(o_orderdate) as int) as season, cast(ceil(dayofyear(o_orderdate) / 7.0) as int) as wk, l_orderkey * 100 + rn as game_id, home, away, hs, aw, l_orderkey % 10 = 0 as neutral
  from items join orders on l_orderkey = o_orderkey where rn % 2 = 1 and away is not null and home <> away),
roster as (select s_suppkey as team, 'Team ' || cast(s_suppkey - case when s_suppkey % 3 = 0 then s_suppkey % 10 else 0 end as varchar) as name, cast(s_suppkey as varchar) as school_id,
  case when s_nationkey <> 24 then (['I','II','III','IV','V','VI','VII'])[s_nationkey % 7 + 1] end as division, cast(n_regionkey + 1 as int) as region, s_nationkey <> 24 as in_league
  from supplier join nation on s_nationkey = n_nationkey),
played as (select * from games where season = {SEASON} and wk <= {PLAYED_TO}),
fixtures as (select season, wk, game_id, home, away, neutral from games where season = {SEASON} and wk > {PLAYED_TO})
"""
SPARSE_SQL = """
paired as (select season, wk, o_orderkey, row_number() over w as rn, o_custkey as home, lead(o_custkey) over w as away, pts as hs, lead(pts) over w as aw
  from (select o_orderkey, o_custkey, cast(year(o_orderdate) as int) as season, cast(ceil(dayofyear(o_orderdate) / 7.0) as int) as wk, cast(floor(o_totalprice) % 57 as int) as pts from orders)
  window w as (partition by season, wk order by o_orderkey)),
sparse as (select season, wk, o_orderkey as game_id, home, away, hs, aw, o_orderkey % 10 = 0 as neutral from paired where rn % 2 = 1 and away is not null and home <> away)
"""
