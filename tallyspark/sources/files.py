"""Readers of game, roster, fixture and log files, and guarded writers."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

GAMES = "week string, date string, away string, away_score string, home string, home_score string, neutral string, away_state string, home_state string"
ROSTER = "name string, school string, city string, school_id string, division string, region string, record string, harbin string"
FIXTURES = "week string, date string, time string, away string, home string, neutral string, away_state string, home_state string"
SNAPSHOT = "season int, throughWeek int, kind string, generatedAt string, keys array<string>, teams array<array<double>>, pred array<array<string>>"

RIVALS = "source string, season int, week int, capturedAt string, picks array<struct<home:string,away:string,homeMargin:int,homeProb:double>>"


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, columns by name; those that the file lacks are empty strings."""
    raw = spark.read.option("header", True).csv(path)
    names = [f.split()[0] for f in schema.split(", ")]
    return raw.select(*[F.coalesce(F.col(n), F.lit("")).alias(n) if n in raw.columns else F.lit("").alias(n) for n in names])


def typed(df: DataFrame) -> DataFrame:
    """Identity with its state tag, typed week and scores; rows that do not fit the types go."""
    from ..operators.identity import team_identity

    number = lambda c: F.expr(f"try_cast(trim({c}) as int)")
    rows = df.withColumns({"wk": number("week"), "aw": number("away_score"), "hs": number("home_score"), "neutral": F.trim("neutral").isin("1", "true", "True")})
    rows = rows.filter("wk is not null and aw is not null and hs is not null and away <> '' and home <> ''")
    return rows.select("wk", "date", team_identity(F.col("away"), F.col("away_state")).alias("away"), "aw", team_identity(F.col("home"), F.col("home_state")).alias("home"), "hs", "neutral")


def read_games(spark: SparkSession, path: str) -> DataFrame:
    return typed(csv(spark, path, GAMES))


def read_pipe_games(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``away|score|home|score`` without a header: all of week 1; lines of other shapes and blank scores go."""
    parts = spark.read.text(path).select(F.split("value", r"\|", -1).alias("p")).filter(F.size("p") == 4)
    cell = lambda i: F.trim(F.col("p")[i])
    rows = parts.select(F.lit(1).alias("wk"), cell(0).alias("away"), F.expr("try_cast(trim(p[1]) as int)").alias("aw"), cell(2).alias("home"), F.expr("try_cast(trim(p[3]) as int)").alias("hs"), F.lit(False).alias("neutral"))
    return rows.filter("aw is not null and hs is not null")


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    record = F.split("record", "-", -1)
    count = lambda i: F.coalesce(F.try_element_at(record, F.lit(i)).try_cast("int"), F.lit(0))
    return csv(spark, path, ROSTER).select("name", "school", "city", "school_id", "division", F.expr("try_cast(region as int)").alias("region"), count(1).alias("w"), count(2).alias("l"), count(3).alias("t"), F.expr("try_cast(harbin as double)").alias("points"))


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Fixtures; a path that is not there is an empty table."""
    try:
        raw = csv(spark, path, FIXTURES)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raw = spark.createDataFrame([], FIXTURES)
    return raw.select(F.expr("try_cast(week as int)").alias("wk"), "date", "time", "away", "home", F.trim("neutral").isin("1", "true", "True").alias("neutral"), "away_state", "home_state").filter("wk is not null")


def read_log(spark: SparkSession, path: str, schema: str = SNAPSHOT) -> DataFrame:
    """A JSON-lines log: broken lines go, forecasts of five or seven elements are read alike, and a file that is not there is an empty log."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def append_log(rows: DataFrame, path: str) -> None:
    """Append rows to a JSON-lines log; each writer adds files of its own, so lines that are there are never rewritten."""
    rows.write.mode("append").option("ignoreNullFields", "true").json(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document of many lines as one row; a file that is not there is no row."""
    try:
        return spark.read.schema(schema).option("multiLine", "true").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


#: The season's prior as it is kept: effects by division and deviations by school.
PRIOR = "meta struct<season:int,carry:double>, divisionEffects map<string,double>, prior map<string,double>"


def prior_table(document: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(season, division, effect) and (season, school_id, dev) of prior documents."""
    season = F.col("meta.season").alias("season")
    return document.select(season, F.explode("divisionEffects").alias("division", "effect")), document.select(season, F.explode("prior").alias("school_id", "dev"))


def stale(seasons: DataFrame, stamps: DataFrame, version: int) -> DataFrame:
    """(season): the seasons of (season) whose stamp (season, version) is not the parser's, or is missing: they are read again."""
    return seasons.join(stamps, "season", "left").filter(F.coalesce("version", F.lit(-1)) != version).select("season")


def forecasts(log: DataFrame) -> DataFrame:
    """(season, through, kind, home, away, wk, margin, p) of each forecast in a log."""
    rows = log.select("season", F.col("throughWeek").alias("through"), F.coalesce("kind", F.lit("live")).alias("kind"), F.explode("pred").alias("f"))
    return rows.select("season", "through", "kind", F.col("f")[0].alias("home"), F.col("f")[1].alias("away"), F.col("f")[2].try_cast("int").alias("wk"), F.col("f")[3].try_cast("double").alias("margin"), F.col("f")[4].try_cast("double").alias("p"))


def verdict(n: Column, before: Column, kind: str) -> Column:
    """Why so few rows beside what was there must not be written; null where they may."""
    if kind == "games":
        return F.when(n == 0, "no games").when((before > 50) & (n < 0.8 * before), "far fewer games than before")
    return F.when((before > 50) & (n == 0), "all fixtures gone")


def manifest(spark: SparkSession, path: str):
    """The Hadoop path of the file that names the version readers see, and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_current")
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the version that was committed last; None where none was."""
    at, fs = manifest(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return f"{path}/{spark._jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8').strip()}"
    finally:
        stream.close()


def stage(rows: DataFrame, path: str, form: str = "parquet") -> str:
    """Write rows as a version that no reader sees yet; its name."""
    name = f"v-{uuid4().hex}"
    rows.write.format(form).save(f"{path}/{name}")
    return name


def commit(spark: SparkSession, path: str, name: str) -> None:
    """Make a staged version the one that readers see: the manifest is replaced by one rename, so they see the old or the new.

    A writer that dies before this leaves the old version current.
    """
    at, fs = manifest(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_draft-{name}")
    out = fs.create(draft, True)
    out.write(name.encode())
    out.close()
    options = spark._jvm.org.apache.hadoop.fs.Options
    how = spark.sparkContext._gateway.new_array(getattr(options, "Rename"), 1)
    how[0] = getattr(options, "Rename").OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, at, how)


def read_current(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> DataFrame:
    """The committed version; an empty table where there is none."""
    folder = current(spark, path)
    return spark.read.schema(schema).format(form).load(folder) if folder else spark.createDataFrame([], schema)


def write_guarded(new: DataFrame, path: str, kind: str = "games") -> int:
    """Commit new unless it holds suspiciously little beside what is there: raises, and leaves the old version, where it does.

    Rows are computed once, as the staged version; both counts are read from what is written.
    """
    spark, old = new.sparkSession, current(new.sparkSession, path)
    name = stage(new, path)
    n, before = spark.read.parquet(f"{path}/{name}").count(), spark.read.parquet(old).count() if old else 0
    refused = spark.range(1).select(verdict(F.lit(n), F.lit(before), kind)).first()[0]
    if refused:
        raise ValueError(refused)
    commit(spark, path, name)
    return n


def write_csv(rows: DataFrame, path: str) -> None:
    """A table as CSV with a header in every file, as the readers expect it."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def season_of(path):
    """The season in a file's name (what stands after the last slash): its first four digits in a row."""
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(\d{4})", 1).try_cast("int")


def retries(status: Column) -> Column:
    """Server errors and dropped connections (null) are tried again; a client's error is not."""
    return status.isNull() | (status >= 500)


def waits(status: Column, attempts: int = 3, base: float = 1.5) -> Column:
    """Seconds to wait after each failed attempt but the last; none where it is not tried again."""
    return F.when(retries(status), F.transform(F.sequence(F.lit(0), F.lit(attempts - 2)), lambda k: base * F.pow(F.lit(2.0), k))).otherwise(F.array().cast("array<double>"))
