"""Season files, event JSON and valuations in; sorted, idempotent Parquet out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Header names of the two season-file dialects.
ALIASES = {
    "match_day": ("Date", "date"), "home_team": ("HomeTeam", "home_team"), "away_team": ("AwayTeam", "away_team"),
    "home_goals": ("FTHG", "home_goals"), "away_goals": ("FTAG", "away_goals"), "division": ("Div",),
    "odds_h": ("B365H", "PSH", "AvgH"), "odds_d": ("B365D", "PSD", "AvgD"), "odds_a": ("B365A", "PSA", "AvgA"),
}
DATE_FORMATS = ("dd/MM/yyyy", "dd/MM/yy", "yyyy-MM-dd")
REQUIRED = ("match_day", "home_team", "away_team", "home_goals", "away_goals")


def parse_day(c: Column) -> Column:
    """The first format that reads the whole value; null if none does."""
    return F.coalesce(*[F.when(F.length(c) == len(f), F.to_date(F.try_to_timestamp(c, F.lit(f)))) for f in DATE_FORMATS])


def season_csv(spark: SparkSession, path: str, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Season files of either dialect: aliased headers, three date formats, rows without date,
    teams or goals dropped; league and season from the file name ``fd_{DIV}_{SEASON}.csv``.
    A missing required column is an error (schema drift)."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    found = {k: next((a for a in names if a in raw.columns), None) for k, names in ALIASES.items()}
    if missing := [k for k in required if not found[k]]:
        raise ValueError(f"columns missing from {path}: {', '.join(missing)}")
    number = lambda c: F.expr(f"cast(floor(try_cast(trim(`{c}`) as double)) as int)")
    cols = {"match_day": parse_day(F.trim(F.col(found["match_day"])))}
    cols |= {k: F.nullif(F.trim(F.col(found[k])), F.lit("")) for k in ("home_team", "away_team", "division") if found[k]}
    cols |= {k: number(found[k]) for k in ("home_goals", "away_goals")}
    cols |= {k: F.expr(f"try_cast(`{found[k]}` as double)") for k in ("odds_h", "odds_d", "odds_a") if found[k]}
    name = F.col("_metadata.file_name")
    rows = raw.select(*[c.alias(k) for k, c in cols.items()], F.regexp_extract(name, r"fd_([^_]+)_(.+)\.csv", 1).alias("league"), F.regexp_extract(name, r"fd_([^_]+)_(.+)\.csv", 2).alias("season"))
    return rows.dropna(subset=list(required))


def derived(rows: DataFrame) -> DataFrame:
    """total_goals, goal_diff, over_2_5, over_3_5, btts and result of season rows."""
    h, a = F.col("home_goals"), F.col("away_goals")
    return rows.withColumns({"total_goals": h + a, "goal_diff": h - a, "over_2_5": h + a > 2, "over_3_5": h + a > 3, "btts": (h > 0) & (a > 0), "result": F.when(h > a, 0).when(h == a, 1).otherwise(2)})


def event_json(spark: SparkSession, path: str, shots_only: bool = True, multi_line: bool = True) -> DataFrame:
    """Nested event files to flat rows: type, team, x, y, timestamp, xg, is_goal."""
    schema = "id string, minute int, timestamp string, type struct<name:string>, team struct<name:string>, location array<double>, shot struct<statsbomb_xg:double,outcome:struct<name:string>>"
    e = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    e = e.select("id", "minute", "timestamp", F.col("type.name").alias("type"), F.col("team.name").alias("team"), F.get("location", 0).alias("x"), F.get("location", 1).alias("y"), F.col("shot.statsbomb_xg").alias("xg"), F.coalesce(F.col("shot.outcome.name") == "Goal", F.lit(False)).alias("is_goal"))
    return e.where("type = 'Shot'") if shots_only else e


def history_json(spark: SparkSession, path: str, home: str, away: str) -> DataFrame:
    """``matches[]`` of history files with ``score.ft``, where both names contain what is asked for."""
    schema = "matches array<struct<id:long,team1:string,team2:string,score:struct<ft:array<long>>>>"
    m = spark.read.schema(schema).json(path).select(F.explode("matches").alias("m")).select("m.*")
    asked = F.contains(F.lower("team1"), F.lit(home.lower())) & F.contains(F.lower("team2"), F.lit(away.lower()))
    return m.where(asked & (F.size("score.ft") == 2)).select("id", "team1", "team2", F.col("score.ft")[0].alias("home_score"), F.col("score.ft")[1].alias("away_score"))


def tree(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet folders of several generations, united by name; missing columns are null."""
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(p) for p in paths])


def by_candidates(df: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns under their canonical names: the first candidate there is, whatever its case."""
    have = {c.lower(): c for c in df.columns}
    found = {k: next((have[a.lower()] for a in options if a.lower() in have), None) for k, options in names.items()}
    if missing := [k for k, v in found.items() if v is None]:
        raise ValueError(f"no column for {', '.join(missing)} among {', '.join(df.columns)}")
    return df.select(*[F.col(f"`{v}`").alias(k) for k, v in found.items()])


def valuation(text: Column) -> Column:
    """'€12.5m' -> 12,500,000; '€300k' -> 300,000; plain digits; anything else 0."""
    bare = F.lower(F.regexp_replace(text, "[^0-9.,mkMK]", ""))
    value = F.regexp_extract(bare, r"^([0-9]+(?:\.[0-9]+)?)[mk]$", 1)
    unit = F.when(bare.endswith("m"), 1e6).otherwise(1e3)
    digits = F.regexp_replace(bare, "[.,]", "")
    return F.when(value != "", value.cast("double") * unit).when(digits.rlike("^[0-9]+$"), digits.cast("double")).otherwise(0.0)


def read_or(spark: SparkSession, path: str, schema: str, fallback: DataFrame | None = None) -> DataFrame:
    """Parquet with the named schema (missing columns are null); the fallback where there is no such path."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        if fallback is None:
            raise
        return fallback


def verified_files(spark: SparkSession, path: str, digests: DataFrame) -> DataFrame:
    """path, ok: files under ``path`` whose SHA-256 the manifest (name, sha256) names."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("actual"))
    return digests.join(files, "name", "left").select("name", F.coalesce(F.col("actual") == F.col("sha256"), F.lit(False)).alias("ok"))


def write_sorted(df: DataFrame, path: str, by: str, order: list[str]) -> None:
    """One file set a key, sorted inside: later reads prune by the key and skip by statistics."""
    df.repartition(by).sortWithinPartitions(by, *order).write.mode("overwrite").partitionBy(by).parquet(path)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key isn't stored yet; how many there were. Repeating it adds nothing."""
    from pyspark.errors import AnalysisException

    spark = df.sparkSession
    try:
        fresh = df.join(spark.read.parquet(path).select(key), key, "left_anti")
    except AnalysisException:
        fresh = df
    fresh = fresh.dropDuplicates([key]).persist()
    try:
        n = fresh.count()
        if n:
            fresh.write.mode("append").parquet(path)
        return n
    finally:
        fresh.unpersist()


def upserted(stored: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key over both."""
    from pyspark.sql import Window

    both = stored.unionByName(new, allowMissingColumns=True)
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).where("_n = 1").drop("_n")


def retained(df: DataFrame, time: str, as_of: str, days: int = 30) -> DataFrame:
    return df.where(F.col(time) >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))
