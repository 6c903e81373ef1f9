"""Relational operators over matches: settled filter, two rows a match, latest per key, as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SETTLED_STATUSES = ("finished", "ft", "completed")


def settled(matches: DataFrame) -> DataFrame:
    """Finished matches with both scores."""
    return matches.where(F.lower("status").isin(*SETTLED_STATUSES) & F.col("home_score").isNotNull() & F.col("away_score").isNotNull())


def points(gf: Column, ga: Column) -> Column:
    return F.when(gf > ga, 3).when(gf == ga, 1).otherwise(0)


def team_rows(matches: DataFrame) -> DataFrame:
    """Two rows a match, one for either side, from one scan."""
    side = lambda me, other, gf, ga, home: F.struct(F.col(me).alias("team"), F.col(other).alias("opponent"), F.col(gf).alias("gf"), F.col(ga).alias("ga"), F.lit(home).alias("is_home"))
    both = F.explode(F.array(side("home_id", "away_id", "home_score", "away_score", True), side("away_id", "home_id", "away_score", "home_score", False)))
    rows = matches.select("match_id", "league_id", "match_date", both.alias("s")).select("match_id", "league_id", "match_date", "s.*")
    return rows.withColumn("points", points(F.col("gf"), F.col("ga")))


def latest(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order. Ranks are limited before the
    shuffle where n is small (Spark's window group limit)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


#: Rows that a task sorts or groups, where the number of tasks grows with the table.
TASK_ROWS = 500_000


def tasks(rows: DataFrame) -> int:
    """As many tasks as TASK_ROWS rows each ask for, the session's number at least."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))


def newest_before(rows: DataFrame, keys: list[str], days: int, values: list[str], out: str, n: int = 5) -> DataFrame:
    """``rows`` with ``out``: the newest n rows of the key (structs of match_date, match_id and ``values``, newest first) strictly before each row's match_date
    and at most ``days`` before it; empty if there are none. The n newest of each date are gathered first, then those of the n dates before,
    so no frame holds more than n * n rows, however dense the matches are."""
    dated = latest(rows.where(F.col("match_date").isNotNull()), [*keys, "match_date"], [F.desc("match_id")], n)
    dated = dated.groupBy(*keys, "match_date").agg(F.sort_array(F.collect_list(F.struct("match_date", "match_id", *values)), asc=False).alias("_own"))
    earlier = F.flatten(F.collect_list("_own").over(Window.partitionBy(*keys).orderBy("match_date").rowsBetween(-n, -1)))
    since = F.col("match_date") - F.make_dt_interval(F.lit(days))
    near = F.slice(F.sort_array(F.filter(earlier, lambda x: x["match_date"] >= since), asc=False), 1, n)
    found = dated.select(*[F.col(k).alias(f"_{k}") for k in (*keys, "match_date")], near.alias(out))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("match_date") == F.col("_match_date")]
    joined = rows.join(found, on, "left").drop(*[f"_{k}" for k in (*keys, "match_date")])
    return joined.withColumn(out, F.coalesce(out, F.array().cast(found.schema[out].dataType)))


def latest_with_ties(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """All rows at the key's greatest ``by``."""
    return rows.withColumn("_rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(by)))).where("_rank = 1").drop("_rank")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], tie: list[str]) -> DataFrame:
    """For each left row, ``values`` of the last right row of the key strictly before it. Both
    sides meet in one sorted stream a key, so the cost is a shuffle and a sort, without pairs."""
    tagged = lambda df, time, own: df.withColumns({"_time": F.col(time), "_left": F.lit(own)})
    carried = F.struct(*[F.col(v) for v in values])
    l = tagged(left, left_time, 0).select(*keys, "_time", "_left", F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(carried.alias("c")).schema["c"].dataType).alias("_value"), *[F.lit(None).cast(right.schema[t].dataType).alias(f"_{t}") for t in tie])
    r = tagged(right, right_time, 1).select(*keys, "_time", "_left", F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), carried.alias("_value"), *[F.col(t).alias(f"_{t}") for t in tie])
    order = Window.partitionBy(*keys).orderBy("_time", "_left", *[f"_{t}" for t in tie])  # left rows precede right rows of their instant
    both = l.unionByName(r).withColumn("_last", F.last("_value", True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    return both.where("_left = 0").select("_row.*", *[F.col(f"_last.{v}").alias(v) for v in values])


def standings(matches: DataFrame) -> DataFrame:
    """League tables with positions (points, goal difference, goals for, team)."""
    rows = team_rows(settled(matches))
    t = rows.groupBy("league_id", "team").agg(
        F.count("*").alias("played"), F.count_if(F.col("points") == 3).alias("won"), F.count_if(F.col("points") == 1).alias("drawn"), F.count_if(F.col("points") == 0).alias("lost"),
        F.sum("gf").alias("gf"), F.sum("ga").alias("ga"), F.sum("points").alias("points"),
    )
    t = t.withColumn("gd", F.col("gf") - F.col("ga"))
    order = Window.partitionBy("league_id").orderBy(F.desc("points"), F.desc("gd"), F.desc("gf"), "team")
    return t.withColumn("position", F.row_number().over(order).cast("long"))
