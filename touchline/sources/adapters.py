"""Domain views over the benchmark tables, and the same views as SQL for the oracle.

All expressions are exact in integers, so both engines see equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, league_id, home_id, away_id, match_date, scores, status."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "finished").when(F.col("o_orderstatus") == "O", "scheduled").otherwise("postponed")
    return o.select(
        F.col("o_orderkey").alias("match_id"), F.col("o_orderpriority").alias("league_id"), (F.col("o_custkey") % 20).alias("home_id"),
        ((F.col("o_custkey") % 20 + 1 + F.col("o_orderkey") % 19) % 20).alias("away_id"), F.col("o_orderdate").alias("match_date"),
        (F.floor("o_totalprice") % 5).cast("long").alias("home_score"), (F.floor(F.col("o_totalprice") / 7) % 4).cast("long").alias("away_score"), status.alias("status"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, snap_no, bookmaker, three odds, captured_at, is_closing. The pair (snap_no, part_no, supp_no) tells rows of a match apart."""
    s = table(spark, sf_dir, "lineitem")
    return s.select(
        F.col("l_orderkey").alias("match_id"), F.col("l_linenumber").cast("long").alias("snap_no"), F.col("l_partkey").alias("part_no"), F.col("l_suppkey").alias("supp_no"), (F.col("l_suppkey") % 6).alias("bookmaker"),
        (F.lit(1.2) + (F.col("l_partkey") % 400) / 100.0).alias("odds_h"), (F.lit(2.5) + (F.col("l_suppkey") % 30) / 10.0).alias("odds_d"), (F.lit(1.3) + ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 500) / 100.0).alias("odds_a"),
        F.col("l_shipdate").alias("captured_at"), (F.col("l_returnflag") == "R").alias("is_closing"),
    )


def predictions(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """match_id, pred ids, model_version, three probabilities, confidence, created_at; dealt to ``tasks`` by the ids, where each row is long work and files cut unevenly."""
    s = table(spark, sf_dir, "lineitem")
    if tasks:
        s = s.repartition(tasks, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    h, d, a = F.col("l_partkey") % 7 + 1, F.col("l_suppkey") % 5 + 1, F.col("l_linenumber") % 6 + 1
    p = s.select(
        F.col("l_orderkey").alias("match_id"), F.col("l_linenumber").cast("long").alias("snap_no"), F.col("l_partkey").alias("part_no"), F.col("l_suppkey").alias("supp_no"), F.col("l_linestatus").alias("model_version"),
        (h / (h + d + a)).alias("p_h"), (d / (h + d + a)).alias("p_d"), (a / (h + d + a)).alias("p_a"), F.col("l_shipdate").alias("created_at"),
    )
    return p.withColumn("confidence", F.greatest("p_h", "p_d", "p_a"))


def quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``snapshots`` and ``predictions`` of the same line items side by side, from one scan."""
    h, d, a = F.col("l_partkey") % 7 + 1, F.col("l_suppkey") % 5 + 1, F.col("l_linenumber") % 6 + 1
    s = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("match_id"), F.col("l_linenumber").cast("long").alias("snap_no"), F.col("l_partkey").alias("part_no"), F.col("l_suppkey").alias("supp_no"), (F.col("l_suppkey") % 6).alias("bookmaker"),
        (F.lit(1.2) + (F.col("l_partkey") % 400) / 100.0).alias("odds_h"), (F.lit(2.5) + (F.col("l_suppkey") % 30) / 10.0).alias("odds_d"), (F.lit(1.3) + ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 500) / 100.0).alias("odds_a"),
        F.col("l_shipdate").alias("captured_at"), (F.col("l_returnflag") == "R").alias("is_closing"), F.col("l_linestatus").alias("model_version"),
        (h / (h + d + a)).alias("p_h"), (d / (h + d + a)).alias("p_d"), (a / (h + d + a)).alias("p_a"), F.col("l_shipdate").alias("created_at"),
    )
    return s.withColumn("confidence", F.greatest("p_h", "p_d", "p_a"))


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, minute, seq, team, xg, x, y, event_type from the event table."""
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("event_id") % 97).alias("match_id"), (F.col("event_id") * 7 % 95).alias("minute"), F.col("event_id").alias("seq"), (F.col("user_id") % 2).alias("team"),
        (F.col("event_id") % 50 / 100.0).alias("xg"), (F.col("event_id") * 13 % 120).alias("x"), (F.col("event_id") * 29 % 80).alias("y"), F.col("event_type"),
    )


MATCHES = """matches AS (SELECT o_orderkey AS match_id, o_orderpriority AS league_id, o_custkey % 20 AS home_id,
  (o_custkey % 20 + 1 + o_orderkey % 19) % 20 AS away_id, o_orderdate AS match_date,
  CAST(floor(o_totalprice) AS BIGINT) % 5 AS home_score, CAST(floor(o_totalprice / 7) AS BIGINT) % 4 AS away_score,
  CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'scheduled' ELSE 'postponed' END AS status FROM orders)"""
SETTLED = MATCHES + """, settled AS (SELECT * FROM matches WHERE lower(status) IN ('finished', 'ft', 'completed') AND home_score IS NOT NULL AND away_score IS NOT NULL)"""
TEAM_ROWS = SETTLED + """, both_sides AS (
  SELECT match_id, league_id, home_id AS team, away_id AS opponent, home_score AS gf, away_score AS ga, TRUE AS is_home, match_date FROM settled
  UNION ALL SELECT match_id, league_id, away_id, home_id, away_score, home_score, FALSE, match_date FROM settled),
team_rows AS (SELECT *, CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END AS points FROM both_sides)"""
SNAPSHOTS = """snaps AS (SELECT l_orderkey AS match_id, CAST(l_linenumber AS BIGINT) AS snap_no, l_partkey AS part_no, l_suppkey AS supp_no, l_suppkey % 6 AS bookmaker,
  1.2::DOUBLE + (l_partkey % 400) / 100.0::DOUBLE AS odds_h, 2.5::DOUBLE + (l_suppkey % 30) / 10.0::DOUBLE AS odds_d,
  1.3::DOUBLE + ((l_partkey * 7 + l_linenumber) % 500) / 100.0::DOUBLE AS odds_a, l_shipdate AS captured_at, l_returnflag = 'R' AS is_closing FROM lineitem)"""
PREDICTIONS = """weights AS (SELECT *, l_partkey % 7 + 1 AS wh, l_suppkey % 5 + 1 AS wd, l_linenumber % 6 + 1 AS wa FROM lineitem),
preds AS (SELECT l_orderkey AS match_id, CAST(l_linenumber AS BIGINT) AS snap_no, l_partkey AS part_no, l_suppkey AS supp_no, l_linestatus AS model_version,
  CAST(wh AS DOUBLE) / (wh + wd + wa) AS p_h, CAST(wd AS DOUBLE) / (wh + wd + wa) AS p_d, CAST(wa AS DOUBLE) / (wh + wd + wa) AS p_a, l_shipdate AS created_at,
  CAST(greatest(wh, wd, wa) AS DOUBLE) / (wh + wd + wa) AS confidence FROM weights)"""
QUOTED = """j AS (SELECT *, greatest(p_h, p_d, p_a) AS confidence FROM (
  SELECT l_orderkey AS match_id, CAST(l_linenumber AS BIGINT) AS snap_no, l_partkey AS part_no, l_suppkey AS supp_no, l_suppkey % 6 AS bookmaker,
    1.2::DOUBLE + (l_partkey % 400) / 100.0::DOUBLE AS odds_h, 2.5::DOUBLE + (l_suppkey % 30) / 10.0::DOUBLE AS odds_d, 1.3::DOUBLE + ((l_partkey * 7 + l_linenumber) % 500) / 100.0::DOUBLE AS odds_a,
    l_shipdate AS captured_at, l_returnflag = 'R' AS is_closing, l_linestatus AS model_version, CAST(wh AS DOUBLE) / (wh + wd + wa) AS p_h, CAST(wd AS DOUBLE) / (wh + wd + wa) AS p_d, CAST(wa AS DOUBLE) / (wh + wd + wa) AS p_a, l_shipdate AS created_at
  FROM (SELECT *, l_partkey % 7 + 1 AS wh, l_suppkey % 5 + 1 AS wd, l_linenumber % 6 + 1 AS wa FROM lineitem)))"""
SHOTS = """shots AS (SELECT event_id % 97 AS match_id, event_id * 7 % 95 AS minute, event_id AS seq, user_id % 2 AS team,
  (event_id % 50) / 100.0::DOUBLE AS xg, event_id * 13 % 120 AS x, event_id * 29 % 80 AS y, event_type FROM events)"""
