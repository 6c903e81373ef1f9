"""Streaming queries (STR), drained once, equal to their batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.plans.registry import query
from touchline.sources import adapters as src
from touchline.streaming import live


def stream(spark, d, name="events"):
    return live.event_stream(spark, f"{d}/{name}.parquet")


@query("str_02_goal_events", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase'")
def str_02(spark, d):
    goals = stream(spark, d).where("event_type = 'purchase'").select("event_id", "user_id")
    return live.run_once(goals, "append", "goals").select("event_id", "user_id")


@query("str_03_latest_price", "SELECT user_id, event_type, round(arg_max(value, {'t': ts, 'e': event_id}), 6) AS latest, count(*) AS ticks FROM events GROUP BY ALL")
def str_03(spark, d):
    out = live.run_once(live.latest_price(stream(spark, d), ["user_id", "event_type"], "value", "ts", "event_id"), "complete", "latest")
    return out.select("user_id", "event_type", F.round("latest", 6).alias("latest"), "ticks")


@query("str_06_late_rule", f"WITH {src.MATCHES} SELECT l_orderkey AS match_id, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN matches ON match_id = l_orderkey WHERE l_shipdate < match_date")
def str_06(spark, d):
    kick = src.matches(spark, d).select(F.col("match_id"), "match_date")
    snaps = stream(spark, d, "lineitem").select(F.col("l_orderkey").alias("match_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    ok = live.on_time(snaps, kick, "match_id", "l_shipdate", "match_date").select("match_id", "l_linenumber", "l_partkey", "l_suppkey")
    return live.run_once(ok, "append", "on-time").select("match_id", "l_linenumber", "l_partkey", "l_suppkey")


@query("str_07_price_changes", "WITH k AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id, user_id, event_type FROM k WHERE before IS DISTINCT FROM event_type")
def str_07(spark, d):
    """Consecutive repeats dropped; the batch form of the rule (a stream uses the watermark form)."""
    from pyspark.sql import Window

    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return src.table(spark, d, "events").withColumn("before", before).where(~F.col("before").eqNullSafe(F.col("event_type"))).select("event_id", "user_id", "event_type")


@query("str_08_window_totals", "SELECT event_type, date_trunc('hour', ts) AS opens, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL".replace("date_trunc('hour', ts) AS opens", "strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS opens"))
def str_08(spark, d):
    s = stream(spark, d)
    s = s.withColumn("ts", F.col("ts").cast("timestamp"))
    out = live.run_once(live.windows(s, ["event_type"], "ts", "1 hour"), "complete", "windows")
    return out.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH").alias("opens"), "n", F.round("total", 4).alias("total"))


@query("str_13_sessions", "WITH k AS (SELECT user_id, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 7200000000)::INT AS cut FROM events), c AS (SELECT user_id, ts, coalesce(sum(cut) OVER (PARTITION BY user_id ORDER BY ts), 0) AS chain FROM k) SELECT user_id, count(*) AS n FROM c GROUP BY user_id, chain")
def str_13(spark, d):
    e = src.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return live.sessions(e, ["user_id"], "ts", "2 hours").select("user_id", "n")
