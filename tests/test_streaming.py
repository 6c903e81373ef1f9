import pytest
from pyspark.sql import functions as F

from touchline.streaming import live

SCHEMA = "id long, book string, price double, ts timestamp"


def ticks(spark):
    return spark.sql("SELECT id, concat('b', id % 3) AS book, round(id % 7 / 10.0, 1) AS price, timestamp_seconds(1700000000 + id * 60) AS ts FROM range(60)").selectExpr("id", "book", "cast(price AS double) price", "ts")


def test_micro_batches_equal_the_batch_result(spark, tmp_path):
    path = str(tmp_path / "ticks")
    ticks(spark).repartition(6).write.parquet(path)
    batch = live.latest_price(spark.read.parquet(path), ["book"], "price", "ts", "id").collect()
    stream = live.run_once(live.latest_price(live.event_stream(spark, path, 1), ["book"], "price", "ts", "id"), "complete", "t")
    assert sorted(stream.collect()) == sorted(batch)


def test_appended_batches_and_late_rule(spark, tmp_path):
    path = str(tmp_path / "ticks")
    ticks(spark).repartition(4).write.parquet(path)
    kick = spark.createDataFrame([("b0", 1700000000 + 1800), ("b1", 1700000000)], "book string, at long").select("book", F.timestamp_seconds("at").alias("kickoff"))
    rule = lambda df: live.on_time(df, kick, "book", "ts", "kickoff").select("id")
    got = live.run_once(rule(live.event_stream(spark, path, 1)), "append", "t").select("id")
    assert sorted(got.collect()) == sorted(rule(spark.read.parquet(path)).collect()) and got.count() == 10


def test_sessions_keep_a_gap_of_exactly_the_limit(spark):
    e = spark.createDataFrame([(1, 0), (1, 299), (1, 1000), (2, 0)], "k int, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    assert sorted((r["k"], r["n"]) for r in live.sessions(e, ["k"], "ts", "5 minutes").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_repeats_within_the_watermark(spark, tmp_path):
    path = str(tmp_path / "t")
    ticks(spark).unionByName(ticks(spark)).coalesce(1).write.parquet(path)
    got = live.run_once(live.without_repeats(live.event_stream(spark, path), ["id", "price"], "ts", "2 hours"), "append", "r")
    assert got.count() == 60


@pytest.mark.parametrize("size", [3, 1000])
def test_buffer_keeps_the_newest_samples_over_batches_and_a_restart(spark, tmp_path, size):
    """Late rows, rows with equal times, null values and a key that only the second run sees."""
    import random

    import pandas as pd
    from pyspark.sql import functions as F

    from touchline.streaming import buffers

    rnd = random.Random(size)
    rows = [(i, rnd.choice("ab") if i < 60 else rnd.choice("abc"), rnd.randrange(40), None if i % 17 == 0 else rnd.random()) for i in range(120)]
    folder, out, state = (str(tmp_path / x) for x in ("ticks", "out", "state"))
    frame = spark.createDataFrame(rows, "id long, kind string, at long, value double").withColumn("ts", F.timestamp_seconds("at"))
    for a, b in ((0, 20), (20, 60), (60, 120)):
        frame.where(f"id >= {a} and id < {b}").coalesce(2).write.mode("append").parquet(folder)
        ticks = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        buffers.drain(buffers.buffered(ticks, ["kind"], "value", "ts", "id", size), out, state)
    got = {r["kind"]: r.asDict() for r in buffers.latest(spark, out, ["kind"]).collect()}
    for kind in "abc":
        mine = sorted((at, i, v) for i, k, at, v in rows if k == kind and v is not None)[-size:]
        want = buffers.statistics(pd.Series([v for _, _, v in mine]))
        assert {k: got[kind][k] for k in want} == pytest.approx(want)
        v = sorted(v for _, _, v in mine)
        assert want["p95"] == v[int(len(v) * 0.95)] and want["n"] == min(size, len(v))
