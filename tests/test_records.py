"""Stores that are written and read back, settlement, ownership, gaps, maps, flips."""

import pytest
from pyspark.sql import functions as F

from touchline.operators import learning
from touchline.plans import records
from touchline.sources import files

STORED = "match_id long, status string, home_score long, away_score long"


def test_settlement(spark):
    stored = spark.createDataFrame([(1, "scheduled", None, None), (2, "FT", 1, 1), (3, "postponed", None, None), (4, "scheduled", None, None)], STORED)
    results = spark.createDataFrame([(1, 2, 0), (1, 1, 0), (2, 9, 9), (3, None, 1), (7, 1, 1), (None, 1, 1)], "match_id long, home_score long, away_score long")
    got = {r.match_id: tuple(r)[1:] for r in records.settled_by(stored, results).collect()}
    assert got == {1: ("finished", 2, 0, "updated"), 2: ("FT", 1, 1, "already_settled"), 3: ("postponed", None, None, "untouched"), 4: ("scheduled", None, None, "untouched"), 7: (None, None, None, "unmatched")}
    again = records.settled_by(spark.createDataFrame([(1, "finished", 2, 0)], STORED), results.where("match_id = 1")).first()
    assert again.fate == "already_settled"
    assert records.settled_by(stored, results.limit(0)).where("fate <> 'untouched'").count() == 0


def test_ownership(spark):
    m = spark.createDataFrame([("A", 1, 2), ("A", 1, 3), ("B", 1, 9)], "league_id string, home_id long, away_id long")
    rows = spark.createDataFrame([(1, "A"), (1, "B"), (9, "A"), (3, "A")], "team long, league_id string")
    own = spark.createDataFrame([(1, "A"), (2, "A"), (3, None)], "team long, league string")
    assert tuple(records.ownership(m, rows, own).first()) == (1, 2, 2, 3, "FAIL")
    assert records.ownership(m.limit(1), rows.limit(1), own).first().status == "PASS"
    assert tuple(records.ownership(m.limit(0), rows.limit(0), own).first()) == (0, 0, 0, 0, "PASS")


def test_gaps(spark):
    rows = [(1, [" Odds  feed", "odds feed", None, "", "Conflicting Odds", "lineup conflict", "MISSING form", "odds feed "]), (2, None), (3, [])]
    got = {r.id: r for r in records.evidence(spark.createDataFrame(rows, "id int, g array<string>"), F.col("g")).collect()}
    assert (got[1].critical, got[1].advisory, got[1].conflicts) == (["MISSING form"], ["Odds feed"], ["Conflicting Odds", "lineup conflict"])
    assert len(got[1].gaps) == 4 and got[2].gaps == got[3].gaps == []


def test_maps(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"},), (None,), ({},)], "m map<string, string>")
    new = F.create_map(F.lit("b"), F.lit("9"), F.lit("t"), F.lit("0"))
    got = [r.m for r in df.select(records.without(records.merged(F.col("m"), new), "t").alias("m")).collect()]
    assert got == [{"a": "1", "b": "9"}, {"b": "9"}, {"b": "9"}]


def test_read_through(spark, tmp_path):
    path, schema = str(tmp_path / "store"), "id long, v double"
    one = spark.createDataFrame([(1, 1.0), (2, 2.0)], schema)
    assert files.append_new(one, path, "id") == 2
    far = spark.createDataFrame([(2, 9.0), (3, 3.0), (3, 3.0)], schema)
    assert {tuple(r) for r in records.read_through(spark, path, schema, far, "id").collect()} == {(1, 1.0), (2, 2.0), (3, 3.0)}
    broken = far.withColumn("v", F.when(F.col("id") > 0, F.raise_error(F.lit("down")).cast("double")))
    assert records.read_through(spark, path, schema, broken.withColumn("id", F.col("id") + 10), "id").count() == 3
    with pytest.raises(Exception):
        records.read_through(spark, str(tmp_path / "none"), schema, broken.withColumn("id", F.col("id") + 10), "id").count()


def test_flips(spark):
    df = spark.range(5000).select("id", (F.col("id") % 2).cast("int").alias("won"), F.rand(1).alias("x"))
    once, twice = (learning.perturbed(df, "id", ["x"], binary=("won",)).select("id", "won").orderBy("id").collect() for _ in range(2))
    turned = sum(r.won != r.id % 2 for r in once)
    assert once == twice and 400 < turned < 600 and {r.won for r in once} == {0, 1}
