import hashlib
import json

import pytest
from pyspark.sql import functions as F

from touchline.sources import files


def test_both_season_dialects_and_bad_rows(spark, tmp_path):
    (tmp_path / "fd_E0_2324.csv").write_text("﻿Div,Date,HomeTeam,AwayTeam,FTHG,FTAG,B365H\nE0,12/08/2023,\"A, B\",C,2,1,1.9\nE0,bad,A,C,1,1,2\nE0,13/08/23,A,,1,1,2\nE0,13/08/23,A,D,,1,2\nE0,13/08/23,A,D,1.0,1,x\n", encoding="utf-8")
    rows = files.derived(files.season_csv(spark, str(tmp_path / "fd_E0_2324.csv"))).orderBy("match_day").collect()
    assert [(r["home_team"], r["home_goals"], r["league"], r["season"], r["odds_h"]) for r in rows] == [("A, B", 2, "E0", "2324", 1.9), ("A", 1, "E0", "2324", None)]
    assert rows[0]["over_2_5"] and rows[1]["result"] == 1 and str(rows[1]["match_day"]) == "2023-08-13"
    (tmp_path / "fd_SP1_2425.csv").write_text("Div,date,home_team,away_team,home_goals,away_goals\nSP1,2024-08-12,X,Y,0,0\n")
    assert files.season_csv(spark, str(tmp_path / "fd_SP1_2425.csv")).first()["league"] == "SP1"
    (tmp_path / "fd_X_1.csv").write_text("Date,HomeTeam\n1,2\n")
    with pytest.raises(ValueError, match="away_team"):
        files.season_csv(spark, str(tmp_path / "fd_X_1.csv"))


def test_event_json(spark, tmp_path):
    events = [{"id": "a", "minute": 3, "type": {"name": "Shot"}, "team": {"name": "T"}, "location": [100.5, 40], "shot": {"statsbomb_xg": 0.3, "outcome": {"name": "Goal"}}}, {"id": "b", "minute": 4, "type": {"name": "Pass"}, "team": {"name": "T"}}]
    (tmp_path / "e.json").write_text(json.dumps(events))
    rows = files.event_json(spark, str(tmp_path / "e.json")).collect()
    assert len(rows) == 1 and rows[0]["is_goal"] and rows[0]["x"] == 100.5 and rows[0]["xg"] == 0.3


def test_valuations(spark):
    df = spark.createDataFrame([("€12.5m",), ("£300k",), ("1,234.000",), ("-",), (None,)], "t string")
    assert [r[0] for r in df.select(files.valuation(F.col("t"))).collect()] == [12_500_000, 300_000, 1_234_000, 0, 0]


def test_append_new_is_idempotent_and_manifest(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, v string")
    assert files.append_new(df, path, "id") == 2 and files.append_new(df, path, "id") == 0
    assert files.append_new(spark.createDataFrame([(3, "c")], "id int, v string"), path, "id") == 1
    assert spark.read.parquet(path).count() == 3
    files.write_sorted(df, str(tmp_path / "s"), "v", ["id"])
    assert files.read_or(spark, str(tmp_path / "s"), "id int, v string, extra double").where("extra IS NULL").count() == 3
    assert files.read_or(spark, str(tmp_path / "none"), "id int", df).count() == 3
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.csv").write_bytes(b"hello")
    names = spark.createDataFrame([("x.csv", hashlib.sha256(b"hello").hexdigest()), ("y.csv", "0")], "name string, sha256 string")
    assert {r["name"]: r["ok"] for r in files.verified_files(spark, str(tmp_path / "m"), names).collect()} == {"x.csv": True, "y.csv": False}
