import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import calibration as cal
from touchline.operators import learning as lr
from touchline.operators import similarity as sim
from touchline.sources import files


def test_pooled_is_monotone_and_keeps_the_total():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 30, 80).astype(float)
    y = rng.binomial(n.astype(int), np.linspace(0.1, 0.8, 80)).astype(float)
    fit = cal.pooled(y, n)
    assert (np.diff(fit) >= -1e-12).all() and (fit * n).sum() == pytest.approx(y.sum())
    # no other monotone fit of two levels is nearer
    best = (n * (y / n - fit) ** 2).sum()
    for k in range(1, 80):
        level = np.repeat([y[:k].sum() / n[:k].sum(), y[k:].sum() / n[k:].sum()], [k, 80 - k])
        if level[0] <= level[-1]:
            assert best <= (n * (y / n - level) ** 2).sum() + 1e-9


def test_platt_finds_slope_and_intercept():
    p = np.linspace(0.05, 0.95, 60)
    n = np.full(60, 5000.0)
    q = 1 / (1 + np.exp(-(0.6 * np.log(p / (1 - p)) - 0.3)))
    a, b = cal.platt(p, q * n, n)
    assert a == pytest.approx(0.6, abs=1e-3) and b == pytest.approx(-0.3, abs=1e-3)


def forecasts(spark, n):
    """Overconfident probabilities of three classes with known outcomes."""
    z = [F.exp(lr.normal(40 + k, "id") * 1.5) for k in range(3)]
    total = z[0] + z[1] + z[2]
    true = [0.5 * x / total + 0.5 / 3 for x in z]
    u = lr.uniform(77, "id")
    hit = [u < true[0], (u >= true[0]) & (u < true[0] + true[1]), u >= true[0] + true[1]]
    return spark.range(n).select("id", F.lit("L").alias("league"), *[(x / total).alias(f"p_{k}") for k, x in zip("hda", z)], *[y.cast("double").alias(f"y_{k}") for k, y in zip("hda", hit)])


@pytest.mark.parametrize("isotonic_from", [100, 10**9])
def test_report_improves_on_overconfidence(spark, isotonic_from):
    long = cal.long_form(forecasts(spark, 6000), "league", {k: (f"p_{k}", f"y_{k}") for k in "hda"})
    maps = cal.fitted(long.where("id < 4000"), isotonic_from)
    out = cal.report(cal.applied(long.where("id >= 4000"), maps, ["id"]), ["id"]).first()
    assert out["n"] == 2000 and out["method"] == ("isotonic" if isotonic_from == 100 else "platt")
    assert out["brier_q"] < out["brier_p"] and out["ece_q"] < out["ece_p"] / 2
    none = cal.applied(long.where("id >= 4000"), maps.where("grp = 'other'"), ["id"])
    assert none.where("abs(q - p) > 1e-9").count() == 0


def test_refit_names_its_method(spark):
    rows = spark.createDataFrame([(i, float(i % 3), i * 0.04 + 0.02, 5) for i in range(20)], "bin int, y double, p double, n long").withColumn("p", F.col("p") * 5)
    assert cal.refitted(rows).first()["method"] == "isotonic" and cal.refitted(rows, 1000).first()["method"] == "platt"
    out = cal.refitted(rows).first()
    assert out["rows"] == 100 and out["brier_after"] <= out["brier_before"]


def test_every_query_meets_every_other_row_once(spark, monkeypatch):
    monkeypatch.setattr(sim, "ROWS", 7)
    monkeypatch.setattr(sim, "QUERIES", 2)
    v = spark.range(40).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    got = sim.query_pairs(v, v.where("id % 5 = 0"), "id", "v")
    assert sorted((r["query_id"], r["id"]) for r in got.collect()) == sorted((q, i) for q in range(0, 40, 5) for i in range(40) if i != q)
    assert sim.query_pairs(v.limit(0), v.limit(0), "id", "v").count() == 0


def test_scenarios_change_only_what_they_name(spark):
    rows = spark.range(400).select("id", F.lit(1.0).alias("home_attack"), F.lit(1.0).alias("away_defense"), F.lit(2.0).alias("home_xg"), F.lit(0.9).alias("y"))
    hurt = lr.injured(rows, "id", "y")
    assert hurt.where("home_attack <> 1 AND NOT (side = 'home' AND position = 'attack')").count() == 0
    assert {round(r[0], 4) for r in hurt.select("home_attack").distinct().collect()} == {1.0, 0.85}
    assert {round(r[0], 4) for r in hurt.select("y").distinct().collect()} == {0.765, 1.0}
    sky = lr.weathered(rows, "id", "y")
    assert {(r[0], round(r[1], 3)) for r in sky.select("weather", "home_xg").distinct().collect()} == {("rain", 1.84), ("wind", 1.94), ("snow", 1.5), ("heat", 2.0)}
    assert lr.refereed(rows, "id").select("referee").distinct().count() == 3
    assert lr.augmented(rows, "id", "y").groupBy("origin").count().where("count <> 400").count() == 0


def test_candidates_and_generations(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "Game_ID int, XG_Home double")
    assert files.by_candidates(df, {"id": ("id", "game_id"), "xg": ("home_xg", "xg_home")}).columns == ["id", "xg"]
    with pytest.raises(ValueError, match="day"):
        files.by_candidates(df, {"day": ("date",)})
    (tmp_path / "h.json").write_text('{"matches": [{"id": 1, "team1": "Big Club FC", "team2": "Other", "score": {"ft": [2, 1]}}, {"id": 2, "team1": "Big Club FC", "team2": "Other", "score": {}}]}')
    got = files.history_json(spark, str(tmp_path / "h.json"), "big club", "OTHER").collect()
    assert [(r["id"], r["home_score"], r["away_score"]) for r in got] == [(1, 2, 1)]


def test_dropout_draws_follow_the_key(spark):
    rows = spark.range(1200).select("id", F.lit(1.0).alias("h"), F.lit(0.0).alias("d"), F.lit(-1.0).alias("a"))
    draw = lambda df, **k: {r["id"]: r["u"].asDict() for r in df.select("id", lr.dropout_passes(F.xxhash64("id"), F.col("h"), F.col("d"), F.col("a"), **k).alias("u")).collect()}
    one, two = draw(rows), draw(rows.repartition(5))
    assert one == two and one[1] != one[2]
    whole = draw(rows, keep=1.0)[7]
    e = np.exp([1.0, 0.0, -1.0])
    assert whole["mean"] == pytest.approx(e / e.sum()) and whole["epistemic"] == pytest.approx(0, abs=1e-12)
    assert all(u["ci_lower"][0] <= u["mean"][0] <= u["ci_upper"][0] for u in one.values())


def test_calibrated_rows_stay_in_all_partitions(spark):
    long = cal.long_form(forecasts(spark, 600), "league", {k: (f"p_{k}", f"y_{k}") for k in "hda"})
    out = cal.applied(long, cal.fitted(long), ["id"])
    # Spark joins partitions of other shuffles up to one for each core
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
