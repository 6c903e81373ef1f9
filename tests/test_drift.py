"""Distributions told apart, effects at the median, gates, calibrated triples, bets inside JSON."""

import math
import random

import pytest
from pyspark.sql import functions as F

from touchline.operators import drift
from touchline.plans import decisions, monitoring


def gap(a, b):
    share = lambda xs, v: sum(x <= v for x in xs) / len(xs)
    return max(abs(share(a, v) - share(b, v)) for v in set(a) | set(b))


def frame(spark, rows, names="x y"):
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names.split()))


def test_statistic_by_brute_force(spark):
    r = random.Random(3)
    a = [(r.choice([r.gauss(0, 1), 0.5]), 7.0) for _ in range(300)] + [(None, 7.0), (float("nan"), None), (float("inf"), 7.0)]
    b = [(r.choice([r.gauss(0.6, 1), 0.5]), 7.0) for _ in range(200)]
    got = {x.feature: x for x in drift.two_samples(frame(spark, a), frame(spark, b), ["x", "y"]).collect()}
    clean = [x for x, _ in a if x is not None and math.isfinite(x)]
    assert got["x"].statistic == pytest.approx(gap(clean, [x for x, _ in b]))
    assert (got["x"].n_reference, got["x"].n_current, got["x"].drift) == (300, 200, True)
    assert (got["y"].statistic, got["y"].p_value, got["y"].adjusted, got["y"].drift) == (0.0, 1.0, 1.0, False)
    assert got["x"].adjusted == pytest.approx(min(1.0, got["x"].p_value * 2))


def test_values_far_apart_share_a_range(spark):
    # one huge value puts all others into one range, whose order still decides
    a, b = [(float(i), 0.0) for i in range(50)] + [(1e12, 0.0)], [(i + 0.5, 0.0) for i in range(25)]
    got = drift.two_samples(frame(spark, a), frame(spark, b), ["x"]).first()
    assert got.statistic == pytest.approx(gap([x for x, _ in a], [x for x, _ in b]))


def test_kolmogorov(spark):
    # critical values of the limit: 10 %, 5 %, 1 %
    got = spark.createDataFrame([(1.2238,), (1.3581,), (1.6276,), (0.05,), (9.0,)], "x double").select(drift.kolmogorov(F.col("x")).alias("p")).collect()
    assert [r.p for r in got] == pytest.approx([0.1, 0.05, 0.01, 1.0, 0.0], abs=1e-4)


def test_gates(spark):
    a = frame(spark, [(float(i), 0.0) for i in range(60)])
    moved, few, other = frame(spark, [(i + 100.0, 0.0) for i in range(60)]), frame(spark, [(1.0, 0.0)] * 5), frame(spark, [(1.0, 0.0)] * 60, "x z")
    run = lambda cur, **k: drift.dataset(a, cur, **({"least_rows": 20, "share": 0.5} | k)).first()
    assert run(few).status == "INSUFFICIENT_SAMPLE" and run(few).features == 0
    assert run(other).status == "SCHEMA_MISMATCH"
    assert tuple(run(moved)) == ("DRIFT_DETECTED", 60, 60, 2, "x", 0.5)
    assert run(moved, share=0.6).status == run(a).status == "NO_DATASET_DRIFT"
    assert run(frame(spark, [])).status == "INSUFFICIENT_SAMPLE"
    for bad in ({"least_rows": 1}, {"share": 0.0}, {"share": 1.1}, {"alpha": 1.0}):
        with pytest.raises(ValueError):
            run(a, **bad)


def test_effects(spark):
    r = random.Random(5)
    rows = []
    for _ in range(201):
        x = r.choice([0.0, 1.0, 2.0, 3.0])
        won = int(r.random() < 0.2 + 0.15 * x)
        rows.append((x, float(r.random()), None if r.random() < 0.9 else 1.0, won, int(not won and r.random() < 0.4)))
    df = spark.createDataFrame(rows, "x double, a_collider double, rare double, won int, drawn int")
    got = {q.feature: q for q in drift.causal_screen(df, ["x", "a_collider", "rare"], "won", "drawn").collect()}
    assert set(got) == {"x", "a_collider"} and got["a_collider"]["class"] == "COLLIDER_WARNING" and got["x"]["class"] == "CAUSAL_DRIVER"
    for i, name in enumerate(("x", "a_collider")):
        middle = sorted(q[i] for q in rows)[100]
        one, two = [q for q in rows if q[i] >= middle], [q for q in rows if q[i] < middle]
        mean = lambda qs, k: sum(q[k] for q in qs) / len(qs)
        assert (got[name].median, got[name].treated, got[name].control) == (middle, len(one), len(two))
        assert got[name].ate_win == pytest.approx(mean(one, 3) - mean(two, 3)) and got[name].ate_draw == pytest.approx(mean(one, 4) - mean(two, 4))
    even = spark.createDataFrame([(float(i), i % 2, 0) for i in range(40)], "x double, won int, drawn int")
    assert drift.causal_screen(even, ["x"], "won", "drawn").first().median == 19.5


def test_triples_add_up(spark):
    k = monitoring.cal_01_one_vs_rest(spark, "/root/testdata/sf0.001", isotonic_from=50)
    low, high, n = k.agg(F.min(F.col("q_h") + F.col("q_d") + F.col("q_a")), F.max(F.col("q_h") + F.col("q_d") + F.col("q_a")), F.count("*")).first()
    assert low == pytest.approx(1.0) and high == pytest.approx(1.0) and n > 500
    s = monitoring.sim_03_intervals(spark, "/root/testdata/sf0.001")
    assert s.where("low_h > sim_p_h OR high_h < sim_p_h OR low_h < -1e-12 OR high_h > 1 + 1e-12").count() == 0


def test_broken_json_bets(spark):
    text = ['{"value_bets": [{"outcome": "h", "edge_percent": 5.0, "confidence": 0.7}, {"outcome": "d", "edge_percent": 9.0, "confidence": 0.1}, {"outcome": "a"}]}', "not json", '{"value_bets": 3}', '{"value_bets": []}', None, "{}"]
    stored = spark.createDataFrame(list(enumerate(text)), "id int, features string")
    got = decisions.nested_bets(stored, "features", ["id"], 4.2, 0.5).collect()
    assert [tuple(r) for r in got] == [(0, "h", 5.0, 0.7)]


def test_all_verdicts_occur(spark):
    got = {r.verdict for r in decisions.gated(spark, "/root/testdata/sf0.01").select("verdict").distinct().collect()}
    assert got == {"PARTIAL", "NO_BET", "HOLD", "SPECULATIVE", "ACTIONABLE", "HIGH_CONVICTION"}
