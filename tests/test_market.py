import pytest
from pyspark.sql import functions as F

from touchline.functions import market as mk
from touchline.functions import text as tx


def row(spark, *columns, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} double" for k in values))
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_bad_prices_give_nulls_not_numbers(spark):
    for bad in (None, float("nan"), float("inf"), 1.0, 0.9, -2.0):
        r = row(spark, mk.priced(F.col("a")), mk.margin(F.col("a")), *mk.proportional(F.col("a"), F.col("b")), mk.kelly(F.lit(0.5), F.col("a")), a=bad, b=2.0)
        assert r[0] is False and r[1] == 0 and r[2] is None and r[3] is None and r[4] == 0


def power(spark, *odds):
    df = spark.createDataFrame([odds], "a double, b double, c double")
    return list(mk.power(df, ["a", "b", "c"], ["p", "q", "r"]).select("p", "q", "r").first())


def bisected(odds):
    low, high = 0.1, 10.0
    for _ in range(200):
        t = (low + high) / 2
        low, high = (t, high) if sum((1 / o) ** t for o in odds) > 1 else (low, t)
    raw = [(1 / o) ** t for o in odds]
    return [x / sum(raw) for x in raw]


def test_power_and_proportional_differ_on_a_big_favourite(spark):
    p = power(spark, 1.05, 15.0, 40.0)
    q = row(spark, *mk.proportional(*[F.col(k) for k in "abc"]), a=1.05, b=15.0, c=40.0)
    assert sum(p) == pytest.approx(1) and sum(q) == pytest.approx(1) and p[0] > q[0] + 0.005


@pytest.mark.parametrize("odds", [(2.0, 4.0, 4.0), (1.05, 15.0, 40.0), (1.01, 1.01, 1.01), (1.5, 1.5, 1.5), (9.0, 9.0, 9.0), (3.0, 8.0, 12.0), (1.2, 2.5, 1.3), (1.001, 900.0, 900.0)])
def test_power_equals_bisection(spark, odds):
    """Fair, over and under round, and where the exponent meets its bounds."""
    assert power(spark, *odds) == pytest.approx(bisected(odds), abs=1e-6)


def test_kelly_ev_wilson_entropy(spark):
    r = row(spark, mk.kelly(F.col("p"), F.col("o")), mk.kelly(F.col("p"), F.col("o"), 0.25, 0.05), mk.ev(F.col("p"), F.col("o")), *mk.wilson(F.lit(5.0), F.lit(10.0)), mk.entropy(F.lit(0.5), F.lit(0.5), F.lit(0.0)), p=0.6, o=2.0)
    assert r[0] == pytest.approx(0.2) and r[1] == pytest.approx(0.05) and r[2] == pytest.approx(0.2)
    assert r[3] == pytest.approx(0.2366, abs=1e-3) and r[4] == pytest.approx(0.7634, abs=1e-3) and r[5] == pytest.approx(0.6931, abs=1e-3)


def test_names_and_secrets(spark):
    df = spark.createDataFrame([("FC Bayern München 1900", "http://x/?token=abc&a=1")], "n string, u string")
    r = df.select(tx.normalised(F.col("n")), tx.club_key(F.col("n")), tx.redacted(F.col("u"))).first()
    assert list(r) == ["fc bayern munchen 1900", "fcbayernmnchen1900", "http://x/?token=***&a=1"]
