import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import learning as lr
from touchline.operators import neighbours as nb
from touchline.operators import search


def test_keyed_draws_do_not_depend_on_partitions(spark):
    a = spark.range(500).select("id", lr.uniform(1, "id").alias("u"), lr.normal(2, "id").alias("z"))
    b = spark.range(500).repartition(7).select("id", lr.uniform(1, "id").alias("u"), lr.normal(2, "id").alias("z"))
    assert sorted(a.collect()) == sorted(b.collect())
    m = a.agg(F.avg("u"), F.avg("z"), F.stddev_pop("z")).first()
    assert abs(m[0] - 0.5) < 0.05 and abs(m[1]) < 0.15 and abs(m[2] - 1) < 0.15


def test_isotonic_is_monotone(spark):
    rows = spark.range(600).select("id", (F.col("id") % 3).cast("double").alias("label"), ((F.col("id") % 3) + lr.normal(5, "id") * 0.2).alias("x"))
    iso = lr.isotonic(rows.select("id", "x", (F.col("label") > 0).cast("int").alias("y")), "x", "y", "cal").orderBy("x").collect()
    assert all(a["cal"] <= b["cal"] + 1e-12 for a, b in zip(iso, iso[1:]))


def test_simulation_mixup_perturb(spark):
    p = spark.createDataFrame([(1, 0.5, 0.3, 0.2), (2, 1.0, 0.0, 0.0)], "id long, a double, b double, c double")
    sim = {r["id"]: r for r in lr.simulated(p, "id", ["a", "b", "c"], 2000).collect()}
    assert sim[2]["sim_a"] == 1 and abs(sim[1]["sim_b"] - 0.3) < 0.05
    x = spark.range(100).select("id", F.col("id").cast("double").alias("x"))
    assert lr.mixup(x, "id", ["x"]).where("x < 0 OR x > 99").count() == 0
    draws = [r["b"] for r in spark.range(4000).select(lr.beta(3, "id", 0.2).alias("b")).collect()]
    assert 0 <= min(draws) and max(draws) <= 1 and abs(sum(draws) / 4000 - 0.5) < 0.03
    assert abs(sum((b - 0.5) ** 2 for b in draws) / 4000 - 0.25 / 1.4) < 0.01
    assert lr.perturbed(x, "id", ["x"]).count() == 100


def plain_nearest(rows, k):
    out = {}
    for i, v in rows:
        near = sorted((math.dist(v, w), j) for j, w in rows if j != i)[:k]
        out[i] = [(j, d) for d, j in near]
    return out


@pytest.mark.parametrize("dims,copies", [(2, 0), (6, 0), (3, 40)])
def test_nearest_equal_all_pairs(spark, monkeypatch, dims, copies):
    """Several cells, blocks and parts; rows alone in their cell; a group of equal vectors larger than a block."""
    monkeypatch.setattr(nb, "ROWS_A_PIVOT", 20)
    monkeypatch.setattr(nb, "BLOCK", 16)
    monkeypatch.setattr(nb, "PART", 64)
    monkeypatch.setattr(nb, "HELD", 200)
    rnd = random.Random(dims)
    rows = [(i, [rnd.gauss(rnd.choice((0, 5)), 1) for _ in range(dims)]) for i in range(180)] + [(500 + i, [1.0] * dims) for i in range(copies)] + [(900, [1e3] * dims), (901, [-1e3] * dims)]
    df = spark.createDataFrame([*rows, (902, None)], "id long, v array<double>").repartition(3)
    got = {}
    for r in nb.nearest(df, "id", "v").orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append((r["near_id"], r["d"]))
    want = plain_nearest(rows, 5)
    assert got.keys() == want.keys()
    for i in want:
        assert [j for j, _ in got[i]] == [j for j, _ in want[i]] and [d for _, d in got[i]] == pytest.approx([d for _, d in want[i]])
    made = {r["id"]: r["v"] for r in nb.smote(df, "id", "v").collect()}
    assert made.keys() == want.keys()  # nobody is lost for being alone
    by_id = dict(rows)
    for i, v in made.items():
        assert any(math.dist(by_id[i], v) + math.dist(v, by_id[j]) == pytest.approx(math.dist(by_id[i], by_id[j]), abs=1e-9) for j, _ in want[i])


def test_nearest_edges(spark):
    one = spark.createDataFrame([(7, [1.0, 2.0])], "id long, v array<double>")
    assert nb.nearest(one, "id", "v").count() == 0 and nb.smote(one, "id", "v").collect() == [(7, [1.0, 2.0])]
    assert nb.nearest(one.limit(0), "id", "v").count() == 0 and nb.smote(one.limit(0), "id", "v").count() == 0


def test_dirichlet_draws_have_the_right_moments(spark):
    """Over many rows of one concentration, also below one; repeatable by key whatever the partitions."""
    for alpha in ((9.0, 5.0, 6.0), (0.4, 0.3, 2.0), (1.0, 1.0, 1.0)):
        df = spark.range(60).select("id", *[F.lit(a).alias(f"a{i}") for i, a in enumerate(alpha)])
        draw = lambda d: sorted((r["id"], r["i"]) for r in d.select("id", lr.dirichlet_intervals(F.xxhash64("id"), F.col("a0"), F.col("a1"), F.col("a2")).alias("i")).collect())
        one = draw(df)
        assert one == draw(df.repartition(7)) and one[0][1] != one[1][1]
        total, n = sum(alpha), 60 * lr.SAMPLES
        for k, a in enumerate(alpha):
            mean, var = a / total, a * (total - a) / (total**2 * (total + 1))
            assert abs(sum(i["mean"][k] for _, i in one) / 60 - mean) < 3.5 * math.sqrt(var / n)
            assert sum(i["variance"][k] for _, i in one) / 60 == pytest.approx(var, rel=0.12)
            assert all(0 <= i["ci_lower"][k] <= i["mean"][k] <= i["ci_upper"][k] <= 1 for _, i in one)


def plain_gamma(key, place, shape):
    """One draw by the scalar rule, from the same counters."""
    def number(t, part):
        x = (key + place * 4 * lr.GAMMA_TRIES + 4 * t + part + 1) * 0x9E3779B97F4A7C15 % 2**64
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return ((x ^ x >> 31) >> 11) / 2**53 + 2.0**-54

    d = (shape + 1 if shape < 1 else shape) - 1 / 3
    out = d
    for t in range(lr.GAMMA_TRIES):
        z = math.sqrt(-2 * math.log(number(t, 0))) * math.cos(2 * math.pi * number(t, 1))
        v = (1 + z / math.sqrt(9 * d)) ** 3
        if v > 0 and math.log(number(t, 2)) < 0.5 * z * z + d - d * v + d * math.log(v):
            out = d * v
            break
    return max(out * number(0, 3) ** (1 / max(shape, 1e-9)) if shape < 1 else out, 1e-300)


@pytest.mark.parametrize("block,call,tries", [(130, 400, 12), (19_200, 307_200, 12), (130, 400, 1)])
def test_intervals_equal_plain_draws(spark, monkeypatch, block, call, tries):
    """Blocks and calls that end within the rows, shapes below one, draws that no try gave, a row without numbers."""
    monkeypatch.setattr(lr, "BLOCK_DRAWS", block)
    monkeypatch.setattr(lr, "CALL_DRAWS", call)
    monkeypatch.setattr(lr, "GAMMA_TRIES", tries)
    rnd, samples = random.Random(4), 20
    rows = [(rnd.getrandbits(64), [rnd.choice((0.02, 0.4, 1.0, 3.5, 30.0)) for _ in range(3)]) for _ in range(23)]
    drawn = lr.gamma_draws(np.array([k for k, _ in rows], np.uint64), np.array([a for _, a in rows]), samples)
    want = np.array([[[plain_gamma(k, s * 3 + c, a[c]) for s in range(samples)] for c in range(3)] for k, a in rows])
    assert drawn.shape == (23, 3, samples) and np.allclose(drawn, want, rtol=1e-9, atol=0)
    bounds = np.quantile(want / want.sum(axis=1, keepdims=True), (0.025, 0.975), axis=2)
    if tries == 12:  # the workers have the module's own number of tries
        signed = lambda k: k - 2**64 if k >= 2**63 else k
        df = spark.createDataFrame([(i, signed(k), *a) for i, (k, a) in enumerate(rows)] + [(99, 1, None, 1.0, 1.0)], "id int, k long, a double, b double, c double").repartition(3)
        found = df.select("id", lr.dirichlet_intervals(F.col("k"), F.col("a"), F.col("b"), F.col("c"), samples=samples, moments=False).alias("i"))
        assert found.schema["i"].dataType.names == ["ci_lower", "ci_upper"]
        got = {r["id"]: r["i"] for r in found.collect()}
        assert all(math.isnan(x) for side in got.pop(99) for x in side)
        assert len(got) == 23 and all(np.allclose([got[i]["ci_lower"], got[i]["ci_upper"]], bounds[:, i], rtol=1e-9, atol=1e-12) for i in got)
        assert df.limit(0).select(lr.dirichlet_intervals(F.col("k"), F.col("a"), F.col("b"), F.col("c")).alias("i")).count() == 0


def test_sampled_weights_beat_the_grid(spark):
    """Four members of different worth; the score from the sums is the one over the rows, the search repeats by seed."""
    y = [(F.col("id") % 3 == k).cast("double") for k in range(3)]
    noise = (0.1, 0.25, 0.2, 0.6)
    raw = [[y[k] * (1 - noise[m]) + lr.uniform(100 * m + k, "id") * noise[m] + 0.05 for k in range(3)] for m in range(4)]
    member = [[(raw[m][k] / (raw[m][0] + raw[m][1] + raw[m][2])).alias(f"m{m}{k}") for k in range(3)] for m in range(4)]
    df = spark.range(900).select(*[c.alias(f"y{k}") for k, c in enumerate(y)], *[c for m in member for c in m])
    names = [[f"m{m}{k}" for k in range(3)] for m in range(4)]
    sums = search.gathered(df, names, ["y0", "y1", "y2"])
    w, score, tried = search.searched(sums)
    assert score == pytest.approx(df.agg(F.avg(sum((F.pow(sum((F.lit(float(w[m])) * F.col(names[m][k]) for m in range(4)), F.lit(0.0)) - F.col(f"y{k}"), 2) for k in range(3)), F.lit(0.0)))).first()[0])
    assert search.searched(sums)[0].tolist() == w.tolist() and len(tried) == 100 and score == min(tried)
    grid = [search.whole([a + (b - a) * i / 20 for (a, b), i in zip(search.RANGES, (i, i, i))]) for i in range(21)]
    assert score <= min(sums.brier(g) for g in grid if g is not None) and abs(w.sum() - 1) < 1e-12
    assert min(tried[search.STARTUP :]) < min(tried[: search.STARTUP])
