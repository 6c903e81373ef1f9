import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import boosting as bo
from touchline.operators import learning as lr

FEATURES = ["a", "b", "c", "d", "e"]


def rows(spark, n, parts=3):
    """Three classes by a, b and their interaction; c to e are noise."""
    x = {f: lr.uniform(10 + i, "id") for i, f in enumerate(FEATURES)}
    z = F.col("a") + F.when(F.col("b") > 0.5, F.col("a")).otherwise(1 - F.col("a")) + 0.4 * lr.uniform(77, "id")
    df = spark.range(n).select("id", *[c.alias(f) for f, c in x.items()])
    return df.withColumn("label", F.when(z < 0.9, 0).when(z < 1.5, 1).otherwise(2)).withColumn("day", F.timestamp_seconds(F.col("id") * 86400)).repartition(parts)


def loss(df, p):
    return df.agg(F.avg(-F.ln(F.greatest(F.element_at(p, F.col("label").cast("int") + 1), F.lit(1e-9))))).first()[0]


@pytest.fixture(scope="module")
def fitted(spark):
    df = rows(spark, 1500)
    edges = bo.edges_of(df, FEATURES, 16)
    table = bo.binned(df.withColumn("block", F.lit(0)), FEATURES, edges)
    return df, edges, table, bo.fit(table, edges, 3, rounds=5, depth=3)[0]


def test_boosting_learns_and_repeats(spark, fitted):
    df, edges, table, model = fitted
    p = bo.predicted(table, [model], "id").join(df, "id")
    assert loss(p, "p") < 0.75 < 1.0 < loss(p.withColumn("p", F.array(*[F.lit(1 / 3)] * 3)), "p")
    other = bo.binned(rows(spark, 1500, 7).withColumn("block", F.lit(0)), FEATURES, edges)
    assert bo.fit(other, edges, 3, rounds=2)[0].trees == model.trees[:2]  # whatever the partitions


def test_values_add_up_and_equal_enumeration(spark, fitted):
    _, _, table, model = fitted
    got = bo.shapley(table.limit(40), model, FEATURES, "id").collect()
    assert len(got) == 120
    for r in got:
        assert r["base"] + sum(r[f] for f in FEATURES) == pytest.approx(r["margin"], abs=1e-9)
    bins = np.random.default_rng(1).integers(0, 16, (50, 5))
    for tree in model.trees[0]:
        values, expected = bo.tree_shapley(tree, bins)
        assert values == pytest.approx(bo.enumerated(tree, bins), abs=1e-12)
        assert expected + values.sum(axis=1) == pytest.approx(tree.predict(bins), abs=1e-12)
    top = {r["feature"] for r in bo.importance(bo.shapley(table, model, FEATURES, "id"), FEATURES).orderBy(F.desc("importance")).limit(4).collect()}
    assert top == {"a", "b"}


def test_stacking_uses_earlier_blocks_only_and_beats_the_forest(spark):
    df = rows(spark, 1800)
    train, test = df.where("id < 1400"), df.where("id >= 1400")
    p, told = bo.stacked(train, test, FEATURES, "label", "id", "day", folds=2, rounds=6)
    judged = p.join(test.select("id", "label"), "id")
    assert judged.count() == 400 and loss(judged, "p") < loss(judged, "forest")
    # what came later doesn't change an earlier block's members
    first = told.where("block = 1").agg(F.max("id")).first()[0]
    cut = train.withColumn("label", F.when(F.col("id") > first, 2 - F.col("label")).otherwise(F.col("label")))
    again = bo.stacked(cut, test, FEATURES, "label", "id", "day", folds=2, rounds=6)[1]
    one = {r["id"]: (r["boosted"], r["linear"]) for r in told.where("block = 1").collect()}
    two = {r["id"]: (r["boosted"], r["linear"]) for r in again.where("block = 1").collect()}
    assert one.keys() == two.keys() and all(np.allclose(one[i][0], two[i][0]) and np.allclose(one[i][1], two[i][1], atol=1e-6) for i in one)
