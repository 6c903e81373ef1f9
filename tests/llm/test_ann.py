import numpy as np
import pandas as pd
import pytest

from touchline.llm import ann as m

SCHEMA = "vec_id long, embedding array<float>, part int"


def vectors(n=3000, d=24, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + 2 * rng.normal(size=(12, d))[rng.integers(0, 12, n)]
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, x, extra=()):
    return spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)] + list(extra), SCHEMA)


def exact(x, ids, q, k):
    s = (x.astype(float) * x[q].astype(float)).sum(axis=1)
    order = sorted((j for j in range(len(x)) if ids[j] != ids[q]), key=lambda j: (-s[j], ids[j]))
    return [(ids[j], s[j]) for j in order[:k]]


def test_recall_and_scores(spark):
    x = vectors()
    df = frame(spark, x)
    got = m.top_k(df, df.where("vec_id % 20 = 0")).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(by) == list(range(0, 3000, 20)) and all(sorted(v) == list(range(1, 21)) for v in by.values())
    hits = 0
    for q, found in by.items():
        truth = exact(x, list(range(len(x))), q, 20)
        hits += len({i for i, _ in truth} & {i for i, _ in found.values()})
        for i, s in found.values():
            assert s == pytest.approx(float(x[q].astype(float) @ x[i].astype(float)), abs=1e-12) and i != q
        assert [found[k] for k in range(1, 21)] == sorted(found.values(), key=lambda f: (-f[1], f[0]))
    assert hits / (20 * len(by)) >= 0.9
    truth = m.brute_force(df, [0, 20])
    assert truth[20] == [i for i, _ in exact(x, list(range(len(x))), 20, 20)]


def test_parts_are_balanced_and_local():
    x = vectors(1500)
    near = m.neighbour_lists(x.astype(float), 10)
    part = m.balanced_parts(x.astype(float), near, 8)
    size = np.bincount(part, minlength=8)
    assert size.max() <= np.ceil(1500 / 8 * 1.1)
    assert (part[near] == part[:, None]).mean() > 3 / 8


def test_ties_hot_part_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 64)
    x = vectors(900)
    x[200:600] = x[200]  # equal vectors, far more than a block
    df = frame(spark, x)
    got = {}
    for r in m.top_k(df, df.where("vec_id in (200, 360)"), probes=16).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q in (200, 360):
        assert [i for i, _ in got[q]] == [i for i in range(200, 222) if i != q][:20]
        assert len({s for _, s in got[q]}) == 1


def test_bad_vectors_few_rows_and_none(spark):
    bad = [(100, None, 0), (101, [], 0), (102, [0.0] * 3, 0), (103, [1.0, float("nan"), 0.0], 0), (104, [1.0, None, 2.0], 0), (105, [float("inf"), 0.0, 1.0], 0), (106, [1.0, 2.0], 0), (None, [1.0, 0.0, 0.0], 0)]
    few = [(i, [1.0, float(i), 0.5], 0) for i in range(5)]
    df = spark.createDataFrame(few + bad + [few[2]], SCHEMA)
    got = m.top_k(df, df.where("vec_id in (0, 2, 102)")).collect()
    assert {r["query_id"] for r in got} == {0, 2}
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 2] == [4, 3, 1, 0]
    assert m.top_k(df.where("vec_id > 99"), df).count() in (0, 1)
    assert m.top_k(df.limit(0), df.limit(0)).count() == 0


def test_repeated_rows_leave_room_for_k(spark):
    x = vectors(90)
    df = frame(spark, x)
    got = {}
    for r in m.top_k(df.unionByName(df).unionByName(df), df.where("vec_id in (0, 20)"), probes=99).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: [i for i, _ in exact(x, list(range(90)), q, 20)] for q in (0, 20)}


def test_a_query_short_of_k_visits_all_parts(spark):
    x = vectors(300, 8, 3)
    x[:, 0] = np.abs(x[:, 0]) + 1
    far = [-1.0] + [0.0] * 7
    df = frame(spark, x, [(1000, far, 0)] * 300)  # its part holds hardly more than its own repeats
    model = spark.sparkContext.broadcast(m.fit(df, 4))
    asks = df.where("vec_id in (7, 1000)")
    assert m.search(m.routed(m.valid(df), model, 1), m.routed(m.valid(asks).dropDuplicates(["vec_id"]), model, 1), 4, 5).where("query_id = 1000").count() < 5
    got = {}
    for r in m.top_k(df, asks, k=5, parts=4, probes=1).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    s = x.astype(float) @ np.array(far)
    assert got[1000] == sorted(range(300), key=lambda j: (-s[j], j))[:5] and len(got[7]) == 5


@pytest.mark.parametrize(("n", "d", "centres"), [(20_000, 24, 60), (100_000, 16, 200)])
def test_recall_while_visiting_under_a_third(spark, n, d, centres):
    """Clustered vectors, tables in which queries visit few parts."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, d)) + 2.5 * rng.normal(size=(centres, d))[rng.integers(0, centres, n)]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x)}), "vec_id long, embedding array<float>").repartition(8).cache()
    step = n // 200
    model = m.fit(df)
    parts, probes = model["w2"].shape[1], int(model["probes"])
    assert parts == m.parts_for(n) and probes < parts
    asks = df.where(f"vec_id % {step} = 0")
    got = m.top_k(df, asks).toPandas()
    q = np.arange(0, n, step)
    s = x[q].astype(float) @ x.T.astype(float)
    s[np.arange(len(q)), q] = -np.inf
    truth = np.argsort(-s, axis=1, kind="stable")[:, :20]
    by = got.groupby("query_id")["vec_id"].apply(set)
    assert np.mean([len(by[i] & set(row.tolist())) / 20 for i, row in zip(q.tolist(), truth)]) >= 0.9
    home = m.probabilities(model, x.astype(float)).argmax(axis=1)
    size = np.bincount(home, minlength=parts)
    order = np.argsort(-m.probabilities(model, x[q].astype(float)), axis=1)[:, :probes]
    assert size[order].sum(axis=1).mean() < n / 3
    df.unpersist()
