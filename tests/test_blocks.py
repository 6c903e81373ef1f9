"""Steps that must not make pairs: the newest rows of dense dates, vectors in blocks."""

import numpy as np
from pyspark.sql import functions as F

from touchline.operators import matches as ops
from touchline.operators import similarity as sim


def test_newest_before_with_many_rows_a_date(spark):
    rows = spark.range(4000).select((F.col("id") % 2).alias("team"), F.expr("timestamp'2020-01-01' + make_dt_interval(int(pow(id % 40, 2) / 4))").alias("match_date"), F.col("id").alias("match_id"), (F.col("id") % 7).alias("gf"))
    rows = rows.unionByName(rows.limit(1).withColumns({"match_date": F.lit(None).cast("timestamp"), "match_id": F.lit(-1).cast("long")}))
    found = ops.newest_before(rows, ["team"], 20, ["gf"], "five")
    assert "rangeBetween" not in found._jdf.queryExecution().optimizedPlan().toString() and "RangeFrame, -" not in found._jdf.queryExecution().optimizedPlan().toString()
    all_ = [(r["team"], r["match_date"], r["match_id"]) for r in rows.collect()]
    by = {}
    for team, day, match in all_:
        if day is not None:
            by.setdefault((team, day), []).append(match)
    want = {}
    for team, day, match in all_:
        near = [] if day is None else sorted(((d, m) for (t, d), ms in by.items() if t == team and d < day and (day - d).days <= 20 for m in ms), reverse=True)[:5]
        want[match] = [m for _, m in near]
    assert {r["match_id"]: [x["match_id"] for x in r["five"]] for r in found.collect()} == want


def test_scored_blocks_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(sim, "QUERIES", 3)
    monkeypatch.setattr(sim, "ROWS", 50)
    monkeypatch.setattr(sim, "MET", 8)
    v = np.random.default_rng(3).normal(size=(180, 6))
    v[17] = v[20]
    rows = spark.createDataFrame([(i, x.tolist() if i != 33 else None, i % 3) for i, x in enumerate(v)], "id long, v array<double>, label int")
    queries = rows.where("id % 10 = 0")
    cos = (v @ v.T) / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(v, axis=1))
    far = np.linalg.norm(v[:, None] - v, axis=2)
    others = lambda i: [j for j in range(180) if j not in (i, 33)]
    best = {}
    for r in sim.scored(rows, queries, "id", "v", sim.cosines, sim.top(4), "query_id long, vec_id long, s double").collect():
        if r["s"] == r["s"]:
            best.setdefault(r["query_id"], []).append((-round(r["s"], 9), r["vec_id"]))
    assert {q: [j for _, j in sorted(x)[:4]] for q, x in best.items()} == {i: sorted(others(i), key=lambda j: (-round(cos[i, j], 9), j))[:4] for i in range(0, 180, 10)}
    got = {r["query_id"]: r for r in sim.gathered(sim.scored(rows, queries, "id", "v", sim.distances, sim.spread_alike, sim.SPREAD, "label")).collect()}
    for i in range(0, 180, 10):
        d = np.array([far[i, j] for j in others(i) if j % 3 == i % 3])
        assert got[i]["n"] == len(d)
        assert np.allclose([got[i]["nearest"], got[i]["mean"], got[i]["sd"]], [d.min(), d.mean(), d.std()])


def test_tasks_grow_with_the_ledger(spark, monkeypatch):
    from touchline.plans.registry import ORACLE_SQL, QUERIES

    monkeypatch.setattr(ops, "TASK_ROWS", 500)
    for name in ("aud_01_structural", "mkt_27_snapshot_class"):
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert name in ORACLE_SQL and "REPARTITION_BY_NUM" in df._jdf.queryExecution().toString()
    assert ops.tasks(spark.range(6001)) == 13


def test_movement_shuffles_a_row_a_snapshot(spark):
    from touchline.plans.market import moves

    plan = moves(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Aggregate [")  # the outcomes are laid out above the aggregation


def test_gamma_tries_draw_only_for_what_failed(monkeypatch):
    from touchline.operators import learning as lr

    drawn, plain = [], lr.mixed_bits
    monkeypatch.setattr(lr, "mixed_bits", lambda x: drawn.append(x.size) or plain(x))
    lr.gamma_draws(np.arange(64, dtype=np.uint64), np.full((64, 3), 2.5), 100)
    assert sum(drawn) < 1.2 * 3 * 64 * 3 * 100


def test_gamma_draws_stay_in_blocks(monkeypatch):
    from touchline.operators import learning as lr

    drawn, plain = [], lr.mixed_bits
    monkeypatch.setattr(lr, "mixed_bits", lambda x: drawn.append(x.size) or plain(x))
    lr.gamma_draws(np.arange(512, dtype=np.uint64), np.full((512, 3), 2.5), 200)
    assert max(drawn) <= 3 * 19_200 and sum(drawn) < 1.1 * 3 * 512 * 3 * 200
    assert len([x for x in drawn if x < 3 * 19_200]) < 12  # later tries of all blocks together


def test_interval_draws_are_dealt_to_tasks(spark, monkeypatch):
    """One row group of a file is one task; the ids alone go to as many tasks as the rows ask for."""
    from touchline.plans.registry import QUERIES

    monkeypatch.setattr(ops, "TASK_ROWS", 500)
    df = QUERIES["unc_02_intervals"](spark, "/root/testdata/sf0.001")
    counts = sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect())
    assert sum(counts) == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert len(counts) >= sum(counts) // 500 and counts[-1] < 750
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int>" in plan
