"""Approximate nearest neighbours by learned partitions.

Fit, on a bounded sample (the rows with the smallest hash of vec_id, SAMPLE_A_PART a part, at most
SAMPLE): a k-nearest-neighbour graph of the sample is cut into parts of equal size with few
edges between them (seeded growth, then passes that move vertices to the part of most of
their neighbours as long as the balance allows). A small classifier, a network with one
hidden layer, then learns a vector's distribution over the parts, from where its neighbours
lie. The number of parts grows with the square root of the number of rows, up to what the
sample carries (``parts_for``).

Index: every row, sampled or not, goes to its most probable part; the index is written once.
Search: a query visits the ``probes`` parts that the classifier finds most probable and is
compared exactly, in double precision, with every row there; ties go to the smaller vec_id.
``probes`` is the fewest parts with which held-out rows reach TARGET, the aimed recall: of two
held-out vectors, the chance that one lies in a part that the other visits, taken over those
neighbours that are as near as the k-th of the whole table (its rank shrinks with the sample).
A query that finds fewer than k others then visits all parts. tests/llm/test_ann.py
measures recall against brute force.

A part may hold a third of all rows (equal vectors lie together): rows and queries of a part
are dealt to blocks of about BLOCK, every block of queries meets every block of rows, and the
blocks' best are merged. No task holds more than two blocks.

Defined results: vectors that are null, zero, of another length than most of the sample or
with null or non-finite components take no part; inner products beyond the range of a double are
no candidates; repeated rows (same vec_id) are candidates for others,
not for each other; without valid rows there are none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import written

SAMPLE, SAMPLE_A_PART, NEIGHBOURS, HIDDEN, BLOCK = 16_000, 100, 15, 128, 4096
#: Rows held out for choosing the probes, as a share of the sample.
HELD = 0.5
TARGET, K = 0.93, 20
TIE = 1e-9


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long"), v.alias("v"))


def neighbour_lists(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row by inner product."""
    out = []
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        out.append(np.argpartition(-s, min(k, s.shape[1] - 1) - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, passes: int = 20, slack: float = 1.1) -> np.ndarray:
    """Parts of at most slack x average size that cut few edges of the neighbour graph."""
    n = len(x)
    rng = np.random.default_rng(5)
    most = int(np.ceil(n / parts * slack))
    # growth: the best placed vertices choose first, a full part turns others away
    centres = x[rng.choice(n, parts, replace=False)]
    part = np.zeros(n, np.int64)
    for _ in range(12):
        part = _assigned(x @ centres.T, most)
        centres = np.stack([x[part == p].mean(axis=0) if (part == p).any() else x[rng.integers(n)] for p in range(parts)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    rows = np.concatenate((np.repeat(np.arange(n), near.shape[1]), near.ravel()))
    cols = np.concatenate((near.ravel(), np.repeat(np.arange(n), near.shape[1])))
    for _ in range(passes):
        votes = np.bincount(rows * parts + part[cols], minlength=n * parts).reshape(n, parts)
        gain = votes.max(axis=1) - votes[np.arange(n), part]
        # a random half moves at a time, so that neighbours don't swap places for ever
        new = _assigned(votes + 1e-3 * (np.arange(parts) == part[:, None]), most)
        move = (gain > 0) & (rng.random(n) < 0.5)
        trial = np.where(move, new, part)
        size = np.bincount(trial, minlength=parts)
        if (size > most).any():
            continue
        if not (trial != part).any():
            break
        part = trial
    return part


def _assigned(liking: np.ndarray, most: int) -> np.ndarray:
    """Each row to the part that it likes best and that isn't full; strong preferences first."""
    n, parts = liking.shape
    order = np.argsort(-liking, axis=1, kind="stable")
    part, size = np.full(n, -1), np.zeros(parts, np.int64)
    todo = np.arange(n)
    for rank in range(parts):
        want = order[todo, rank]
        strength = liking[todo, want]
        rest = []
        for p in range(parts):
            mine = todo[want == p]
            mine = mine[np.argsort(-strength[want == p], kind="stable")]
            room = max(0, most - size[p])
            part[mine[:room]] = p
            size[p] += len(mine[:room])
            rest.append(mine[room:])
        todo = np.sort(np.concatenate(rest))
        if not len(todo):
            break
    return part


def train(x: np.ndarray, target: np.ndarray, hidden: int = HIDDEN, epochs: int = 40) -> dict[str, np.ndarray]:
    """A one-hidden-layer network for target distributions over parts (Adam, seeded)."""
    rng = np.random.default_rng(6)
    d, parts = x.shape[1], target.shape[1]
    scale = float(np.sqrt((x * x).sum(axis=1).mean() / d)) or 1.0
    w = {"w1": rng.normal(0, np.sqrt(2 / d), (d, hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), "b2": np.zeros(parts), "scale": np.array(scale)}
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v = {k: np.zeros_like(u) for k, u in w.items()}
    t = 0
    for epoch in range(epochs):
        for batch in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            t += 1
            a = x[batch] / scale
            h = np.maximum(a @ w["w1"] + w["b1"], 0)
            p = _softmax(h @ w["w2"] + w["b2"])
            out = (p - target[batch]) / len(batch)
            back = (out @ w["w2"].T) * (h > 0)
            for k, g in {"w1": a.T @ back + 1e-5 * w["w1"], "b1": back.sum(axis=0), "w2": h.T @ out, "b2": out.sum(axis=0)}.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - 0.002 * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return w


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(w: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    return _softmax(np.maximum((x / w["scale"]) @ w["w1"] + w["b1"], 0) @ w["w2"] + w["b2"])


def parts_for(rows: int) -> int:
    """A quarter of the square root of the rows, up to what the sample carries."""
    return max(1, min(round(rows**0.5 / 4), SAMPLE // SAMPLE_A_PART))


def fit(vectors: DataFrame, parts: int | None = None, k: int = K, target: float = TARGET) -> dict[str, np.ndarray] | None:
    """The classifier's weights and the probes (None: no valid rows). At most (1 + HELD) x SAMPLE rows reach the driver."""
    rows = valid(vectors)
    n = rows.count()
    parts = parts_for(n) if parts is None else parts
    sample = min(SAMPLE, max(parts * SAMPLE_A_PART, 4000))
    taken = rows.withColumn("h", F.xxhash64("vec_id")).orderBy("h", "vec_id").limit(int(sample * (1 + HELD))).select("v").toPandas()["v"]
    if not len(taken):
        return None
    d = int(taken.map(len).mode().iloc[0])
    x = np.array([v for v in taken if len(v) == d])
    cut = len(x) - int(len(x) * HELD / (1 + HELD))
    x, held = x[:cut], x[cut:]
    near = neighbour_lists(x, min(NEIGHBOURS, max(1, len(x) - 1))) if len(x) > 1 else np.zeros((1, 1), np.int64)
    parts = max(1, min(parts, len(x) // 8))
    part = balanced_parts(x, near, parts)
    # where a vector's neighbours lie, itself included
    to = np.zeros((len(x), parts))
    np.add.at(to, (np.arange(len(x)), part), 1.0)
    np.add.at(to, (np.repeat(np.arange(len(x)), near.shape[1]), part[near.ravel()]), 1.0)
    w = train(x, to / to.sum(axis=1, keepdims=True))
    return w | {"d": np.array(d), "probes": np.array(probes_for(w, held, max(1, round(k * len(held) / n)), target))}


def probes_for(w: dict[str, np.ndarray], held: np.ndarray, k: int, target: float) -> int:
    """The fewest parts with which the k nearest among the held-out rows are met at ``target``, two standard
    errors included; all parts where there are too few rows to tell."""
    parts = w["w2"].shape[1]
    if len(held) <= k:
        return parts
    near = neighbour_lists(held, k)
    p = probabilities(w, held)
    order = np.argsort(-p, axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(parts), order.shape), 1)
    met = np.cumsum(np.bincount(np.take_along_axis(rank, order[:, 0][near], 1).ravel(), minlength=parts)) / near.size
    enough = np.flatnonzero(met - 2 * np.sqrt(met * (1 - met) / near.size) - 1 / near.size >= target)
    return int(enough[0]) + 1 if len(enough) else parts


def routed(rows: DataFrame, model, probes: int) -> DataFrame:
    """vec_id, v, parts: the ``probes`` most probable parts, the best first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = model.value
        for frame in batches:
            frame = frame[frame["v"].map(len) == int(w["d"])]
            if len(frame):
                p = probabilities(w, np.stack(frame["v"].to_numpy()))
                yield frame.assign(parts=list(np.argsort(-p, axis=1, kind="stable")[:, :probes].astype(np.int32)))

    return rows.mapInPandas(run, "vec_id long, v array<double>, parts array<int>")


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score): each query's k best, a query's own id left out. Scores are
    summed anew row by row, so that equal vectors have equal scores wherever they stand."""
    q_out, r_out, s_out = [], [], []
    order = np.argsort(row_ids, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], np.diff(row_ids[order]) != 0))[: len(order)])
    for at in range(0, len(queries), 256):
        q, own = queries[at : at + 256], query_ids[at : at + 256]
        s = q @ rows.T
        s[own[:, None] == row_ids] = -np.inf
        # the k-th best is sought among ids, not rows
        each = s if len(starts) == len(order) else np.maximum.reduceat(s[:, order], starts, axis=1)
        cut = np.partition(each, each.shape[1] - k, axis=1)[:, each.shape[1] - k] if each.shape[1] > k else np.full(len(q), -np.inf)
        room = TIE * np.maximum(1.0, np.abs(np.where(np.isfinite(cut), cut, 0)))
        for i in range(len(q)):
            near = np.flatnonzero((s[i] >= cut[i] - room[i]) & np.isfinite(s[i]))
            exact = (rows[near] * q[i]).sum(axis=1)
            best = np.lexsort((row_ids[near], -exact))
            _, first = np.unique(row_ids[near][best], return_index=True)  # a repeated row is named once
            best = best[np.sort(first)][:k]
            q_out.append(np.full(len(best), own[i]))
            r_out.append(row_ids[near][best])
            s_out.append(exact[best])
    return tuple(np.concatenate(x) if x else np.empty(0) for x in (q_out, r_out, s_out))


def search(index: DataFrame, asks: DataFrame, parts: int, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of the visited parts; index and asks are ``routed`` and written."""
    sizes = lambda df: {r["part"]: r["count"] for r in df.select(F.explode("parts").alias("part")).groupBy("part").count().collect()}  # noqa: E731  a row for each part
    rows_in, asks_in = sizes(index), sizes(asks)
    blocks = [[max(1, -(-n.get(p, 0) // BLOCK)) for p in range(parts)] for n in (rows_in, asks_in)]
    lookup = lambda i: F.element_at(F.array(*map(F.lit, blocks[i])), F.col("part") + 1)
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    rows = index.select("vec_id", "v", F.explode("parts").alias("part")).withColumns({"rb": deal(lookup(0)), "qb": F.explode(F.sequence(F.lit(0), lookup(1) - 1))}).withColumn("query", F.lit(False))
    asks = asks.select("vec_id", "v", F.explode("parts").alias("part")).withColumns({"qb": deal(lookup(1)), "rb": F.explode(F.sequence(F.lit(0), lookup(0) - 1))}).withColumn("query", F.lit(True))

    def compare(table: pa.Table) -> pa.Table:
        v = np.array(table.column("v").combine_chunks().flatten()).reshape(table.num_rows, -1)
        ids, ask = table.column("vec_id").to_numpy(), table.column("query").to_numpy(zero_copy_only=False).astype(bool)
        if ask.all() or not ask.any():
            found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        else:
            found = nearest(v[ask], ids[ask], v[~ask], ids[~ask], k)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    columns = ["part", "rb", "qb", "vec_id", "v", "query"]
    found = rows.select(columns).unionByName(asks.select(columns)).groupBy("part", "rb", "qb").applyInArrow(compare, "query_id long, vec_id long, score double")
    from pyspark.sql import Window

    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, parts: int | None = None, probes: int | None = None, target: float = TARGET) -> DataFrame:
    """Fit, index and search; then the queries that found fewer than k others visit all parts."""
    model = fit(vectors, parts, k, target)
    if model is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # a network whose size the parameters fix
    every = int(model["w2"].shape[1])
    visited = min(every, int(model["probes"]) if probes is None else probes)
    index = written(routed(valid(vectors), shared, 1), "index")
    asks = written(routed(valid(queries).dropDuplicates(["vec_id"]), shared, visited), "asks")
    found = search(index, asks, every, k)
    if visited == every:
        return found
    found = written(found, "nearest")
    enough = found.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = written(asks.join(enough, "vec_id", "left_anti").withColumn("parts", F.sequence(F.lit(0), F.lit(every - 1))), "short")
    if not short.limit(1).count():
        return found
    full = found.join(enough.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").select(found.columns)
    return full.unionByName(search(index, short, every, k))


def brute_force(vectors: DataFrame, ids: list[int], k: int = K) -> dict[int, list[int]]:
    """The true neighbours of a few queries, for measuring recall."""
    rows = valid(vectors).toPandas()
    v, own = np.stack(rows["v"].to_numpy()), rows["vec_id"].to_numpy()
    pick = np.isin(own, ids)
    q, r, _ = nearest(v[pick], own[pick], v, own, k)
    return {int(i): r[q == i].tolist() for i in np.unique(q)}


def op1_learned_partitions(spark, sf_dir):
    from touchline.llm.common import table

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))
