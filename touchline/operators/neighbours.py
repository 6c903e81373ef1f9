"""Exact nearest neighbours by metric partitions, and what is built on them: synthetic rows between neighbours of a class.

Rows go to the cell of their nearest pivot (at most MOST_PIVOTS sampled rows), cells to blocks of about BLOCK rows. A row's own block gives an upper
bound r of its k-th distance. By the triangle inequality a cell whose pivot is further than r plus the cell's radius holds none of its k nearest, so
the row meets the blocks of the other cells only. Rows and blocks meet by an equi-join on (cell, block, part of the rows), so no group grows with the
table; each meeting keeps k candidates a row. Results are exact: what is skipped can't matter. Where distances differ little, as in many dimensions,
little is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.learning import uniform
from touchline.sources.scratch import scratch

MOST_PIVOTS, ROWS_A_PIVOT, BLOCK, PART = 256, 400, 2048, 8192
#: Differences that are held at a time.
HELD = 2_000_000
NEAR = "id long, near_id long, d double"


def vectors(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances, from differences (no cancelling)."""
    out = np.empty((len(x), len(y)))
    step = max(1, HELD // max(1, y.size))
    for at in range(0, len(x), step):
        out[at : at + step] = np.sqrt(((x[at : at + step, None, :] - y[None, :, :]) ** 2).sum(axis=2))
    return out


def k_best(ids: np.ndarray, x: np.ndarray, other_ids: np.ndarray, y: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest others of each row; ties to the smaller id."""
    parts = []
    step = max(1, HELD // max(1, len(y)))
    for at in range(0, len(x), step):
        d = distances(x[at : at + step], y)
        d[ids[at : at + step, None] == other_ids[None, :]] = np.inf
        order = np.lexsort((np.broadcast_to(other_ids, d.shape), d), axis=1)[:, :k]
        best = np.take_along_axis(d, order, axis=1)
        row, place = np.nonzero(np.isfinite(best))
        parts.append(pd.DataFrame({"id": ids[at : at + step][row], "near_id": other_ids[order[row, place]], "d": best[row, place]}))
    return pd.concat(parts) if parts else pd.DataFrame({"id": [], "near_id": [], "d": []})


def _kept(df: DataFrame, label: str) -> DataFrame:
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nearest(rows: DataFrame, key: str, vector: str, k: int = 5, seed: int = 11) -> DataFrame:
    """id, near_id, d, place (from 1): the k nearest other rows of each row (all others, if fewer). Keys are whole numbers and
    different; null vectors take no part."""
    spark = rows.sparkSession
    rows = _kept(rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")), "vectors")
    n = rows.count()
    sampled = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(min(MOST_PIVOTS, max(1, n // ROWS_A_PIVOT))).collect()
    if not sampled:
        return spark.createDataFrame([], f"{NEAR}, place int")
    pivots = np.array([r["v"] for r in sampled])

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            d = distances(vectors(f["v"]), pivots)
            yield f.assign(cell=d.argmin(axis=1), far=d.min(axis=1))

    dealt = rows.mapInPandas(assign, "id long, v array<double>, cell int, far double")
    dealt = _kept(dealt, "cells")
    # a row for each pivot
    cells = {r["cell"]: (r["radius"], -(-r["n"] // BLOCK)) for r in dealt.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).collect()}
    blocks_of = F.element_at(F.array(*[F.lit(cells.get(c, (0, 1))[1]) for c in range(len(pivots))]), F.col("cell") + 1)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), blocks_of).cast("int"))

    def own(frame: pd.DataFrame) -> pd.DataFrame:
        ids, x = frame["id"].to_numpy(), vectors(frame["v"])
        best = k_best(ids, x, ids, x, k).groupby("id")["d"].agg(["size", "max"])
        bound = best["max"].where(best["size"] >= k, np.inf).reindex(ids, fill_value=np.inf)
        return frame.assign(r=bound.to_numpy())[["id", "v", "r"]]

    bounded = dealt.groupBy("cell", "block").applyInPandas(own, "id long, v array<double>, r double")
    listed = sorted(cells)
    radii, counts = np.array([cells[c][0] for c in listed]), [cells[c][1] for c in listed]

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            d = distances(vectors(f["v"]), pivots[listed])
            asked = d - radii <= (f["r"].to_numpy() * (1 + 1e-9) + 1e-9)[:, None]
            yield pd.DataFrame({"id": f["id"], "v": f["v"], "to": [[(listed[c], b) for c in np.flatnonzero(a) for b in range(counts[c])] for a in asked]})

    parts = max(1, -(-n // PART))
    routed = bounded.mapInPandas(route, "id long, v array<double>, to array<struct<cell:int,block:int>>")
    routed = routed.select("id", "v", F.explode("to").alias("t"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")).select("id", "v", "t.*", "part")
    members = dealt.select("id", "v", "cell", "block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def meet(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "near_id": [], "d": []})
        return k_best(left["id"].to_numpy(), vectors(left["v"]), right["id"].to_numpy(), vectors(right["v"]), k)

    on = ["cell", "block", "part"]
    met = routed.groupBy(*on).cogroup(members.groupBy(*on)).applyInPandas(meet, NEAR)
    place = F.row_number().over(Window.partitionBy("id").orderBy("d", "near_id"))
    return met.withColumn("place", place).where(F.col("place") <= k)


def smote(rows: DataFrame, key: str, vector: str, k: int = 5, seed: int = 11) -> DataFrame:
    """key, vector: a synthetic row for each row of a class, a keyed part of the way to a keyed one of its k nearest. A row without others is
    its own neighbour."""
    near = nearest(rows, key, vector, k, seed).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "near_id"))).alias("near"))  # k a row
    base = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    to = F.element_at("near", (F.floor(uniform(seed, "id") * F.size("near")) + 1).cast("int"))["near_id"]
    picked = base.join(near, "id", "left").select("id", "v", F.coalesce(to, "id").alias("near_id"))
    both = picked.join(base.select(F.col("id").alias("near_id"), F.col("v").alias("o")), "near_id").withColumn("step", uniform(seed + 1, "id"))
    return both.select(F.col("id").alias(key), F.zip_with("v", "o", lambda x, y: x + F.col("step") * (y - x)).alias(vector))
