"""A stated set of query vectors against all vectors, in blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries of a block, and rows of a block.
QUERIES, ROWS = 256, 16_384
#: Queries that meet a block of rows in one task of ``scored``; it multiplies QUERIES of them at a time.
MET = 8192


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str, b: str) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))


def query_pairs(rows: DataFrame, queries: DataFrame, key: str, vector: str) -> DataFrame:
    """Each query (``query_id``, ``q``) beside each other row. Both sides are dealt to blocks and meet by an
    equi-join on the pair of blocks, so that neither side is broadcast, however many queries there are."""
    sizes = rows.agg(F.count("*").alias("n")).first()["n"], queries.agg(F.count("*").alias("n")).first()["n"]
    r, q = max(1, -(-sizes[0] // ROWS)), max(1, -(-sizes[1] // QUERIES))
    deal = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("_rb", deal(r)).select("*", every(q).alias("_qb"))
    right = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("q"), deal(q).alias("_qb")).select("*", every(r).alias("_rb"))
    return left.join(right, ["_rb", "_qb"]).where(F.col(key) != F.col("query_id")).drop("_rb", "_qb")


def matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors as rows of doubles; null ones, and ones that hold nulls or have another length, are NaN."""
    flat = pa.chunked_array(vectors).combine_chunks() if isinstance(vectors, list) else vectors.combine_chunks()
    flat = flat.cast(pa.list_(pa.float64()))
    whole = np.asarray(flat.is_valid()) & (np.asarray(flat.value_lengths().fill_null(-1)) == width)
    out = np.full((len(flat), width), np.nan)
    if whole.any():
        out[whole] = flat.filter(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine of each row of q with each of v; NaN where a vector has no direction."""
    with np.errstate(invalid="ignore", divide="ignore"):
        unit = lambda m: m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
        return unit(q) @ unit(v).T


def distances(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    squares = np.einsum("ij,ij->i", q, q)[:, None] + np.einsum("ij,ij->i", v, v) - 2 * (q @ v.T)
    return np.sqrt(np.maximum(squares, 0))


def scored(rows: DataFrame, queries: DataFrame, key: str, vector: str, measure: Callable, part: Callable, schema: str, label: str | None = None) -> DataFrame:
    """What ``part`` makes of each block of queries and each block of rows: it gets the query ids, the row ids, ``measure`` of every pair (NaN for
    the query's own row) and the labels of both sides, and gives columns of ``schema``, to be put together by an aggregation. Blocks meet as in
    ``query_pairs``; the few queries are what is copied to the row blocks, and a task multiplies QUERIES of them with ROWS rows at a time."""
    sizes = rows.agg(F.count("*").alias("n")).first()["n"], queries.agg(F.count("*").alias("n")).first()["n"]
    r, q = max(1, -(-sizes[0] // ROWS)), max(1, -(-sizes[1] // MET))
    deal = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    label_ = F.lit(None).cast("long") if label is None else F.col(label).cast("long")
    own = [F.col(key).alias("id"), F.col(vector).alias("v"), label_.alias("label")]
    left = queries.select(*own, deal(q).alias("_qb"), every(r).alias("_rb"))
    right = rows.select(*own, deal(r).alias("_rb"), every(q).alias("_qb"))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[] for _ in names]
        if left.num_rows and right.num_rows:
            first = next((x for x in left["v"].to_pylist() if x is not None), None)
            a, b = (matrix(t["v"], len(first or ())) for t in (left, right))
            (ids, labels), (others, marks) = ((t["id"].to_numpy(), t["label"].to_pandas().to_numpy(float)) for t in (left, right))
            for at in range(0, len(ids), QUERIES):
                s = measure(a[at : at + QUERIES], b)
                s[ids[at : at + QUERIES, None] == others] = np.nan
                for held, x in zip(out, part(ids[at : at + QUERIES], others, s, labels[at : at + QUERIES], marks)):
                    held.append(x)
        return pa.table([np.concatenate(x) if x else np.empty(0) for x in out], names=names).cast(pa.schema(kinds))

    kinds = [pa.field(n, {"long": pa.int64(), "double": pa.float64()}[x.split()[1]]) for n, x in zip(names, schema.split(", "))]
    return left.groupBy("_rb", "_qb").cogroup(right.groupBy("_rb", "_qb")).applyInArrow(run, schema)


def top(k: int) -> Callable:
    """A ``part``: query_id, vec_id and score of the k best of a block by the score to nine digits, ties to smaller ids."""

    def run(ids: np.ndarray, others: np.ndarray, s: np.ndarray, *_: np.ndarray) -> tuple:
        key = np.where(np.isnan(s), -np.inf, np.round(s, 9))
        floor = np.partition(key, -k, axis=1)[:, -k, None] if key.shape[1] > k else np.full((len(ids), 1), -np.inf)
        i, j = np.nonzero((key >= floor) & (ids[:, None] != others))
        order = np.lexsort((others[j], -key[i, j], i))
        i, j = i[order], j[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        return ids[i[place < k]], others[j[place < k]], s[i, j][place < k]

    return run


def spread(ids: np.ndarray, others: np.ndarray, s: np.ndarray, labels: np.ndarray, marks: np.ndarray) -> tuple:
    """A ``part``: query_id, n, least, total and squares of the scores of a block."""
    there = ~np.isnan(s)
    s0 = np.where(there, s, 0.0)
    least = np.where(there.any(axis=1), np.where(there, s, np.inf).min(axis=1), np.nan)
    return ids, there.sum(axis=1), least, s0.sum(axis=1), np.einsum("ij,ij->i", s0, s0)


def spread_alike(ids: np.ndarray, others: np.ndarray, s: np.ndarray, labels: np.ndarray, marks: np.ndarray) -> tuple:
    """``spread`` over the rows of the query's own label."""
    return spread(ids, others, np.where(labels[:, None] == marks, s, np.nan), labels, marks)


SPREAD = "query_id long, n long, least double, total double, squares double"


def gathered(parts: DataFrame) -> DataFrame:
    """query_id, n, nearest, mean and sd (of the population) from the SPREAD of all blocks."""
    g = parts.groupBy("query_id").agg(F.sum("n").alias("n"), F.min(F.when(~F.isnan("least"), F.col("least"))).alias("nearest"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))
    mean = F.try_divide("total", "n")
    return g.select("query_id", "n", "nearest", mean.alias("mean"), F.sqrt(F.greatest(F.try_divide("squares", "n") - mean * mean, F.lit(0.0))).alias("sd"))


def analogs(least: float) -> Callable:
    """A ``part``: of the scores of at least ``least`` in a block their number and sum, that of labels, and the sums of score times label, label and its square; and the best score."""

    def run(ids: np.ndarray, others: np.ndarray, s: np.ndarray, labels: np.ndarray, marks: np.ndarray) -> tuple:
        i, j = np.nonzero(s >= least)
        total = lambda w: np.bincount(i, w, len(ids))
        told, value = ~np.isnan(marks[j]), np.nan_to_num(marks[j])
        best = np.where(np.isnan(s).all(axis=1), np.nan, np.where(np.isnan(s), -np.inf, s).max(axis=1))
        return ids, np.bincount(i, minlength=len(ids)), total(s[i, j]), total(told.astype(float)), total(s[i, j] * value), total(value), total(value * value), best

    return run


ANALOGS = "query_id long, n long, near double, told double, weighted double, values double, squares double, best double"
