"""Gradient boosted trees by histograms for several classes, stacking in time order, exact Shapley values of the trees.

Features are binned once at approximate quantiles; the binned table is written. A pass over it grows one level of the trees of all classes
and all folds at once: each task puts its rows' gradients into histograms by (model, class, node, feature, bin), the histograms are added, and
what reaches the driver is at most models x classes x nodes x features x bins rows, whatever the table's size. Gradients are added as
integers, so results don't depend on the order of rows or partitions.

Folds expand: with n folds the rows are n + 1 blocks in time, model m is fitted on the blocks before block m and tells its probabilities there, and
the last model is fitted on all. A row's out-of-fold probabilities hence come from earlier blocks only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.sources.scratch import scratch

BINS, ROUNDS, DEPTH, RATE, LAMBDA, LEAST_WEIGHT = 32, 12, 3, 0.2, 1.0, 1.0
#: Gradients are added in units of 2^-30.
UNIT = float(1 << 30)


@dataclass
class Tree:
    """Nodes by heap number: the children of i are 2 i + 1 (bin at most ``cut``) and 2 i + 2. ``value`` of a leaf, ``weight`` (rows) of every node."""

    feature: dict[int, int] = field(default_factory=dict)
    cut: dict[int, int] = field(default_factory=dict)
    value: dict[int, float] = field(default_factory=dict)
    weight: dict[int, float] = field(default_factory=dict)

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The node of each row, as deep as the tree is grown."""
        at = np.zeros(len(bins), np.int64)
        for node in sorted(self.feature):  # parents have smaller numbers
            here = at == node
            at[here] = np.where(bins[here, self.feature[node]] <= self.cut[node], 2 * node + 1, 2 * node + 2)
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        nodes = self.leaf_of(bins)
        out = np.zeros(len(bins))
        for node, value in self.value.items():
            out[nodes == node] = value
        return out


@dataclass
class Model:
    """``trees[round][class]``; margins start at ``base``, the logarithms of the classes' shares."""

    base: np.ndarray
    edges: list[list[float]]
    trees: list[list[Tree]] = field(default_factory=list)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.tile(self.base, (len(bins), 1))
        for row in self.trees:
            for k, tree in enumerate(row):
                out[:, k] += tree.predict(bins)
        return out

    def probabilities(self, bins: np.ndarray) -> np.ndarray:
        return softmax(self.margins(bins))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def edges_of(rows: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """Cut points of each feature: different approximate quantiles; values up to a cut are in its bin, nulls in the first."""
    return [sorted({float(x) for x in q}) for q in rows.approxQuantile(features, [i / bins for i in range(1, bins)], 0.001)]


def binned(rows: DataFrame, features: list[str], edges: list[list[float]]) -> DataFrame:
    """``rows`` with ``bins``: how many cut points are below each feature's value."""
    count = lambda c, cuts: F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda n, x: n + (F.col(c) > x).cast("int")) if cuts else F.lit(0)
    return rows.withColumn("bins", F.array(*[F.coalesce(count(c, e), F.lit(0)) for c, e in zip(features, edges)]))


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.int64).reshape(len(column), -1)


def fit(table: DataFrame, edges: list[list[float]], classes: int, models: int = 1, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, least: float = LEAST_WEIGHT) -> list[Model]:
    """``table`` has bins, label (0, 1, ...) and block; model m learns from the rows with block < m + 1."""
    features, width = len(edges), max(map(len, edges), default=0) + 1
    counts = {(r["block"], r["label"]): r["n"] for r in table.groupBy("block", F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    shares = [np.array([sum(n for (b, k), n in counts.items() if b < m + 1 and k == c) + 1.0 for c in range(classes)]) for m in range(models)]
    made = [Model(np.log(s / s.sum()), edges) for s in shares]

    def grow(growing: list[list[Tree]], level: int) -> dict:
        first, cells = 2**level - 1, 2**level * features * width

        def histograms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                bins, label, block = matrix(frame["bins"]), frame["label"].to_numpy(np.int64), frame["block"].to_numpy(np.int64)
                out = []
                for m, model in enumerate(made):
                    mine = block < m + 1
                    if not mine.any():
                        continue
                    b, p = bins[mine], model.probabilities(bins[mine])
                    for k in range(classes):
                        node = growing[m][k].leaf_of(b) - first
                        open_ = node >= 0
                        at = ((node[open_, None] * features + np.arange(features)) * width + b[open_]).ravel()
                        # whole numbers below 2^53 in a batch, so these sums are exact
                        summed = lambda x: np.bincount(at, np.repeat(x[open_], features), cells)  # noqa: B023, E731
                        g, h, n = summed(np.rint((p[:, k] - (label[mine] == k)) * UNIT)), summed(np.rint(p[:, k] * (1 - p[:, k]) * UNIT)), np.bincount(at, minlength=cells)
                        some = np.flatnonzero(n)
                        out.append(pd.DataFrame({"m": m, "k": k, "node": some // (features * width) + first, "f": some // width % features, "bin": some % width, "g": g[some].astype(np.int64), "h": h[some].astype(np.int64), "n": n[some]}))
                if out:
                    yield pd.concat(out)

        parts = table.select("bins", F.col("label").cast("int").alias("label"), F.col("block").cast("int").alias("block")).mapInPandas(histograms, "m int, k int, node long, f int, bin int, g long, h long, n long")
        out: dict = {}
        for r in parts.groupBy("m", "k", "node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).collect():
            out.setdefault((r["m"], r["k"], r["node"]), {}).setdefault(r["f"], {})[r["bin"]] = (r["g"], r["h"], r["n"])
        return out

    for _ in range(rounds):
        growing = [[Tree() for _ in range(classes)] for _ in range(models)]
        for level in range(depth + 1):
            for (m, k, node), by_feature in sorted(grow(growing, level).items()):
                tree = growing[m][k]
                g, h, n = (sum(x[i] for x in by_feature[0].values()) for i in range(3))
                tree.weight[node] = float(n)
                split = best_split(by_feature, g / UNIT, h / UNIT, least) if level < depth else None
                if split:
                    tree.feature[node], tree.cut[node] = split
                else:
                    tree.value[node] = -rate * (g / UNIT) / (h / UNIT + LAMBDA)
        for model, trees in zip(made, growing):
            model.trees.append(trees)
    return made


def best_split(by_feature: dict, g: float, h: float, least: float) -> tuple[int, int] | None:
    """(feature, bin) with the greatest gain above zero; ties to the smaller feature, then bin."""
    best, found = 1e-9, None
    for f in sorted(by_feature):
        left_g = left_h = 0
        places = sorted(by_feature[f])
        for b in places[:-1]:
            left_g, left_h = left_g + by_feature[f][b][0], left_h + by_feature[f][b][1]
            lg, lh = left_g / UNIT, left_h / UNIT
            if min(lh, h - lh) < least:
                continue
            gain = lg * lg / (lh + LAMBDA) + (g - lg) ** 2 / (h - lh + LAMBDA) - g * g / (h + LAMBDA)
            if gain > best + 1e-12:
                best, found = gain, (f, b)
    return found


def predicted(table: DataFrame, models: list[Model], key: str, which: str | None = None) -> DataFrame:
    """key, p: probabilities by the last model, or by the model that the column ``which`` numbers."""
    kinds = f"{key} {dict(table.dtypes)[key]}, p array<double>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            bins = matrix(frame["bins"])
            number = frame[which].to_numpy(np.int64) if which else np.full(len(frame), len(models) - 1)
            p = np.zeros((len(frame), len(models[0].base)))
            for m in np.unique(number):
                p[number == m] = models[m].probabilities(bins[number == m])
            yield pd.DataFrame({key: frame[key], "p": list(p)})

    return table.select(key, "bins", *([which] if which else [])).mapInPandas(run, kinds)


def blocks(rows: DataFrame, time: str, n: int) -> DataFrame:
    """``rows`` with ``block``: n + 1 blocks in time of about equal size. Rows of one time are in one block."""
    seconds = F.unix_seconds(F.col(time).cast("timestamp")).cast("double")
    cuts = rows.select(seconds.alias("t")).approxQuantile("t", [i / (n + 1) for i in range(1, n + 1)], 0.001)
    return rows.withColumn("block", sum(((seconds > x).cast("int") for x in cuts), F.lit(0)))


def _kept(df: DataFrame, label: str) -> DataFrame:
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stacked(train: DataFrame, test: DataFrame, features: list[str], label: str, key: str, time: str, classes: int = 3, folds: int = 3, seed: int = 3, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(probabilities for ``test``, out-of-fold members' probabilities of ``train``): boosted trees, a random forest and a multinomial
    regression as members, a multinomial meta model on their out-of-fold probabilities. test: key, p (stacked), boosted, forest, linear."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    edges = edges_of(train, features)
    put = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep")
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]
    base = _kept(blocks(binned(train.select(key, time, F.col(label).cast("double").alias("label"), *numbers), features, edges), time, folds), "train")
    asked = _kept(binned(test.select(key, *numbers), features, edges), "test")
    models = fit(base, edges, classes, folds + 1, rounds)
    # the model of block b was fitted on the blocks before it
    told = predicted(base.where("block > 0").withColumn("model", F.col("block") - 1), models, key, "model").withColumnRenamed("p", "boosted")
    final = predicted(asked, models, key).withColumnRenamed("p", "boosted")
    kinds = {"forest": RandomForestClassifier(featuresCol="_x", labelCol="label", numTrees=20, maxDepth=5, seed=seed), "linear": LogisticRegression(featuresCol="_x", labelCol="label", regParam=0.01)}
    vectors, asked = put.transform(base), put.transform(asked)
    for name, kind in kinds.items():
        out = lambda model, df: model.setProbabilityCol("_p").transform(df).select(key, vector_to_array("_p").alias(name))  # noqa: B023, E731
        parts = [out(kind.fit(vectors.where(F.col("block") < b)), vectors.where(F.col("block") == b)) for b in range(1, folds + 1)]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        told, final = told.join(whole, key), final.join(out(kind.fit(vectors), asked), key)
    meta = lambda df: df.withColumn("_meta", array_to_vector(F.concat("boosted", *kinds)))
    told = _kept(told.join(base.select(key, "block", "label"), key), "oof")
    top = LogisticRegression(featuresCol="_meta", labelCol="label", probabilityCol="_p", regParam=0.01).fit(meta(told))
    return top.transform(meta(final)).select(key, vector_to_array("_p").alias("p"), "boosted", *kinds), told


# --- Shapley values


def paths(tree: Tree) -> list[tuple[float, dict[int, tuple[list, float]]]]:
    """For each leaf its value and, for each feature on the way, the conditions (cut, goes left) and the share of the weight that goes the leaf's
    way at them: what a row that isn't told the feature contributes."""
    out = []

    def walk(node: int, on: dict) -> None:
        if node not in tree.feature:
            out.append((tree.value.get(node, 0.0), on))
            return
        f, cut = tree.feature[node], tree.cut[node]
        for child, left in ((2 * node + 1, True), (2 * node + 2, False)):
            conditions, share = on.get(f, ([], 1.0))
            walk(child, on | {f: ([*conditions, (cut, left)], share * tree.weight.get(child, 0.0) / tree.weight[node])})

    walk(0, {})
    return out


def tree_shapley(tree: Tree, bins: np.ndarray) -> tuple[np.ndarray, float]:
    """(values by row and feature, the tree's expected value). A leaf is reached with the product, over its path's features, of 1 or 0 for those
    a coalition tells and of the share for the others, so a feature's value is a weighted sum over the sizes of coalitions of the others: the coefficients
    of the product of (share + told x)."""
    out, expected = np.zeros(bins.shape), 0.0
    for value, on in paths(tree):
        features = list(on)
        d = len(features)
        told = {f: np.logical_and.reduce([(bins[:, f] <= cut) == left for cut, left in on[f][0]]).astype(float) for f in features}
        expected += value * float(np.prod([on[f][1] for f in features]))
        for f in features:
            sizes = [np.ones(len(bins))]
            for g in features:
                if g != f:
                    longer = [np.zeros(len(bins)) for _ in range(len(sizes) + 1)]
                    for s, c in enumerate(sizes):
                        longer[s] += c * on[g][1]
                        longer[s + 1] += c * told[g]
                    sizes = longer
            weight = sum(c * (factorial(s) * factorial(d - s - 1) / factorial(d)) for s, c in enumerate(sizes))
            out[:, f] += value * (told[f] - on[f][1]) * weight
    return out, expected


def enumerated(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The definition, over all coalitions of all features: for tests."""
    n = bins.shape[1]

    def worth(known: frozenset) -> np.ndarray:
        total = np.zeros(len(bins))
        for value, on in paths(tree):
            reach = np.ones(len(bins))
            for f, (conditions, share) in on.items():
                reach *= np.logical_and.reduce([(bins[:, f] <= cut) == left for cut, left in conditions]) if f in known else share
            total += value * reach
        return total

    out = np.zeros(bins.shape)
    for f in range(n):
        others = [g for g in range(n) if g != f]
        for size in range(n):
            for known in combinations(others, size):
                out[:, f] += factorial(size) * factorial(n - size - 1) / factorial(n) * (worth(frozenset(known) | {f}) - worth(frozenset(known)))
    return out


def shapley(table: DataFrame, model: Model, features: list[str], key: str) -> DataFrame:
    """key, class, base, margin and a value for each feature: base plus the values is the class's margin, for every row."""
    kinds = f"{key} {dict(table.dtypes)[key]}, class int, base double, margin double, " + ", ".join(f"`{f}` double" for f in features)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            bins = matrix(frame["bins"])
            margins = model.margins(bins)
            for k in range(len(model.base)):
                values, base = np.zeros((len(frame), len(features))), float(model.base[k])
                for row in model.trees:
                    v, e = tree_shapley(row[k], bins)
                    values, base = values + v, base + e
                yield pd.DataFrame({key: frame[key], "class": k, "base": base, "margin": margins[:, k], **{f: values[:, i] for i, f in enumerate(features)}})

    return table.select(key, "bins").mapInPandas(run, kinds)


def importance(values: DataFrame, features: list[str]) -> DataFrame:
    """class, feature, mean absolute value."""
    means = values.groupBy("class").agg(*[F.avg(F.abs(f)).alias(f) for f in features])
    return means.select("class", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("importance")) for f in features])).alias("x")).select("class", "x.*")
