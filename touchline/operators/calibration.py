"""Per-group calibration of class probabilities from binned counts.

Rows are first counted by (group, class, probability bin), so a group of any size reaches one
task as at most BINS rows a class. Isotonic regression (pooled adjacent violators) where the
group has at least ``isotonic_from`` rows, else Platt's two-parameter logistic.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 2000
MAP_SCHEMA = "grp string, cls string, bin int, method string, calibrated double"


def bin_of(p: Column) -> Column:
    return F.least(F.lit(BINS - 1), F.floor(p * BINS)).cast("int")


def long_form(rows: DataFrame, group: str, probabilities: dict[str, tuple[str, str]]) -> DataFrame:
    """One row a class: grp, cls, p, y and the input's columns."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("cls"), F.col(p).cast("double").alias("p"), F.col(y).cast("double").alias("y")) for k, (p, y) in probabilities.items()]))
    return rows.select("*", F.col(group).cast("string").alias("grp"), each.alias("_c")).select("*", "_c.*").drop("_c")


def pooled(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weighted isotonic fit of the bins' shares y / n, in bin order."""
    sums, weights, spans = [], [], []
    for a, b in zip(y, n, strict=True):
        sums.append(a)
        weights.append(b)
        spans.append(1)
        while len(sums) > 1 and sums[-2] * weights[-1] >= sums[-1] * weights[-2]:
            a, b, k = sums.pop(), weights.pop(), spans.pop()
            sums[-1] += a
            weights[-1] += b
            spans[-1] += k
    return np.repeat(np.array(sums) / np.array(weights), spans)


def platt(p: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 25) -> tuple[float, float]:
    """Slope and intercept on the log-odds, by damped Newton steps with a slight ridge."""
    x = np.log(np.clip(p, 1e-6, 1 - 1e-6) / np.clip(1 - p, 1e-6, 1))
    a, b = 1.0, 0.0
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((q * n - y) * x).sum() + 1e-3 * (a - 1), (q * n - y).sum() + 1e-3 * b])
        w = n * q * (1 - q)
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fitted(long: DataFrame, isotonic_from: int = 2000) -> DataFrame:
    """The map grp, cls, bin -> calibrated for every bin, seen or not."""
    counted = long.groupBy("grp", "cls", bin_of(F.col("p")).alias("bin")).agg(F.sum("y").alias("y"), F.sum("p").alias("p"), F.count("*").alias("n"))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("bin")
        every, middle = np.arange(BINS), (np.arange(BINS) + 0.5) / BINS
        method = "isotonic" if f.n.sum() >= isotonic_from else "platt"
        if method == "isotonic":
            values = np.interp(middle, f.p / f.n, pooled(f.y.to_numpy(), f.n.to_numpy()))
        else:
            a, b = platt((f.p / f.n).to_numpy(), f.y.to_numpy(), f.n.to_numpy())
            values = 1 / (1 + np.exp(-(a * np.log(middle / (1 - middle)) + b)))
        return pd.DataFrame({"grp": f.grp.iloc[0], "cls": f.cls.iloc[0], "bin": every.astype("int32"), "method": method, "calibrated": values})

    return counted.groupBy("grp", "cls").applyInPandas(fit, MAP_SCHEMA)


def applied(long: DataFrame, maps: DataFrame, keys: list[str]) -> DataFrame:
    """``long`` with q: the calibrated probability, renormalised over the classes of a row.
    Rows of a group without a map keep their probabilities."""
    from pyspark.sql import Window

    j = long.withColumn("bin", bin_of(F.col("p"))).join(maps, ["grp", "cls", "bin"], "left").withColumn("q", F.coalesce("calibrated", "p"))
    # windows over the keys sort a partition in memory: Spark would join small ones up to its advisory size or one for each core
    j = j.repartition(int(long.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    total = F.sum("q").over(Window.partitionBy(*keys))
    return j.withColumn("q", F.when(total > 0, F.col("q") / total).otherwise(F.col("p")))


def refitted(counted: DataFrame, isotonic_from: int = 50) -> DataFrame:
    """One row on a refit from the counts of all bins (bin, y, p, n): the method, and the Brier score and
    log loss before and after."""

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("bin")
        y, n = f.y.to_numpy(float), f.n.to_numpy(float)
        p = np.clip(f.p.to_numpy(float) / n, 1e-6, 1 - 1e-6)
        method = "isotonic" if n.sum() >= isotonic_from else "platt"
        if method == "isotonic":
            q = pooled(y, n)
        else:
            a, b = platt(p, y, n)
            q = 1 / (1 + np.exp(-(a * np.log(p / (1 - p)) + b)))
        brier = lambda x: float((y * (1 - x) ** 2 + (n - y) * x**2).sum() / n.sum())
        loss = lambda x: float(-(y * np.log(np.clip(x, 1e-6, 1)) + (n - y) * np.log(np.clip(1 - x, 1e-6, 1))).sum() / n.sum())
        return pd.DataFrame({"rows": [int(n.sum())], "method": method, "brier_before": brier(p), "brier_after": brier(q), "loss_before": loss(p), "loss_after": loss(q)})

    return counted.groupBy().applyInPandas(fit, "rows long, method string, brier_before double, brier_after double, loss_before double, loss_after double")


def report(long: DataFrame, keys: list[str], top: int = 10) -> DataFrame:
    """By group: rows, mean Brier score and expected calibration error before (p) and after (q), and
    the F1 of the class ``d`` named where it is the likeliest."""
    from pyspark.sql import Window

    brier = lambda c: (F.sum((F.col(c) - F.col("y")) * (F.col(c) - F.col("y"))) / F.count_if(F.col("cls") == "d")).alias(f"brier_{c}")
    w = Window.partitionBy(*keys)
    named = long.withColumns({f"pick_{c}": F.col(c) == F.max(c).over(w) for c in "pq"})
    f1 = lambda c: F.try_divide(2.0 * F.count_if((F.col("cls") == "d") & F.col(f"pick_{c}") & (F.col("y") == 1)), F.count_if((F.col("cls") == "d") & F.col(f"pick_{c}")) + F.count_if((F.col("cls") == "d") & (F.col("y") == 1)))
    scores = named.groupBy("grp").agg(F.count_if(F.col("cls") == "d").alias("n"), F.max("method").alias("method"), brier("p"), brier("q"), F.coalesce(f1("p"), F.lit(0.0)).alias("draw_f1_p"), F.coalesce(f1("q"), F.lit(0.0)).alias("draw_f1_q"))
    gaps = None
    for c in "pq":
        cells = long.groupBy("grp", "cls", F.least(F.lit(top - 1), F.floor(F.col(c) * top)).alias("cell")).agg(F.count("*").alias("n"), F.abs(F.sum(c) - F.sum("y")).alias("gap"))
        ece = cells.groupBy("grp").agg((F.sum("gap") / F.sum("n")).alias(f"ece_{c}"))
        gaps = ece if gaps is None else gaps.join(ece, "grp")
    return scores.join(gaps, "grp")
