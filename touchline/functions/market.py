"""Odds and staking algebra as column expressions. Nothing here needs a UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def priced(o: Column, least: float = 1.0) -> Column:
    """Whether a price can be used: a finite number above ``least``."""
    return F.coalesce(~F.isnan(o) & (o > least) & (o < float("inf")), F.lit(False))


def margin(*odds: Column) -> Column:
    """Overround less one over the usable prices; 0 where none is."""
    total = sum((F.when(priced(o), 1 / o).otherwise(0.0) for o in odds), F.lit(0.0))
    return F.when(total > 0, total - 1).otherwise(0.0)


def proportional(*odds: Column) -> list[Column]:
    """De-vigged probabilities; null unless all prices are usable."""
    whole = F.lit(True)
    for o in odds:
        whole = whole & priced(o)
    total = sum((1 / o for o in odds), F.lit(0.0))
    return [F.when(whole, (1 / o) / total) for o in odds]


#: The range of the exponent 1 / k, and Newton steps: from the left of the root they only go up to it, and double the digits.
EXPONENT, STEPS = (0.1, 10.0), 8


def power(df: DataFrame, odds: list[str], names: list[str], steps: int = STEPS) -> DataFrame:
    """``df`` with de-vigged probabilities p ** t under ``names``: t such that they add up to 1, then renormalised. The sum of exp(t ln p) is convex and
    falls with t, so a step from where it is over 1 stays there, and one from the other side leads there. A step is a projection of its own, in
    generated code, that reads the one before."""
    logs = [-F.ln(F.col(o)) for o in odds]
    out = df.withColumn("_t", F.lit(1.0))
    for _ in range(steps):
        powers = [F.exp(F.col("_t") * x) for x in logs]
        out = out.withColumns({"_sum": sum(powers, F.lit(0.0)), "_slope": sum((p * x for p, x in zip(powers, logs)), F.lit(0.0))})
        out = out.withColumn("_t", clamp(F.col("_t") - (F.col("_sum") - 1) / F.col("_slope"), *EXPONENT))
    raw = {f"_r{i}": F.exp(F.col("_t") * x) for i, x in enumerate(logs)}
    out = out.withColumns(raw)
    total = sum((F.col(r) for r in raw), F.lit(0.0))
    return out.withColumns({n: F.col(r) / total for n, r in zip(names, raw)}).drop("_t", "_sum", "_slope", *raw)


def ev(p: Column, o: Column) -> Column:
    return p * o - 1


def kelly(p: Column, o: Column, share: float = 1.0, cap: float = 1.0) -> Column:
    """(bp - q) / b in [0, 1], times ``share``, at most ``cap``; 0 at unusable prices."""
    b = o - 1
    full = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (b * p - (1 - p)) / b))
    return F.when(priced(o), F.least(F.lit(float(cap)), full * share)).otherwise(0.0)


def entropy(*p: Column) -> Column:
    return -sum((F.when(x > 0, x * F.ln(x)).otherwise(0.0) for x in p), F.lit(0.0))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), x))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of a share k of n."""
    p = k / n
    centre, spread, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return (centre - spread) / scale, (centre + spread) / scale
