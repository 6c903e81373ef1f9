"""Distributions of many features told apart, and treatment effects at the median, from counts by value.

Rows are counted by (feature, value) first, with map-side combine. Running counts over the values are made in two steps: values are dealt to BUCKETS
equal ranges a feature, the few buckets are summed in order, then every bucket orders its own values. No task orders a whole feature, unless all its
values lie in one range. Nulls and values that aren't finite take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.market import clamp

BUCKETS = 4096
#: Terms of Kolmogorov's series, and the value below which it is 1 to twelve digits.
TERMS, ALWAYS = 100, 0.2


def long_form(rows: DataFrame, features: list[str], *keep: str) -> DataFrame:
    """One row a feature: ``feature``, ``v`` and the kept columns."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features]))
    return rows.select(*keep, each.alias("_f")).select(*keep, "_f.*").where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))


def running(counts: DataFrame, columns: list[str]) -> DataFrame:
    """``counts`` (feature, v and count columns) with ``cum_x``, the count up to and with v, and ``all_x``, of the feature, for each of ``columns``."""
    span = counts.groupBy("feature").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    place = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BUCKETS)).otherwise(0)
    # one row a feature, and features are columns of the input
    dealt = counts.join(F.broadcast(span), "feature").withColumn("_b", place).drop("_lo", "_hi")
    sums = dealt.groupBy("feature", "_b").agg(*[F.sum(x).alias(x) for x in columns])
    whole = Window.partitionBy("feature")
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("feature", "_b", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"_s_{x}") for x in columns], *[F.sum(x).over(whole).alias(f"all_{x}") for x in columns])
    inside = Window.partitionBy("feature", "_b").orderBy("v")
    out = dealt.join(starts, ["feature", "_b"])
    return out.withColumns({f"cum_{x}": F.col(f"_s_{x}") + F.sum(x).over(inside) for x in columns}).drop("_b", *[f"_s_{x}" for x in columns])


def kolmogorov(x: Column) -> Column:
    """Probability that the scaled largest gap of two samples of one distribution is over x."""
    term = lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), F.lit(0.0), lambda s, k: s + term(k.cast("double")))
    return F.when(x < ALWAYS, 1.0).otherwise(clamp(series, 0, 1))


def two_samples(reference: DataFrame, current: DataFrame, features: list[str], alpha: float = 0.05) -> DataFrame:
    """feature, n_reference, n_current, statistic (the largest gap of the distributions), p_value (two-sided, large samples), adjusted (by Benjamini and
    Hochberg over the features) and drift. A feature that either sample lacks has no row."""
    both = long_form(reference, features).select("feature", "v", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(long_form(current, features).select("feature", "v", F.lit(0).alias("a"), F.lit(1).alias("b")))
    c = running(both.groupBy("feature", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), ["a", "b"]).where("all_a > 0 AND all_b > 0")
    k = c.groupBy("feature").agg(F.max("all_a").alias("n_reference"), F.max("all_b").alias("n_current"), F.max(F.abs(F.col("cum_a") / F.col("all_a") - F.col("cum_b") / F.col("all_b"))).alias("statistic"))
    n, m = F.col("n_reference").cast("double"), F.col("n_current").cast("double")
    k = k.withColumn("p_value", kolmogorov(F.sqrt(n * m / (n + m)) * F.col("statistic")))
    # windows over one row a feature
    k = k.withColumns({"_i": F.row_number().over(Window.orderBy("p_value", "feature")), "_n": F.count("*").over(Window.partitionBy(F.lit(0)))})
    adjusted = F.least(F.lit(1.0), F.min(F.col("p_value") * F.col("_n") / F.col("_i")).over(Window.orderBy(F.desc("_i"))))
    return k.withColumn("adjusted", adjusted).withColumn("drift", F.col("adjusted") < alpha).drop("_i", "_n")


def dataset(reference: DataFrame, current: DataFrame, least_rows: int, share: float, alpha: float = 0.05) -> DataFrame:
    """One row: status, rows of both, features judged, features that drift (in order), their share. Fewer than ``least_rows`` current rows are
    INSUFFICIENT_SAMPLE, other columns or another order of them SCHEMA_MISMATCH; no feature is judged then. Raises for settings out of range."""
    if least_rows < 2 or not 0 < share <= 1 or not 0 < alpha < 1:
        raise ValueError("least_rows must be 2 or more, share in (0, 1], alpha in (0, 1)")
    counted = reference.agg(F.count("*").alias("reference_rows")).join(current.agg(F.count("*").alias("current_rows")), F.lit(True))
    small, same = F.col("current_rows") < least_rows, reference.columns == current.columns
    if same:
        k = two_samples(reference, current, reference.columns, alpha).agg(F.count("*").alias("features"), F.sort_array(F.collect_list(F.when(F.col("drift"), F.col("feature")))).alias("drifting"))
    else:
        k = counted.select(F.lit(0).cast("long").alias("features"), F.array().cast("array<string>").alias("drifting"))
    j = counted.join(k, F.lit(True))
    j = j.withColumns({"features": F.when(small, 0).otherwise(F.col("features")), "drifting": F.when(small, F.array().cast("array<string>")).otherwise(F.col("drifting"))})
    part = F.when(F.col("features") > 0, F.size("drifting") / F.col("features")).otherwise(0.0)
    drifts = (F.col("features") > 0) & (part >= share)
    status = F.when(small, "INSUFFICIENT_SAMPLE").when(F.lit(not same), "SCHEMA_MISMATCH").when(drifts, "DRIFT_DETECTED").otherwise("NO_DATASET_DRIFT")
    return j.select(status.alias("status"), "reference_rows", "current_rows", "features", F.array_join("drifting", ",").alias("drifting"), part.alias("share"))


def causal_screen(rows: DataFrame, features: list[str], won: str, drawn: str, least: int = 30, arm: int = 10, alpha: float = 0.05, practical: float = 0.02) -> DataFrame:
    """Rows at or over a feature's median against the others: effects on winning and drawing (indicators 0 or 1), an interval of 95 %, an approximate p and a class.
    Features with under ``least`` rows or an arm under ``arm`` are left out. Rows are read once; medians and effects come from the counts by value."""
    counts = long_form(rows, features, won, drawn).groupBy("feature", "v").agg(F.count("*").alias("n"), F.sum(won).cast("long").alias("w"), F.sum(drawn).cast("long").alias("d"))
    c = running(counts, ["n"])
    middle = lambda at: F.min(F.when(F.col("cum_n") >= at, F.col("v")))
    half = F.col("all_n") / 2
    median = c.groupBy("feature").agg(((middle(F.ceil(half)) + middle(F.floor(half) + 1)) / 2).alias("median"))
    # one row a feature
    j = counts.join(F.broadcast(median), "feature").withColumn("treated", F.col("v") >= F.col("median"))
    part = lambda x, on: F.coalesce(F.sum(F.when(F.col("treated") if on else ~F.col("treated"), F.col(x))), F.lit(0)).cast("double")
    s = j.groupBy("feature", "median").agg(*[part(x, on).alias(f"{x}{int(on)}") for x in "nwd" for on in (True, False)])
    s = s.where((F.col("n1") + F.col("n0") >= least) & (F.col("n1") >= arm) & (F.col("n0") >= arm))
    rate = {x: F.col(x) / F.col(f"n{x[1]}") for x in ("w1", "w0", "d1", "d0")}
    variance = lambda on: rate[f"w{on}"] * (1 - rate[f"w{on}"]) / (F.col(f"n{on}") - 1)
    s = s.withColumns({"ate_win": rate["w1"] - rate["w0"], "ate_draw": rate["d1"] - rate["d0"], "_se": F.sqrt(variance(1) + variance(0))})
    z = F.when(F.col("_se") == 0, 0.0).otherwise(F.abs(F.col("ate_win") / F.col("_se")))
    s = s.withColumn("p_value", clamp(F.exp(-0.717 * z - 0.416 * z * z), 0, 1))
    sure = F.col("p_value") <= alpha
    label = F.when(F.col("feature").contains("collider"), "COLLIDER_WARNING").when(sure & (F.abs("ate_win") >= practical), "CAUSAL_DRIVER").when(sure, "CONFOUNDED").otherwise("INDEPENDENT")
    spread = 1.96 * F.col("_se")
    return s.select("feature", "median", F.col("n1").cast("long").alias("treated"), F.col("n0").cast("long").alias("control"), "ate_win", "ate_draw", (F.col("ate_win") - spread).alias("low"), (F.col("ate_win") + spread).alias("high"), "p_value", label.alias("class"))
