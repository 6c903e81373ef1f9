"""Models and resampling on Spark ML and DataFrames: stacking, isotonic calibration,
augmentation, Monte Carlo. Seeded; results depend on the seed, not on row order."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(seed: int, *key: str) -> Column:
    """A number in [0, 1) that depends on the row's key and the seed only, so that a repeated task draws the same."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 40)) / F.lit(float(1 << 40))


def normal(seed: int, *key: str) -> Column:
    """Box-Muller over two keyed uniforms."""
    a, b = uniform(seed, *key), uniform(seed + 7919, *key)
    return F.sqrt(-2 * F.ln(F.greatest(a, F.lit(1e-12)))) * F.cos(2 * F.pi() * b)


def isotonic(rows: DataFrame, p: str, y: str, out: str) -> DataFrame:
    """Calibrated ``p`` by isotonic regression on ``y``."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    x = VectorAssembler(inputCols=[p], outputCol="_v").transform(rows.withColumn("_y", F.col(y).cast("double")))
    model = IsotonicRegression(featuresCol="_v", labelCol="_y", predictionCol=out).fit(x)
    return model.transform(x).drop("_v", "_y")


def perturbed(rows: DataFrame, key: str, columns: list[str], spread: float = 0.05, seed: int = 5, binary: tuple[str, ...] = (), flips: float = 0.1) -> DataFrame:
    """Gaussian noise of ``spread`` standard deviations of each column; each value of the ``binary`` columns (0 or 1) is turned over with probability ``flips``, keyed by row."""
    turned = {b: F.when(F.pmod(F.xxhash64(F.lit(seed), F.lit(b), F.col(key)), F.lit(1 << 40)) / F.lit(float(1 << 40)) < flips, 1 - F.col(b)).otherwise(F.col(b)) for b in binary}
    rows = rows.withColumns(turned) if turned else rows
    stats = rows.agg(*[F.stddev_pop(c).alias(f"_{c}") for c in columns])
    noisy = {c: F.col(c) + normal(seed + i, key) * F.col(f"_{c}") * spread for i, c in enumerate(columns)}
    return rows.join(F.broadcast(stats), F.lit(True)).withColumns(noisy).drop(*[f"_{c}" for c in columns])


#: What an injury, the weather and a referee change.
INJURY = {"attack": -0.15, "defense": -0.12}
WEATHER_XG = {"rain": -0.08, "wind": -0.03, "snow": -0.25, "heat": 0.0}
REFEREES = ("strict", "lenient", "home_biased")


def picked(options: tuple[str, ...], seed: int, *key: str) -> Column:
    """One of the options, by the row's key."""
    return F.element_at(F.array(*[F.lit(x) for x in options]), (F.floor(uniform(seed, *key) * len(options)) + 1).cast("int"))


def injured(rows: DataFrame, key: str, target: str, seed: int = 21) -> DataFrame:
    """A side loses a player of one position: that side's columns of the position shrink, the target moves with it."""
    drawn = rows.withColumns({"side": picked(("home", "away"), seed, key), "position": picked(("attack", "midfield", "defense"), seed + 1, key)})
    factor = lambda name, part: F.when(F.lit(part in name) & (F.col("position") == part) & F.lit(name).contains(F.col("side")), 1 + INJURY[part])
    changed = {n: F.col(n) * F.coalesce(*[factor(n, p) for p in INJURY], F.lit(1.0)) for n in rows.columns if n not in (key, target)}
    return drawn.withColumns(changed | {target: F.when(F.col("side") == "home", F.col(target) * 0.85).otherwise(F.least(F.lit(1.0), F.col(target) * 1.15))})


def weathered(rows: DataFrame, key: str, target: str, seed: int = 23) -> DataFrame:
    """Weather of the row's key: expected-goals columns and the target move with it."""
    drawn = rows.withColumn("weather", picked(tuple(WEATHER_XG), seed, key))
    scale = 1 + F.create_map(*[F.lit(x) for kv in WEATHER_XG.items() for x in kv])[F.col("weather")]
    return drawn.withColumns({n: F.col(n) * scale for n in rows.columns if "xg" in n} | {target: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(target) * scale))})


def refereed(rows: DataFrame, key: str, seed: int = 25) -> DataFrame:
    """A referee's profile beside each row; features and target stay."""
    return rows.withColumn("referee", picked(REFEREES, seed, key))


def augmented(rows: DataFrame, key: str, target: str) -> DataFrame:
    """The originals and a perturbed, an injury and a weather row for each, told by ``origin``."""
    numbers = [n for n in rows.columns if n not in (key, target)]
    made = {"original": rows, "perturbed": perturbed(rows, key, numbers), "injury": injured(rows, key, target).drop("side", "position"), "weather": weathered(rows, key, target).drop("weather")}
    out = None
    for name, df in made.items():
        one = df.withColumn("origin", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


#: Rows of a part of ``mixup``, and tries of a Beta draw (one fails in about 20).
MIXED, TRIES = 8192, 12


def beta(seed: int, key: str, shape: float) -> Column:
    """A symmetric Beta draw a row by accepting powers of two uniforms whose sum is at most one."""
    out = []
    for i in range(TRIES):
        x, y = (F.pow(uniform(seed + 2 * i + k, key), F.lit(1 / shape)) for k in (0, 1))
        out.append(F.when((x + y > 0) & (x + y <= 1), x / (x + y)))
    return F.coalesce(*out, F.lit(0.5))


def mixup(rows: DataFrame, key: str, columns: list[str], shape: float = 0.2, seed: int = 9) -> DataFrame:
    """Each row mixed by a Beta(shape, shape) weight with the next of its part in a seeded order: no pairs beyond n, no
    global sort; parts grow in number with the table."""
    parts = max(1, -(-rows.count() // MIXED))
    w = Window.partitionBy("_part").orderBy("_u", key)
    dealt = rows.withColumns({"_part": F.pmod(F.xxhash64(F.lit(seed), key), F.lit(parts)), "_u": uniform(seed, key), "_mix": beta(seed + 1, key, shape)})
    mixed = [(F.col("_mix") * F.col(c) + (1 - F.col("_mix")) * F.coalesce(F.lead(c).over(w), F.col(c))).alias(c) for c in columns]
    return dealt.select(key, *mixed)


#: Tries of a Gamma draw (each fails in less than 5 of 100), and samples of a row.
GAMMA_TRIES, SAMPLES = 12, 200
#: Gamma draws of a block, whose arrays stay in a core's cache, and of a call, whose later tries are made together.
BLOCK_DRAWS, CALL_DRAWS = 19_200, 307_200
GOLDEN = 0x9E3779B97F4A7C15
BOUNDS = "ci_lower array<double>, ci_upper array<double>"
INTERVAL = f"mean array<double>, variance array<double>, {BOUNDS}"


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) from counters, which are overwritten."""
    u = np.empty(x.shape)
    y = u.view(np.uint64)
    x ^= np.right_shift(x, np.uint64(30), out=y)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= np.right_shift(x, np.uint64(27), out=y)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= np.right_shift(x, np.uint64(31), out=y)
    x >>= np.uint64(11)
    np.copyto(u, x.view(np.int64), casting="unsafe")
    u *= 2.0**-53
    u += 2.0**-54
    return u


def gamma_tries(x: np.ndarray, d: np.ndarray, out: np.ndarray) -> np.ndarray:
    """A try for each draw: the cube of a normal goes to ``out``, the flat places of those that its bound refuses come back. ``x`` holds
    three counters a draw, which are overwritten; nearly all steps write where an array is no longer needed."""
    z, a, u = mixed_bits(x)
    v = x[0].view(np.float64)
    np.log(z, out=z)
    z *= -2
    np.sqrt(z, out=z)
    a *= np.pi
    np.tan(a, out=a)  # the cosine of twice the angle: (1 - tan^2) / (1 + tan^2)
    a *= a
    np.subtract(1, a, out=v)
    a += 1
    v /= a
    z *= v
    np.multiply(z, 1 / np.sqrt(9 * d), out=v)
    v += 1
    np.multiply(v, v, out=a)
    v *= a
    np.log(v, out=a)
    a -= v
    a += 1
    a *= d
    z *= z
    z *= 0.5
    a += z
    np.multiply(v, d, out=out)
    return np.flatnonzero(~(u < np.exp(a, out=a)))  # a cube below zero has no logarithm and fails


def gamma_draws(keys: np.ndarray, shape: np.ndarray, samples: int) -> np.ndarray:
    """(rows, classes, samples) of Gamma(shape) by rejection (a cube of a normal under a bound), 1e-300 at least; shapes below one are drawn one
    higher and taken down by a power of a uniform. All numbers follow from the row's key, the sample and the try. First tries are made
    in blocks of rows; later tries draw for those alone that failed so far, of all rows at once."""
    rows, classes = shape.shape
    number = lambda t, k: np.uint64((4 * t + k + 1) * GOLDEN % 2**64)
    start = keys * np.uint64(GOLDEN)
    step = np.ascontiguousarray(np.arange(samples * classes, dtype=np.uint64).reshape(samples, classes).T * np.uint64(4 * GAMMA_TRIES * GOLDEN % 2**64))
    d = (np.where(shape < 1, shape + 1, shape) - 1 / 3)[:, :, None]
    out, left = np.empty((rows, classes, samples)), [np.empty(0, np.int64)]
    block = max(1, BLOCK_DRAWS // step.size)
    space = np.empty((3, min(block, rows), classes, samples), np.uint64)
    with np.errstate(invalid="ignore", divide="ignore"):
        for at in range(0, rows, block):
            own = slice(at, at + block)
            x = space[:, : len(keys[own])]
            np.add((start[own] + number(0, 0))[:, None, None], step, out=x[0])
            np.add(x[0], np.uint64(GOLDEN), out=x[1])
            np.add(x[1], np.uint64(GOLDEN), out=x[2])
            left.append(gamma_tries(x, d[own], out[own]) + at * step.size)
        left = np.concatenate(left)
        for t in range(1, GAMMA_TRIES):
            if not len(left):
                break
            base, v = start[left // step.size] + step.ravel()[left % step.size], np.empty(len(left))
            again = gamma_tries(np.stack([base + number(t, k) for k in range(3)]), d.ravel()[left // samples], v)
            out.ravel()[left] = v
            left = left[again]
    out.ravel()[left] = d.ravel()[left // samples]
    row, k = np.nonzero(shape < 1)
    power = mixed_bits(start[row, None] + step[k] + number(0, 3)) ** (1 / np.maximum(shape[row, k], 1e-9))[:, None]
    out[row, k] = np.maximum(out[row, k] * power, 1e-300)
    return out


def dirichlet_intervals(key: Column, *alpha: Column, samples: int = SAMPLES, moments: bool = True) -> Column:
    """The 95 % bounds of each class under a Dirichlet, with ``moments`` also the mean and variance of the samples, from draws that follow from the
    row's key, so a repeated task has the same; a few hundred rows at a time."""
    @F.arrow_udf(INTERVAL if moments else BOUNDS)
    def run(seed: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        shapes, keys = np.column_stack([x.to_numpy(zero_copy_only=False) for x in (a, b, c)]).astype(float), seed.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        found = {name: np.empty(shapes.shape) for name in (("mean", "variance") if moments else ()) + ("ci_lower", "ci_upper")}
        size = max(1, CALL_DRAWS // (samples * shapes.shape[1]))
        for at in range(0, len(shapes), size):
            own = slice(at, at + size)
            p = gamma_draws(keys[own], shapes[own], samples)
            p /= p.sum(axis=1, keepdims=True)
            if moments:
                found["mean"][own], found["variance"][own] = p.mean(axis=2), p.var(axis=2, ddof=1)
            p.sort(axis=2)
            for name, share in (("ci_lower", 0.025), ("ci_upper", 0.975)):
                place = share * (samples - 1)
                low, high = p[:, :, int(place)], p[:, :, min(int(place) + 1, samples - 1)]
                found[name][own] = low + (high - low) * (place - int(place))
        offsets = pa.array(np.arange(len(shapes) + 1, dtype=np.int32) * shapes.shape[1])
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in found.values()], names=list(found))

    return run(key, *alpha)


def dropout_passes(key: Column, *logits: Column, passes: int = 50, keep: float = 0.8) -> Column:
    """Mean probabilities, epistemic spread, mean entropy and 95 % interval of softmax passes in which inputs
    drop out. Which ones follows from the row's key, so a repeated task draws the same; 512 rows at a time."""
    @F.pandas_udf("mean array<double>, epistemic double, aleatoric double, ci_lower array<double>, ci_upper array<double>")
    def run(seed: pd.Series, h: pd.Series, d: pd.Series, a: pd.Series) -> pd.DataFrame:
        z, keys = np.column_stack((h, d, a)), seed.to_numpy(np.int64).view(np.uint64)
        step = np.arange(1, 3 * passes + 1, dtype=np.uint64).reshape(passes, 1, 3) * np.uint64(0x9E3779B97F4A7C15)
        parts = []
        for at in range(0, len(z), 512):
            x = keys[at : at + 512, None] + step
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            e = np.exp(np.where((x >> np.uint64(11)) < keep * 2.0**53, z[at : at + 512] / keep, 0.0))
            p = e / e.sum(axis=2, keepdims=True)
            low, high = np.quantile(p, (0.025, 0.975), axis=0)
            entropy = -(p * np.log(p + 1e-8)).sum(axis=2).mean(axis=0)
            parts.append(pd.DataFrame({"mean": list(p.mean(axis=0)), "epistemic": p.var(axis=0, ddof=1).sum(axis=1), "aleatoric": entropy, "ci_lower": list(low), "ci_upper": list(high)}))
        return pd.concat(parts) if parts else pd.DataFrame({k: [] for k in ("mean", "epistemic", "aleatoric", "ci_lower", "ci_upper")})

    return run(key, *logits)


def simulated(rows: DataFrame, key: str, probabilities: list[str], draws: int = 200, seed: int = 13) -> DataFrame:
    """Outcome frequencies of ``draws`` keyed draws a row; draws are a sequence in the row, not rows."""
    edges = [sum((F.col(p) for p in probabilities[: i + 1]), F.lit(0.0)) for i in range(len(probabilities))]
    u = F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col(key), i), F.lit(1 << 40)) / F.lit(float(1 << 40)))
    share = lambda low, high: F.size(F.filter(F.col("_u"), lambda x: (x >= low) & (x < high))) / float(draws)
    out = [share(low, high).alias(f"sim_{p}") for p, low, high in zip(probabilities, [F.lit(0.0), *edges], edges, strict=False)]
    return rows.withColumn("_u", u).select(key, *out)
