"""A sampled search for ensemble weights over sums that one pass gathers.

The Brier score of a weighted mean of members is quadratic in the weights, so a pass over the rows gathers all that any trial needs: the members'
products with each other and with the outcome. The trials then cost nothing that grows with the table. They are drawn by Parzen estimators: the best
quarter of the trials so far and the others each make a density of each weight, and of some candidates from the first the one with the greatest ratio is tried.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges of the weights that are drawn, the range of what is left for the last member, and the number of trials.
RANGES, REST, TRIALS = ((0.1, 0.5), (0.1, 0.5), (0.1, 0.4)), (0.0, 0.3), 100
#: Random trials before the first estimate, share of good ones, candidates a trial.
STARTUP, GOOD, CANDIDATES = 20, 0.25, 24


@dataclass
class Sums:
    """n, members' products, members' products with the outcome, outcomes' squares; over rows and classes."""

    n: int
    gram: np.ndarray
    cross: np.ndarray
    square: float

    def brier(self, w: np.ndarray) -> float:
        return float((w @ self.gram @ w - 2 * w @ self.cross + self.square) / self.n)


def gathered(rows: DataFrame, members: list[list[str]], outcome: list[str]) -> Sums:
    """From ``members``, the probability columns of each, and the outcome's indicator columns."""
    pairs = [(i, j) for i in range(len(members)) for j in range(i, len(members))]
    over = lambda f: F.sum(sum((f(k) for k in range(len(outcome))), F.lit(0.0)))
    product = lambda a, b: over(lambda k: F.col(a[k]) * F.col(b[k]))
    row = rows.agg(F.count("*"), *[product(members[i], members[j]) for i, j in pairs], *[product(m, outcome) for m in members], product(outcome, outcome)).first()
    gram = np.zeros((len(members), len(members)))
    for (i, j), value in zip(pairs, row[1:]):
        gram[i, j] = gram[j, i] = value
    return Sums(row[0], gram, np.array(row[1 + len(pairs) : -1], dtype=float), row[-1])


def whole(x: list[float]) -> np.ndarray | None:
    """All weights from those drawn; None if what is left for the last member is out of its range."""
    rest = 1 - sum(x)
    return np.array([*x, rest]) if REST[0] - 1e-12 <= rest <= REST[1] + 1e-12 else None


def searched(sums: Sums, trials: int = TRIALS, seed: int = 42) -> tuple[np.ndarray, float, list[float]]:
    """(best weights, their score, score of each trial; infinite where the last weight was out of range)."""
    rnd = random.Random(seed)
    tried: list[tuple[float, list[float]]] = []
    best = lambda: min(tried, key=lambda t: t[0])

    def density(x: float, centres: list[float], low: float, high: float) -> float:
        width = max((high - low) / 50, (high - low) / (1 + math.sqrt(len(centres))) / 2)
        return (1 / (high - low) + sum(math.exp(-(((x - c) / width) ** 2) / 2) / (width * math.sqrt(2 * math.pi)) for c in centres)) / (len(centres) + 1)

    def draw(centres: list[float], low: float, high: float) -> float:
        i = rnd.randrange(len(centres) + 1)
        if i == len(centres):  # the prior
            return rnd.uniform(low, high)
        width = max((high - low) / 50, (high - low) / (1 + math.sqrt(len(centres))) / 2)
        while not low <= (x := rnd.gauss(centres[i], width)) <= high:
            pass
        return x

    for t in range(trials):
        if t < STARTUP:
            x = [rnd.uniform(a, b) for a, b in RANGES]
        else:
            ranked = sorted(tried, key=lambda r: r[0])
            at = max(1, math.ceil(GOOD * sum(math.isfinite(r[0]) for r in ranked)))
            good, bad = ranked[:at], ranked[at:]
            x = []
            for d, (a, b) in enumerate(RANGES):
                inside, outside = [r[1][d] for r in good], [r[1][d] for r in bad]
                options = [draw(inside, a, b) for _ in range(CANDIDATES)]
                x.append(max(options, key=lambda v: density(v, inside, a, b) / density(v, outside, a, b)))  # noqa: B023
        w = whole(x)
        tried.append((math.inf if w is None else sums.brier(w), x))
    score, x = best()
    return whole(x), score, [s for s, _ in tried]
