"""Toxicity through weak supervision.

Voters say ``toxic`` or abstain. Lexicon voters fire on a word or a word's beginning that one half of the labelled rows associates
with toxicity (any language) and the other half confirms; pattern voters on a regular expression over the text. A generative label model explains the votes by a
hidden class: voter j fires with probability a_j on toxic and b_j on clean documents, and what doesn't fire says nothing. The first half's labels start these, so
that the hidden class is toxicity and not something else; the posteriors of all rows, labelled or not, then follow from
the votes alone, and expectation-maximisation goes on with them as long as they agree better with the other half's labels
(``agreement``). Voters that agree beyond what the class explains are correlated: their conditional correlations are estimated too, and a voter's
evidence is divided by the sum of its correlations, so that five voters on one word count once. The posteriors, not the
labels, are what a logistic regression over words and word beginnings is trained on; two numbers, a slope and a shift of its
evidence, are set on the checking half. It scores every document, whole.

Training rows: of the labelled rows that ``trainable`` admits, and of the admitted documents without a label, the ``max_rows`` each with
the smallest hash of doc_id (a documented bound, MAX_ROWS). Voters, features and the vote matrix are bounded by it; counting over
the rows' texts is a Spark aggregation.

Defined results: null and empty texts get the score of no evidence; where one of the two classes has no training row, every
score is the share of toxic ones (0.0 without any); a doc_id with
conflicting labels is toxic if any row says so; repeated rows get equal scores; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import written

MAX_ROWS, VOTERS, FEATURES, TRAINING_PARTS = 12_000, 240, 6000, 96
LEAST_DOCS, CONFIRMED, BEGINNINGS, SEVERAL = 4, 1.5, (3, 4, 5, 6), 3
WORD = re.compile(r"[^\W\d_]+")
#: Pattern voters; their accuracies are estimated, so a useless one does no harm.
PATTERNS = {
    "shouting": re.compile(r"(?:\b[A-Z]{3,}\b[^\w]+){4}"), "exclaiming": re.compile(r"!{2,}"), "symbols": re.compile(r"[#$%&*]{3,}"),
    "at you": re.compile(r"\byou(?:'re| are)? (?:a |an |such |so )", re.I), "masked": re.compile(r"\b\w+\*+\w*\b"),
}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features_of(text: str) -> set[str]:
    """Lower-cased words, their beginnings as ``beginning*``, and ``beginning**`` where at
    least SEVERAL different words begin so."""
    words = set(WORD.findall(text.lower()))
    found = set(words)
    for n in BEGINNINGS:
        begun = Counter([w[:n] for w in words if len(w) > n])
        found.update([x + "*" for x in begun])
        found.update([x + "**" for x, k in begun.items() if k >= SEVERAL])
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """feature, and in how many toxic and clean rows it is: of the half that chooses voters, and of both."""
    for b in batches:
        sums: tuple[Counter, ...] = (Counter(), Counter(), Counter(), Counter())
        for text, toxic, chooses in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), b.column("chooses").to_pylist(), strict=True):
            found = features_of(text or "")
            sums[0 if toxic else 1].update(found)
            if chooses:
                sums[2 if toxic else 3].update(found)
        names = list(sums[0].keys() | sums[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([c[x] for x in names], pa.int64()) for c in sums]], ["feature", "toxic", "clean", "half_toxic", "half_clean"])


def training_rows(docs: DataFrame, labels: DataFrame, trainable: Column, max_rows: int) -> DataFrame:
    """doc_id, text, toxic (null without a label), chooses (whether the row is in the half that chooses voters) of at most twice max_rows documents."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = lambda df: df.where(trainable).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max_rows).select(F.col("doc_id").alias("id"), "toxic")
    rest = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().join(marks.select("doc_id"), "doc_id", "left_anti")
    chosen = few(marks).unionByName(few(rest.withColumn("toxic", F.lit(None).cast(marks.schema["toxic"].dataType))))
    # at most 2 max_rows short rows are broadcast; of rows with one doc_id the smallest text counts
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).withColumn("chooses", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(2)) == 0)


def label_model(votes: np.ndarray, start: np.ndarray, check: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, dict]:
    """(posterior of toxic, what was estimated) from a 0/1 matrix of votes. ``start`` and ``check`` have labels of some rows and NaN for the
    others: the first give the first estimates, the second tell when to stop."""
    every = votes.astype(np.float64)
    known, judged = ~np.isnan(start), ~np.isnan(check)
    q, among = start[known].astype(np.float64), every[known]
    share, best = float(np.clip(q.mean(), 1e-3, 1 - 1e-3)), None
    for _ in range(rounds):
        a = (q @ among + 1) / (q.sum() + 2)
        b = ((1 - q) @ among + 1) / ((1 - q).sum() + 2)
        weight = 1 / _correlations(among, q, a, b).sum(axis=1)
        posterior = 1 / (1 + np.exp(-np.clip(np.log(share / (1 - share)) + every @ (np.log(a / b) * weight), -30, 30)))
        right = float(-np.log(np.where(check[judged] > 0, posterior[judged], 1 - posterior[judged]) + 1e-9).mean()) if judged.any() else np.inf
        if best and right >= best[2]["loss"] - 1e-6:
            break
        agreement = float(((posterior >= 0.5) == (check > 0))[judged].mean()) if judged.any() else None
        best = posterior, share, {"fires_if_toxic": a, "fires_if_clean": b, "weight": weight, "loss": right, "agreement": agreement, "rows": len(every)}
        q, among, share = posterior, every, float(np.clip(posterior.mean(), 1e-3, 1 - 1e-3))
    return best[0], best[2] | {"share": best[1]}


def _correlations(every: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between voters given the class, negative ones and those under 0.1 as 0; 1 with itself."""
    seen = np.zeros((every.shape[1],) * 2)
    for weight, mean in ((q, a), (1 - q, b)):
        centred = (every - mean) * np.sqrt(weight)[:, None]
        seen += centred.T @ centred
    spread = np.sqrt(np.maximum(np.diag(seen), 1e-9))
    found = seen / spread / spread[:, None]
    found[found < 0.1] = 0
    np.fill_diagonal(found, 1)
    return found


def logistic(rows: np.ndarray, cols: np.ndarray, n: int, width: int, target: np.ndarray, l2: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept for sparse 0/1 features (Adam on the whole gradient)."""
    w, m, v, rate = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1), 0.1
    share = np.clip(target.mean(), 1e-3, 1 - 1e-3)
    w[-1] = np.log(share / (1 - share))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[cols], n) + w[-1], -30, 30)))
        g = np.append(np.bincount(cols, (p - target)[rows], width) / n + l2 * w[:-1], (p - target).mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def calibrated(z: np.ndarray, given: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the evidence that fit the labels best (a ridge of 1e-3 keeps the slope finite)."""
    x, theta = np.column_stack((z, np.ones(len(z)))), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(hessian, x.T @ (p - given) + 1e-3 * (theta - [1.0, 0.0])), -1, 1)
    return float(theta[0]), float(theta[1])


def fit(docs: DataFrame, labels: DataFrame, trainable: Column | None = None, max_rows: int = MAX_ROWS) -> dict:
    """The model: weights by feature, pattern weights, intercept and the label model's estimates."""
    rows = training_rows(docs, labels, F.lit(True) if trainable is None else trainable, max_rows)
    rows = written(rows.repartition(TRAINING_PARTS, "doc_id"), "training")  # read three times; small parts, as each row is much work
    marked = rows.where("toxic is not null").withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    totals = {(r["toxic"], r["chooses"]): r["count"] for r in marked.groupBy("toxic", "chooses").count().collect()}
    half_pos, half_neg = totals.get((1, True), 0), totals.get((0, True), 0)
    pos, neg = half_pos + totals.get((1, False), 0), half_neg + totals.get((0, False), 0)
    if not half_pos or not half_neg:
        return {"weights": {}, "patterns": {}, "intercept": None, "share": pos / max(pos + neg, 1), "voters": []}
    counted = marked.select("text", "toxic", "chooses").mapInArrow(_counted, "feature string, toxic long, clean long, half_toxic long, half_clean long").groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "half_toxic", "half_clean")])
    odds = lambda t, c, p, n: F.log((F.col(t) + 0.5) / (p + 1.0)) - F.log((F.col(c) + 0.5) / (n + 1.0))
    rated = lambda t, c, p, n: counted.where(F.col(t) + F.col(c) >= LEAST_DOCS).withColumn("odds", odds(t, c, p, n)).withColumn("gain", F.abs("odds") * F.sqrt(F.col(t) + F.col(c) * (p / n)))
    voters = rated("half_toxic", "half_clean", half_pos, half_neg).where(f"odds > 1.5 and half_toxic >= {LEAST_DOCS}").orderBy(F.desc("gain"), "feature").limit(VOTERS)
    # confirmed by the other half: odds there of more than CONFIRMED as well
    other = odds("other_toxic", "other_clean", pos - half_pos, neg - half_neg)
    voters = voters.withColumns({"other_toxic": F.col("toxic") - F.col("half_toxic"), "other_clean": F.col("clean") - F.col("half_clean")}).where(other > CONFIRMED)
    lexicon = [r["feature"] for r in voters.select("feature").collect()]
    best = rated("toxic", "clean", pos, neg).orderBy(F.desc("gain"), "feature").limit(FEATURES).select("feature").collect()
    ranked = list({r["feature"]: r for r in [*best, *voters.select("feature").collect()]}.values())
    place = {r["feature"]: i for i, r in enumerate(ranked)}

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("toxic"), pa.array([sorted(place[x] for x in features_of(t) & place.keys()) for t in texts], pa.list_(pa.int32())), pa.array([[i for i, p in enumerate(PATTERNS.values()) if p.search(t)] for t in texts], pa.list_(pa.int32())), b.column("chooses")],
                ["doc_id", "toxic", "features", "patterns", "chooses"],
            )

    sample = rows.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"), "text", "chooses").mapInArrow(matrix, "doc_id long, toxic int, features array<int>, patterns array<int>, chooses boolean").toPandas().sort_values("doc_id")  # 2 max_rows rows of indices
    n, width = len(sample), len(ranked) + len(PATTERNS)
    each = [np.concatenate((np.asarray(f, np.int64), np.asarray(p, np.int64) + len(ranked))) for f, p in zip(sample["features"], sample["patterns"], strict=True)]
    at, cols = np.repeat(np.arange(n), [len(x) for x in each]), np.concatenate(each)
    voter_of = np.full(width, -1)
    for j, name in enumerate(lexicon):
        voter_of[place[name]] = j
    voter_of[len(ranked) :] = len(lexicon) + np.arange(len(PATTERNS))
    votes = np.zeros((n, len(lexicon) + len(PATTERNS)), np.int8)
    voted = voter_of[cols] >= 0
    votes[at[voted], voter_of[cols[voted]]] = 1
    given, chooses = sample["toxic"].to_numpy(float), sample["chooses"].to_numpy(bool)
    posterior, estimated = label_model(votes, np.where(chooses, given, np.nan), np.where(chooses, np.nan, given))
    estimated |= {"posterior": posterior, "given": given}
    checked = ~chooses & ~np.isnan(given)
    w, intercept = logistic(at, cols, n, width, posterior)
    # where toxic rows have no voter their posterior is low, so the scores are low by a margin that the checking half tells
    slope, shift = calibrated((np.bincount(at, w[cols], n) + intercept)[checked], given[checked] > 0) if checked.any() else (1.0, 0.0)
    w, intercept = w * slope, intercept * slope + shift
    return {
        "weights": {r["feature"]: float(w[i]) for i, r in enumerate(ranked) if w[i]}, "patterns": {k: float(w[len(ranked) + i]) for i, k in enumerate(PATTERNS)},
        "intercept": intercept, "share": pos / (pos + neg), "voters": [*lexicon, *PATTERNS], "label_model": estimated,
    }


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score of whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast({k: model[k] for k in ("weights", "patterns", "intercept", "share")})  # at most FEATURES entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weights, patterns, keys = m["weights"], [(PATTERNS[k], w) for k, w in m["patterns"].items()], m["weights"].keys()
        for b in batches:
            out = np.full(b.num_rows, m["share"])
            if m["intercept"] is not None:
                for i, t in enumerate(b.column("text")):
                    text = t.as_py() or ""
                    # summed in order, so that equal texts have equal scores
                    z = m["intercept"] + sum(weights[x] for x in sorted(features_of(text) & keys)) + sum(w for p, w in patterns if p.search(text))
                    out[i] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def op8_weak_toxicity(spark, sf_dir):
    from touchline.llm.common import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, fit(docs, labels, ~held_out(F.col("doc_id"))))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
