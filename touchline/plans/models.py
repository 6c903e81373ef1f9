"""Learned and random queries (UDF, CAL-01, SIM-03, AUG): rows only, no SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import boosting
from touchline.operators import learning as lr
from touchline.operators import matches as ops
from touchline.operators import neighbours, search
from touchline.plans.evaluation import scored
from touchline.plans.registry import query
from touchline.plans.timeline import TEAM, rows_of
from touchline.sources import adapters as src
from touchline.sources.scratch import scratch


def examples(spark, d):
    """Home rows with features strictly before the match and the outcome as label."""
    w = TEAM().rowsBetween(-10, -1)
    k = rows_of(spark, d).select("match_id", "match_date", "is_home", "points", *[F.coalesce(F.avg(c).over(w), F.lit(1.0)).alias(f"f_{c}") for c in ("gf", "ga", "points")])
    return k.where("is_home").withColumn("label", F.when(F.col("points") == 3, 0.0).when(F.col("points") == 1, 1.0).otherwise(2.0))


FEATURES = ["f_gf", "f_ga", "f_points"]
SPLIT = "1997-01-01"


@query("udf_05_stacked_model")
def udf_05(spark, d):
    """Boosted trees, a forest and a regression, stacked on their out-of-fold probabilities over expanding folds."""
    k = examples(spark, d)
    return boosting.stacked(k.where(F.col("match_date") < SPLIT), k.where(F.col("match_date") >= SPLIT), FEATURES, "label", "match_id", "match_date", folds=3, rounds=6)[0]


@query("udf_07_shapley_values")
def udf_07(spark, d):
    """Exact Shapley values of boosted trees for every later match: base and values add up to each class's margin."""
    k, path = examples(spark, d), scratch(spark, "boosted")
    train = k.where(F.col("match_date") < SPLIT)
    edges = boosting.edges_of(train, FEATURES)
    boosting.binned(train.withColumn("block", F.lit(0)), FEATURES, edges).select("bins", "label", "block").write.parquet(path)
    model = boosting.fit(spark.read.parquet(path), edges, 3, rounds=6)[0]
    return boosting.shapley(boosting.binned(k.where(F.col("match_date") >= SPLIT), FEATURES, edges), model, FEATURES, "match_id")


@query("cal_01_isotonic")
def cal_01(spark, d):
    return lr.isotonic(scored(spark, d).select("match_id", "snap_no", "part_no", "supp_no", "p_h", "y_h"), "p_h", "y_h", "calibrated")


@query("sim_03_outcome_draws")
def sim_03(spark, d):
    p = src.predictions(spark, d).groupBy("match_id").agg(*[F.avg(c).alias(c) for c in ("p_h", "p_d", "p_a")])
    return lr.simulated(p, "match_id", ["p_h", "p_d", "p_a"])


@query("aug_01_perturbed")
def aug_01(spark, d):
    return lr.perturbed(ops.settled(src.matches(spark, d)).select("match_id", F.col("home_score").cast("double").alias("h"), F.col("away_score").cast("double").alias("a")), "match_id", ["h", "a"])


@query("aug_01_flipped")
def aug_01_flipped(spark, d):
    """Noise on the scores, and one in ten of the binary indicators turned over."""
    m = ops.settled(src.matches(spark, d)).select("match_id", F.col("home_score").cast("double").alias("h"), F.col("away_score").cast("double").alias("a"), (F.col("home_score") > F.col("away_score")).cast("int").alias("won"))
    return lr.perturbed(m, "match_id", ["h", "a"], binary=("won",))


@query("aug_03_smote")
def aug_03(spark, d):
    e = src.table(spark, d, "embeddings").where("label = 1").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return neighbours.smote(e, "vec_id", "v")


@query("aug_03_neighbours", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE label = 1), k AS (SELECT a.vec_id AS id, b.vec_id AS near_id, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS place FROM e a JOIN e b ON a.vec_id <> b.vec_id) SELECT id, near_id, round(d, 6) AS d, place::INT AS place FROM k WHERE place <= 5")
def aug_03_neighbours(spark, d):
    """The five nearest of its class for every row: what the synthetic rows lie between."""
    e = src.table(spark, d, "embeddings").where("label = 1").select("vec_id", "embedding")
    return neighbours.nearest(e, "vec_id", "embedding").select("id", "near_id", F.round("d", 6).alias("d"), "place")


# --- UNC-02: concentrations of evidence, between 5 and 45

ALPHA_SQL = "SELECT *, p_h * (5 + part_no % 41) AS a1, p_d * (5 + part_no % 41) AS a2, p_a * (5 + part_no % 41) AS a3, (5 + part_no % 41)::DOUBLE AS a0 FROM preds"
IDS = ["match_id", "snap_no", "part_no", "supp_no"]


def evidence(spark, d, tasks=None):
    total = (5 + F.col("part_no") % 41).cast("double")
    return src.predictions(spark, d, tasks).select(*IDS, *[(F.col(p) * total).alias(a) for p, a in (("p_h", "a1"), ("p_d", "a2"), ("p_a", "a3"))], total.alias("a0"))


@query("unc_02_dirichlet", f"""WITH {src.PREDICTIONS}, k AS ({ALPHA_SQL}), v AS (SELECT *, (a1 * (a0 - a1) + a2 * (a0 - a2) + a3 * (a0 - a3)) / (a0 * a0 * (a0 + 1)) AS e, -(a1 / a0 * ln(a1 / a0 + 1e-8) + a2 / a0 * ln(a2 / a0 + 1e-8) + a3 / a0 * ln(a3 / a0 + 1e-8)) AS h FROM k)
SELECT {", ".join(IDS)}, round(a1 / a0, 6) AS home_prob, round(a2 / a0, 6) AS draw_prob, round(a3 / a0, 6) AS away_prob, round(e, 8) AS epistemic, round(h, 6) AS aleatoric, round(e + h, 6) AS total, a0 AS concentration, e > 0.15 AS low_evidence FROM v""")
def unc_02(spark, d, threshold=0.15):
    """Variance and entropy of a Dirichlet, in closed form."""
    a0, a = F.col("a0"), [F.col(f"a{i}") for i in (1, 2, 3)]
    e = sum((x * (a0 - x) for x in a), F.lit(0.0)) / (a0 * a0 * (a0 + 1))
    h = -sum((x / a0 * F.ln(x / a0 + 1e-8) for x in a), F.lit(0.0))
    return evidence(spark, d).select(*IDS, *[F.round(x / a0, 6).alias(n) for x, n in zip(a, ("home_prob", "draw_prob", "away_prob"))], F.round(e, 8).alias("epistemic"), F.round(h, 6).alias("aleatoric"), F.round(e + h, 6).alias("total"), a0.alias("concentration"), (e > threshold).alias("low_evidence"))


@query("unc_02_intervals")
def unc_02_intervals(spark, d):
    """95 % bounds of each outcome by keyed draws; the ids alone are dealt to tasks first, since a row's draws take far longer than its move."""
    e = evidence(spark, d, ops.tasks(src.table(spark, d, "lineitem")))
    drawn = e.select(*IDS, lr.dirichlet_intervals(F.xxhash64(F.lit(29), *IDS), F.col("a1"), F.col("a2"), F.col("a3"), moments=False).alias("i"))
    return drawn.select(*IDS, *[F.col(f"i.{side}")[k].alias(f"{side}_{name}") for side in ("ci_lower", "ci_upper") for k, name in enumerate(("home", "draw", "away"))])


@query("udf_08_sampled_weights")
def udf_08_sampled(spark, d):
    """Weights of four members with the least Brier score: the model, a sharper one, its market-like inverse and the base rates."""
    e = scored(spark, d)
    sharp = [F.pow(F.col(f"p_{k}"), 1.6) for k in "hda"]
    total = sharp[0] + sharp[1] + sharp[2]
    e = e.select(*[F.col(f"{x}_{k}").alias(f"{x}_{k}") for x in "py" for k in "hda"], *[(x / total).alias(f"s_{k}") for x, k in zip(sharp, "hda")], *[((1 - F.col(f"p_{k}")) / 2).alias(f"m_{k}") for k in "hda"], *[F.lit(b).alias(f"b_{k}") for b, k in zip((0.45, 0.25, 0.30), "hda")])
    sums = search.gathered(e, [[f"{m}_{k}" for k in "hda"] for m in "psmb"], ["y_h", "y_d", "y_a"])
    w, score, tried = search.searched(sums)
    rows = [(name, float(x), score, len(tried)) for name, x in zip(("model", "sharp", "market", "base"), w)]
    return spark.createDataFrame(rows, "member string, weight double, brier double, trials int")


@query("aug_04_mixup")
def aug_04(spark, d):
    return lr.mixup(src.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", ["o_totalprice"])
