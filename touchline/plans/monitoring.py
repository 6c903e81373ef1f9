"""Drift, health, effects, validation over folds, calibration of whole triples, simulated markets (DRF, EVL-06, CAL, UNC-01, SIM), and window packs in full (WIN)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.functions import market as mk
from touchline.operators import calibration, drift
from touchline.operators import learning as lr
from touchline.operators import matches as ops
from touchline.plans.evaluation import BRIER, GRID, HIT, RPS, SCORED, brier, called, hit, poisson_grid, rps, scored
from touchline.plans.market import joined
from touchline.plans.registry import query
from touchline.plans.timeline import MOMENTUM, TEAM, W_TEAM, rows_of
from touchline.sources import adapters as src

S, T, P = src.SETTLED, src.TEAM_ROWS, src.PREDICTIONS
IDS = ["match_id", "snap_no", "part_no", "supp_no"]
IDS_SQL = "match_id, snap_no, part_no, supp_no"
c = lambda name: F.col(name)


def up(x, places=6):
    return F.round(x + 1e-9, places)


def up_sql(x, places=6):
    return f"round({x} + 1e-9, {places})"


# ---- drift ----

#: What is compared: returned line items (current) with the others (reference).
COMPARED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_SERIES = "CASE WHEN x < 0.2 THEN 1 ELSE least(1::DOUBLE, greatest(0::DOUBLE, list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0::DOUBLE * k * k * x * x))))) END"
KS_SQL = f"""u AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, {f}::DOUBLE AS v, l_returnflag = 'R' AS cur FROM lineitem" for f in COMPARED)}), g AS (SELECT feature, v, count(*) FILTER (NOT cur) AS a, count(*) FILTER (cur) AS b FROM u GROUP BY ALL),
cdf AS (SELECT feature, sum(a) OVER (PARTITION BY feature) AS n, sum(b) OVER (PARTITION BY feature) AS m, abs(sum(a) OVER (PARTITION BY feature ORDER BY v)::DOUBLE / sum(a) OVER (PARTITION BY feature) - sum(b) OVER (PARTITION BY feature ORDER BY v)::DOUBLE / sum(b) OVER (PARTITION BY feature)) AS gap FROM g),
st AS (SELECT feature, max(n)::DOUBLE AS n, max(m)::DOUBLE AS m, max(gap) AS statistic FROM cdf GROUP BY 1), pv AS (SELECT *, {_SERIES} AS p FROM (SELECT *, sqrt(n * m / (n + m)) * statistic AS x FROM st)),
rk AS (SELECT *, row_number() OVER (ORDER BY p, feature) AS i, count(*) OVER () AS total FROM pv), ks AS (SELECT *, least(1, min(p * total / i) OVER (ORDER BY i DESC)) AS adjusted FROM rk)"""


def compared(spark, d):
    li = src.table(spark, d, "lineitem")
    return li.where("l_returnflag <> 'R'").select(*COMPARED), li.where("l_returnflag = 'R'").select(*COMPARED)


@query("drf_01_feature_drift", f"WITH {KS_SQL} SELECT feature, CAST(n AS BIGINT) AS n_reference, CAST(m AS BIGINT) AS n_current, round(statistic, 6) AS statistic, round(p, 6) AS p_value, round(adjusted, 6) AS adjusted, adjusted < 0.05 AS drift FROM ks")
def drf_01_features(spark, d):
    k = drift.two_samples(*compared(spark, d), COMPARED)
    return k.select("feature", "n_reference", "n_current", *[F.round(x, 6).alias(x) for x in ("statistic", "p_value", "adjusted")], "drift")


@query("drf_03_drift_status", f"""WITH {KS_SQL}, t AS (SELECT count(*) AS features, count(*) FILTER (adjusted < 0.05) AS k, string_agg(feature, ',' ORDER BY feature) FILTER (adjusted < 0.05) AS drifting FROM ks)
SELECT CASE WHEN k / features >= 0.5 THEN 'DRIFT_DETECTED' ELSE 'NO_DATASET_DRIFT' END AS status, (SELECT count(*) FROM lineitem WHERE l_returnflag <> 'R') AS reference_rows, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS current_rows, features, coalesce(drifting, '') AS drifting, round(k / features, 6) AS share FROM t""")
def drf_03_status(spark, d):
    return drift.dataset(*compared(spark, d), least_rows=200, share=0.5).withColumn("share", F.round("share", 6))


#: Largest changes of accuracy, Brier score and return (in per cent) below each severity, and the rows that a baseline and a health state need.
LADDER = {"critical": (0.10, 0.05, 10.0), "high": (0.07, 0.03, 7.0), "medium": (0.05, 0.02, 5.0), "low": (0.03, 0.01, None)}
BASELINE_ROWS, HEALTH_ROWS, HEALTH_BETS = 100, 50, 20
SPLIT_DAY = "1995-01-01"
_NAMES = ("accuracy", "brier", "roi")
_RUNGS = " ".join("WHEN " + " OR ".join(f"round(abs(c_{n} - b_{n}), 9) > {v}" for n, v in zip(_NAMES, limits) if v is not None) + f" THEN '{level}'" for level, limits in LADDER.items())
_WON = "CASE WHEN {call} = '{k}' THEN CASE WHEN y_{k} = 1 THEN odds_{k} - 1 ELSE -1 END END"
_CALL = "CASE WHEN p_h >= p_d AND p_h >= p_a THEN 'h' WHEN p_d >= p_a THEN 'd' ELSE 'a' END"


@query("drf_04_drift_ladder", f"""WITH {S}, {src.QUOTED}, e AS (SELECT j.*, league_id, match_date, (home_score > away_score)::INT::DOUBLE AS y_h, (home_score = away_score)::INT::DOUBLE AS y_d, (home_score < away_score)::INT::DOUBLE AS y_a FROM j JOIN settled USING (match_id)),
x AS (SELECT league_id, match_date < TIMESTAMP '{SPLIT_DAY}' AS old, {HIT} AS hit, {BRIER} / 3 AS brier, coalesce({", ".join(_WON.format(call=_CALL, k=k) for k in "hda")}) * 100 AS won FROM e),
k AS (SELECT league_id, {", ".join(f"count(*) FILTER ({f}) AS n_{s}, avg(hit) FILTER ({f}) AS {s}_accuracy, avg(brier) FILTER ({f}) AS {s}_brier, avg(won) FILTER ({f}) AS {s}_roi" for s, f in (("b", "old"), ("c", "NOT old")))} FROM x GROUP BY 1)
SELECT league_id, n_b AS baseline_rows, n_c AS current_rows, {", ".join(f"round(abs(c_{n} - b_{n}), 6) AS {n}_drift" for n in _NAMES)}, CASE WHEN n_b < {BASELINE_ROWS} THEN 'none' {_RUNGS} ELSE 'none' END AS severity,
 CASE WHEN n_c < {HEALTH_ROWS} THEN 'initializing' WHEN c_accuracy < 0.5 OR (c_roi < -5 AND n_c > {HEALTH_BETS}) THEN 'critical' WHEN c_accuracy < 0.65 OR c_brier > 0.25 THEN 'degraded' ELSE 'healthy' END AS health,
 CAST((n_c < {HEALTH_ROWS})::INT + (n_c >= {HEALTH_ROWS})::INT * ((c_accuracy < 0.65)::INT + (c_brier > 0.25)::INT + (c_roi < -5 AND n_c > {HEALTH_BETS})::INT) AS BIGINT) AS issues FROM k""")
def drf_04_ladder(spark, d):
    """Baseline (before a day) and current rows of a league: changes of accuracy, Brier score and return of one unit on each call, the severity of the largest, and the
    health of the current rows. One aggregation."""
    m = ops.settled(src.matches(spark, d))
    h, a = c("home_score"), c("away_score")
    m = m.select("match_id", "league_id", (c("match_date") < F.lit(SPLIT_DAY).cast("timestamp")).alias("old"), (h > a).cast("double").alias("y_h"), (h == a).cast("double").alias("y_d"), (h < a).cast("double").alias("y_a"))
    e = joined(spark, d).join(m, "match_id")
    won = F.coalesce(*[F.when(called() == k, F.when(c(f"y_{k}") == 1, c(f"odds_{k}") - 1).otherwise(-1.0)) for k in "hda"]) * 100
    x = e.select("league_id", "old", hit().alias("accuracy"), (brier() / 3).alias("brier"), won.alias("roi"))
    aggs = [f(F.when(side, c(n))).alias(f"{s}_{n}") for s, side in (("b", c("old")), ("c", ~c("old"))) for n, f in zip(_NAMES, (F.avg,) * 3)]
    k = x.groupBy("league_id").agg(F.count_if("old").alias("n_b"), F.count_if(~c("old")).alias("n_c"), *aggs)
    gap = {n: F.abs(c(f"c_{n}") - c(f"b_{n}")) for n in _NAMES}
    severity = F.when(c("n_b") < BASELINE_ROWS, "none")
    for level, limits in LADDER.items():
        over = F.lit(False)
        for n, v in zip(_NAMES, limits):
            over = over | (F.round(gap[n], 9) > v) if v is not None else over
        severity = severity.when(over, level)
    enough, losing = c("n_c") >= HEALTH_ROWS, (c("c_roi") < -5) & (c("n_c") > HEALTH_BETS)
    health = F.when(~enough, "initializing").when((c("c_accuracy") < 0.5) | losing, "critical").when((c("c_accuracy") < 0.65) | (c("c_brier") > 0.25), "degraded").otherwise("healthy")
    issues = F.when(enough, (c("c_accuracy") < 0.65).cast("long") + (c("c_brier") > 0.25).cast("long") + losing.cast("long")).otherwise(F.lit(1).cast("long"))
    return k.select("league_id", c("n_b").alias("baseline_rows"), c("n_c").alias("current_rows"), *[F.round(gap[n], 6).alias(f"{n}_drift") for n in _NAMES], severity.otherwise("none").alias("severity"), health.alias("health"), issues.alias("issues"))


#: Each side's means over the ten matches before.
EFFECTS = {"f_gf": "gf", "f_ga": "ga", "f_points": "points"}
_ARM = ", ".join(f"sum(({x})::INT) FILTER (v {o} md)::DOUBLE / count(*) FILTER (v {o} md) AS {n}{i}" for n, x in (("w", "won"), ("d", "drawn")) for i, o in ((1, ">="), (0, "<")))


@query("drf_05_effects", f"""WITH {T}, k AS (SELECT is_home, points = 3 AS won, points = 1 AS drawn, {", ".join(f"avg({x}) OVER w AS {n}" for n, x in EFFECTS.items())} FROM team_rows WINDOW w AS ({W_TEAM} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
u AS ({" UNION ALL ".join(f"SELECT '{n}' AS feature, {n} AS v, won, drawn FROM k WHERE is_home AND {n} IS NOT NULL" for n in EFFECTS)}), m AS (SELECT feature, quantile_cont(v, 0.5) AS md FROM u GROUP BY 1),
s AS (SELECT feature, md, count(*) FILTER (v >= md) AS n1, count(*) FILTER (v < md) AS n0, {_ARM} FROM u JOIN m USING (feature) GROUP BY ALL HAVING count(*) >= 30 AND count(*) FILTER (v >= md) >= 10 AND count(*) FILTER (v < md) >= 10),
z AS (SELECT *, w1 - w0 AS ate, sqrt(w1 * (1 - w1) / (n1 - 1) + w0 * (1 - w0) / (n0 - 1)) AS se FROM s), p AS (SELECT *, least(1, exp(-0.717::DOUBLE * abs(ate / se) - 0.416::DOUBLE * (ate / se) * (ate / se))) AS p FROM z)
SELECT feature, round(md, 6) AS median, n1 AS treated, n0 AS control, {up_sql('ate')} AS ate_win, {up_sql('d1 - d0')} AS ate_draw, {up_sql('ate - 1.96::DOUBLE * se')} AS low, {up_sql('ate + 1.96::DOUBLE * se')} AS high, {up_sql('p')} AS p_value, CASE WHEN p <= 0.05 AND abs(ate) >= 0.02 THEN 'CAUSAL_DRIVER' WHEN p <= 0.05 THEN 'CONFOUNDED' ELSE 'INDEPENDENT' END AS class FROM p""")
def drf_05_effects(spark, d):
    w = TEAM().rowsBetween(-10, -1)
    k = rows_of(spark, d).select("is_home", (c("points") == 3).cast("int").alias("won"), (c("points") == 1).cast("int").alias("drawn"), *[F.avg(x).over(w).alias(n) for n, x in EFFECTS.items()]).where("is_home")
    out = drift.causal_screen(k, list(EFFECTS), "won", "drawn")
    return out.select("feature", F.round("median", 6).alias("median"), "treated", "control", *[up(c(x)).alias(x) for x in ("ate_win", "ate_draw", "low", "high", "p_value")], "class")


# ---- validation over folds ----

FOLDS = 5
_FOLDED = f"""{SCORED}, i AS (SELECT *, row_number() OVER (PARTITION BY league_id ORDER BY match_date, match_id, snap_no, part_no, supp_no) - 1 AS i, count(*) OVER (PARTITION BY league_id) // {FOLDS + 1} AS size FROM e WHERE abs(p_h + p_d + p_a - 1) <= 1e-6),
f AS (SELECT *, i // size AS fold FROM i WHERE i // size BETWEEN 1 AND {FOLDS})"""


def folded(spark, d, folds=FOLDS):
    """Rows of valid probabilities in time order, in ``folds`` test folds of equal size after the first part."""
    w = Window.partitionBy("league_id")
    k = scored(spark, d).where(F.abs(c("p_h") + c("p_d") + c("p_a") - 1) <= 1e-6)
    place = F.row_number().over(w.orderBy("match_date", "match_id", "snap_no", "part_no", "supp_no")) - 1
    return k.withColumn("fold", F.floor(place / F.floor(F.count("*").over(w) / (folds + 1)))).where(c("fold").between(1, folds))


@query("evl_06_fold_summary", f"""WITH {_FOLDED}, s AS (SELECT league_id, fold, count(*) AS n, avg({RPS}) AS rps, min({RPS}) AS low, max({RPS}) AS high, avg({BRIER}) AS brier, avg({HIT}) AS accuracy FROM f GROUP BY ALL),
t AS (SELECT league_id, count(*) AS folds, CAST(sum(n) AS BIGINT) AS rows, avg(rps) AS rps, coalesce(stddev_samp(rps), 0) AS rps_std, min(low) AS rps_min, max(high) AS rps_max, avg(brier) AS brier, avg(accuracy) AS accuracy FROM s GROUP BY 1),
l AS ({" UNION ALL ".join(f"SELECT league_id, '{k}' AS cls, p_{k} AS p, y_{k} AS y FROM f" for k in "hda")}), b AS (SELECT league_id, cls, ceil(round(p * 10, 9)) AS bin, count(*) AS n, avg(p) AS p, avg(y) AS y, sum((p - y) * (p - y)) AS b FROM l GROUP BY ALL),
m AS (SELECT league_id, cls, sum(n) AS n, sum(n * y) / sum(n) AS base, sum(b) / sum(n) AS score FROM b GROUP BY ALL), g AS (SELECT league_id, cls, max(score) AS score, sum(b.n * (p - y) * (p - y)) FILTER (bin > 0) / max(m.n) AS rel, sum(b.n * (y - base) * (y - base)) FILTER (bin > 0) / max(m.n) AS res, max(base * (1 - base)) AS unc FROM b JOIN m USING (league_id, cls) GROUP BY ALL),
q AS (SELECT league_id, avg(score) AS score, avg(rel) AS rel, avg(res) AS res, avg(unc) AS unc FROM g GROUP BY 1)
SELECT league_id, folds, rows, {", ".join(f"{up_sql(x)} AS {x}" for x in ("rps", "rps_std", "rps_min", "rps_max", "brier", "accuracy"))}, CASE WHEN rows >= 10 THEN {up_sql('score')} END AS pooled_brier, CASE WHEN rows >= 10 THEN {up_sql('rel')} END AS reliability, CASE WHEN rows >= 10 THEN {up_sql('res')} END AS resolution, CASE WHEN rows >= 10 THEN {up_sql('unc')} END AS uncertainty FROM t JOIN q USING (league_id)""")
def evl_06_summary(spark, d):
    """A league's folds as one row: the mean of the folds' scores, their deviation, the least and largest, and the decomposition of the Brier score pooled over all
    folds (mean of three classes; no probability of 0 is in a bin; from ten rows on). One scan: folds and bins are counted together."""
    one = lambda k: F.struct(F.lit(k).alias("cls"), c(f"p_{k}").alias("p"), c(f"y_{k}").alias("y"))
    f = folded(spark, d).withColumns({"rps": rps(), "brier": brier(), "hit": hit()})
    s = f.groupBy("league_id", "fold").agg(F.count("*").alias("n"), F.avg("rps").alias("rps"), F.min("rps").alias("low"), F.max("rps").alias("high"), F.avg("brier").alias("brier"), F.avg("hit").alias("accuracy"))
    t = s.groupBy("league_id").agg(F.count("*").alias("folds"), F.sum("n").alias("rows"), F.avg("rps").alias("rps"), F.coalesce(F.stddev_samp("rps"), F.lit(0.0)).alias("rps_std"), F.min("low").alias("rps_min"), F.max("high").alias("rps_max"), F.avg("brier").alias("brier"), F.avg("accuracy").alias("accuracy"))
    b = f.select("league_id", F.explode(F.array(*map(one, "hda"))).alias("s")).select("league_id", "s.*")
    b = b.groupBy("league_id", "cls", F.ceil(F.round(c("p") * 10, 9)).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg("y").alias("y"), F.sum((c("p") - c("y")) * (c("p") - c("y"))).alias("b"))
    w = Window.partitionBy("league_id", "cls")
    b = b.withColumns({"total": F.sum("n").over(w), "base": F.sum(c("n") * c("y")).over(w) / F.sum("n").over(w)})
    binned = lambda x: F.sum(F.when(c("bin") > 0, c("n") * x * x)) / F.max("total")
    g = b.groupBy("league_id", "cls").agg((F.sum("b") / F.max("total")).alias("score"), binned(c("p") - c("y")).alias("rel"), binned(c("y") - c("base")).alias("res"), F.max(c("base") * (1 - c("base"))).alias("unc"))
    q = g.groupBy("league_id").agg(*[F.avg(x).alias(x) for x in ("score", "rel", "res", "unc")])
    pooled = lambda x, name: F.when(c("rows") >= 10, up(c(x))).alias(name)
    return t.join(q, "league_id").select("league_id", "folds", "rows", *[up(c(x)).alias(x) for x in ("rps", "rps_std", "rps_min", "rps_max", "brier", "accuracy")], pooled("score", "pooled_brier"), pooled("rel", "reliability"), pooled("res", "resolution"), pooled("unc", "uncertainty"))


# ---- calibration ----

@query("cal_05_recalibrated", f"""WITH {SCORED}, f AS (SELECT league_id, CASE WHEN avg(p_d) < 1e-9 THEN 1 ELSE round(avg(y_d) / avg(p_d) + 1e-9, 4) END AS factor FROM e GROUP BY 1), k AS (SELECT e.*, factor, least(p_d * factor, 0.6::DOUBLE) AS q FROM e JOIN f USING (league_id)),
s AS (SELECT *, CASE WHEN p_h + p_a < 1e-9 THEN 1 ELSE (1 - q) / (p_h + p_a) END AS scale FROM k)
SELECT {IDS_SQL}, factor, {up_sql('p_h * scale / (p_h * scale + q + p_a * scale)')} AS q_h, {up_sql('q / (p_h * scale + q + p_a * scale)')} AS q_d, {up_sql('p_a * scale / (p_h * scale + q + p_a * scale)')} AS q_a FROM s""")
def cal_05_recalibrated(spark, d):
    """Each league's factor (drawn share over mean draw probability) applied to its rows: the draw at most 0.6, the other two share what is left as before."""
    e = scored(spark, d)
    f = e.groupBy("league_id").agg(F.when(F.avg("p_d") < 1e-9, 1.0).otherwise(up(F.avg("y_d") / F.avg("p_d"), 4)).alias("factor"))
    k = e.join(f, "league_id").withColumn("q", F.least(c("p_d") * c("factor"), F.lit(0.6)))
    rest = c("p_h") + c("p_a")
    k = k.withColumn("scale", F.when(rest < 1e-9, 1.0).otherwise((1 - c("q")) / rest))
    total = rest * c("scale") + c("q")
    return k.select(*IDS, "factor", up(c("p_h") * c("scale") / total).alias("q_h"), up(c("q") / total).alias("q_d"), up(c("p_a") * c("scale") / total).alias("q_a"))


@query("cal_01_one_vs_rest")
def cal_01_one_vs_rest(spark, d, isotonic_from=2000):
    """All three classes calibrated one against the rest in each league (isotonic from 2,000 rows, Platt's logistic below), renormalised to 1."""
    long = calibration.long_form(scored(spark, d).select(*IDS, "league_id", *[f"{x}_{k}" for x in "py" for k in "hda"]), "league_id", {k: (f"p_{k}", f"y_{k}") for k in "hda"})
    q = calibration.applied(long, calibration.fitted(long, isotonic_from), IDS)
    return q.groupBy(*IDS).agg(F.first("method").alias("method"), *[F.max(F.when(c("cls") == k, c("q"))).alias(f"q_{k}") for k in "hda"])


@query("unc_01_breakdown", f"""WITH {P}, k AS (SELECT *, least(1, greatest(0, -(p_h * ln(p_h) + p_d * ln(p_d) + p_a * ln(p_a)) / ln(3))) AS al, 1.96::DOUBLE * sqrt(greatest(1e-6, confidence * (1 - confidence) / 100)) AS s FROM preds)
SELECT {IDS_SQL}, {up_sql('al')} AS aleatoric, {up_sql('1 - confidence')} AS epistemic, {up_sql('greatest(1.0001::DOUBLE, 1 + (1 - al) * 9)')} AS concentration, {up_sql('greatest(0, confidence - s)')} AS low, {up_sql('least(1, confidence + s)')} AS high, CASE WHEN round(1 - confidence, 9) > 0.5 THEN 'LOW_EVIDENCE' ELSE 'OK' END AS tier FROM k""")
def unc_01_breakdown(spark, d, threshold=0.5):
    p = [c(f"p_{k}") for k in "hda"]
    al, sure = mk.clamp(mk.entropy(*p) / F.ln(F.lit(3.0)), 0, 1), c("confidence")
    s = 1.96 * F.sqrt(F.greatest(F.lit(1e-6), sure * (1 - sure) / 100))
    return src.predictions(spark, d).select(*IDS, up(al).alias("aleatoric"), up(1 - sure).alias("epistemic"), up(F.greatest(F.lit(1.0001), 1 + (1 - al) * 9)).alias("concentration"), up(mk.clamp(sure - s, 0, 1)).alias("low"), up(mk.clamp(sure + s, 0, 1)).alias("high"), F.when(F.round(1 - sure, 9) > threshold, "LOW_EVIDENCE").otherwise("OK").alias("tier"))


# ---- simulated markets ----

LINES = (0.5, 1.5, 2.5, 3.5, 4.5)
SIMS = 10_000
_EVENTS = {"home": "i > j", "draw": "i = j", "away": "i < j"} | {f"over_{str(x).replace('.', '_')}": f"i + j > {x}" for x in LINES} | {f"under_{str(x).replace('.', '_')}": f"i + j < {x}" for x in LINES} | {"btts": "i > 0 AND j > 0", "home_clean": "j = 0", "away_clean": "i = 0"}
_MEANS = {"home_goals": "i", "away_goals": "j", "total_goals": "i + j"}


def _side(k, sign):
    inner = f"{k} {sign} 1.96::DOUBLE * sqrt({k} * (1 - {k}) / {SIMS})"
    return f"greatest(0, {inner})" if sign == "-" else f"least(1, {inner})"


@query("sim_01_markets", f"""WITH {GRID}, k AS (SELECT league_id, {", ".join(f"sum(p) FILTER ({x}) AS {n}" for n, x in _EVENTS.items())}, {", ".join(f"sum(p * ({x})) AS {n}, sqrt(sum(p * ({x}) * ({x})) - sum(p * ({x})) * sum(p * ({x}))) AS {n}_std" for n, x in _MEANS.items())} FROM g GROUP BY 1)
SELECT league_id, {", ".join(f"round({n}, 6) AS {n}" for n in _EVENTS)}, {", ".join(f"round({n}, 6) AS {n}, round({n}_std, 6) AS {n}_std" for n in _MEANS)}, {", ".join(f"round({_side(k, s)}, 6) AS {k}_{n}" for k in ("home", "draw", "away") for s, n in (("-", "low"), ("+", "high")))} FROM k""")
def sim_01_markets(spark, d):
    """All markets of the scoreline grid: outcomes with the interval that 10,000 simulations would have, five lines over and under, both score, clean sheets, goals."""
    p, g = c("p"), poisson_grid(spark, d)
    k = g.groupBy("league_id").agg(*[F.sum(F.when(F.expr(x), p)).alias(n) for n, x in _EVENTS.items()], *[f.alias(n) for name, x in _MEANS.items() for n, f in ((name, F.sum(p * F.expr(x))), (f"{name}_sq", F.sum(p * F.expr(x) * F.expr(x))))])
    half = lambda q: 1.96 * F.sqrt(q * (1 - q) / SIMS)
    bounds = [F.round(b, 6).alias(f"{n}_{e}") for n in ("home", "draw", "away") for e, b in (("low", F.greatest(F.lit(0.0), c(n) - half(c(n)))), ("high", F.least(F.lit(1.0), c(n) + half(c(n)))))]
    return k.select("league_id", *[F.round(n, 6).alias(n) for n in _EVENTS], *[x for n in _MEANS for x in (F.round(n, 6).alias(n), F.round(F.sqrt(c(f"{n}_sq") - c(n) * c(n)), 6).alias(f"{n}_std"))], *bounds)


@query("sim_03_intervals")
def sim_03_intervals(spark, d, draws=200):
    """Keyed draws of each match's outcome with Wilson's interval of 95 % for every share."""
    p = src.predictions(spark, d).groupBy("match_id").agg(*[F.avg(x).alias(x) for x in ("p_h", "p_d", "p_a")])
    k = lr.simulated(p, "match_id", ["p_h", "p_d", "p_a"], draws)
    for o in "hda":
        low, high = mk.wilson(c(f"sim_p_{o}") * draws, F.lit(float(draws)))
        k = k.withColumns({f"low_{o}": low, f"high_{o}": high})
    return k


# ---- window packs in full ----

_FRAMES = ", ".join(f"w{n} AS ({W_TEAM} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (5, 10, 20))


@query("win_14_form_metrics", f"""WITH {T}, k AS (SELECT match_id, team, {", ".join(f"count(*) OVER w{n} AS n{n}, sum(points) OVER w{n} AS s{n}" for n in (5, 10, 20))}, count(*) FILTER (points = 3) OVER w5 AS wins, avg(gf) OVER w5 AS gf, avg(ga) OVER w5 AS ga, avg(gf - ga) OVER w5 AS gd, count(*) FILTER (ga = 0) OVER w5 AS clean, stddev_pop(gf) OVER w10 AS sd FROM team_rows WINDOW {_FRAMES}),
f AS (SELECT *, CASE WHEN n5 = 0 THEN 0 ELSE s5 / (3.0::DOUBLE * n5) END AS f5 FROM k), g AS (SELECT *, CASE WHEN n10 = 10 THEN s10 / 30.0::DOUBLE ELSE f5 END AS f10 FROM f)
SELECT match_id, team, {up_sql('f5')} AS form_5, {up_sql('f10')} AS form_10, {up_sql('CASE WHEN n20 = 20 THEN s20 / 60.0::DOUBLE ELSE f10 END')} AS form_20, {up_sql('CASE WHEN n5 = 0 THEN 0 ELSE wins / n5::DOUBLE END')} AS win_rate_5, {up_sql('CASE WHEN n5 = 5 THEN gf ELSE 0 END')} AS goals_5, {up_sql('CASE WHEN n5 = 5 THEN ga ELSE 0 END')} AS conceded_5, {up_sql('coalesce(gd, 0)')} AS gd_avg_5, {up_sql('CASE WHEN n5 = 0 THEN 0 ELSE clean / n5::DOUBLE END')} AS clean_sheets_5, {up_sql('CASE WHEN n10 = 10 THEN sd ELSE 1 END')} AS scoring_std FROM g""")
def win_14_metrics(spark, d):
    """Points of the last 5, 10 and 20 matches over those possible; a window that isn't full takes the next shorter one's form, and the shortest divides by the matches
    there are. Goals a match only from five matches on, the deviation of goals from ten on (1 before). One sort."""
    w = {n: TEAM().rowsBetween(-n, -1) for n in (5, 10, 20)}
    k = rows_of(spark, d).select("match_id", "team", *[x for n in w for x in (F.count("*").over(w[n]).alias(f"n{n}"), F.sum("points").over(w[n]).alias(f"s{n}"))], F.count_if(c("points") == 3).over(w[5]).alias("wins"),
        F.avg("gf").over(w[5]).alias("gf"), F.avg("ga").over(w[5]).alias("ga"), F.avg(c("gf") - c("ga")).over(w[5]).alias("gd"), F.count_if(c("ga") == 0).over(w[5]).alias("clean"), F.stddev_pop("gf").over(w[10]).alias("sd"))
    over = lambda x, n: F.when(c(n) == 0, 0.0).otherwise(c(x) / c(n))
    k = k.withColumn("f5", over("s5", "n5") / 3.0)
    k = k.withColumn("f10", F.when(c("n10") == 10, c("s10") / 30.0).otherwise(c("f5")))
    full = lambda n, size, x, other: up(F.when(c(n) == size, c(x)).otherwise(other))
    return k.select("match_id", "team", up(c("f5")).alias("form_5"), up(c("f10")).alias("form_10"), up(F.when(c("n20") == 20, c("s20") / 60.0).otherwise(c("f10"))).alias("form_20"), up(over("wins", "n5")).alias("win_rate_5"), full("n5", 5, "gf", 0.0).alias("goals_5"), full("n5", 5, "ga", 0.0).alias("conceded_5"), up(F.coalesce("gd", F.lit(0.0))).alias("gd_avg_5"), up(over("clean", "n5")).alias("clean_sheets_5"), full("n10", 10, "sd", 1.0).alias("scoring_std"))


_NTH = "list_sum(list_transform(range(1, len(l) + 1), lambda i: [{}][i]))".format


@query("win_19_momentum_pack", f"""WITH {T}, k AS (SELECT match_id, team, list_reverse(array_agg({{'g': gf, 'p': points}}) OVER ({W_TEAM} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) AS l FROM team_rows)
SELECT match_id, team, {up_sql('coalesce(list_avg(list_transform(l, lambda x: x.g)), 1)')} AS lambda, {up_sql(f"CASE WHEN len(l) > 0 THEN list_sum(list_transform(range(1, len(l) + 1), lambda i: l[i].g * {MOMENTUM}[i]::DOUBLE)) / {_NTH(', '.join(f'{x}::DOUBLE' for x in MOMENTUM))} ELSE 1 END")} AS weighted,
 CAST(coalesce(CASE WHEN len(list_filter(l, lambda x: x.p <> 3)) = 0 THEN len(l) ELSE list_position(list_transform(l, lambda x: x.p = 3), FALSE) - 1 END, 0) AS BIGINT) AS win_streak, CAST(coalesce(len(list_filter(l, lambda x: x.p > 0)), 0) AS BIGINT) AS unbeaten FROM k""")
def win_19_pack(spark, d):
    """Goals of the last five matches as mean and with weights renormalised over those there are, wins in a row up to now, and how many weren't lost; 1 without history."""
    last = F.reverse(F.collect_list(F.struct(c("gf").alias("g"), c("points").alias("p"))).over(TEAM().rowsBetween(-5, -1)))
    k = rows_of(spark, d).withColumn("l", last)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    weights = F.slice(F.array(*map(F.lit, MOMENTUM)), F.lit(1), F.size("l"))
    weighted = total(F.zip_with("l", weights, lambda x, w: x["g"] * w)) / total(weights)
    some, lost = F.size("l") > 0, F.array_position(F.transform("l", lambda x: x["p"] == 3), False)
    return k.select("match_id", "team", up(F.when(some, total(F.transform("l", lambda x: x["g"].cast("double"))) / F.size("l")).otherwise(1.0)).alias("lambda"), up(F.when(some, weighted).otherwise(1.0)).alias("weighted"), F.when(lost > 0, lost - 1).otherwise(F.size("l")).cast("long").alias("win_streak"), F.size(F.filter("l", lambda x: x["p"] > 0)).cast("long").alias("unbeaten"))
