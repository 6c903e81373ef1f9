"""Forecast scoring, calibration, drift, simulation (EVL, CAL, DRF, UNC, SIM)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.functions import market as mk
from touchline.operators import matches as ops
from touchline.plans.registry import query
from touchline.sources import adapters as src

S, P = src.SETTLED, src.PREDICTIONS
SCORED = f"{S}, {P}, e AS (SELECT preds.*, home_score, away_score, league_id, match_date, (home_score > away_score)::INT::DOUBLE AS y_h, (home_score = away_score)::INT::DOUBLE AS y_d, (home_score < away_score)::INT::DOUBLE AS y_a FROM preds JOIN settled USING (match_id))"
# columns are made when a query is, since that needs a session
H, D, A = (lambda: F.col("p_h")), (lambda: F.col("p_d")), (lambda: F.col("p_a"))
YH, YD, YA = (lambda: F.col("y_h")), (lambda: F.col("y_d")), (lambda: F.col("y_a"))


def r6(c):
    return F.round(c, 6)


def scored(spark, d):
    """Predictions of settled matches with the outcome as three indicators."""
    h, a = F.col("home_score"), F.col("away_score")
    m = ops.settled(src.matches(spark, d)).select("match_id", "league_id", "match_date", (h > a).cast("double").alias("y_h"), (h == a).cast("double").alias("y_d"), (h < a).cast("double").alias("y_a"))
    return src.predictions(spark, d).join(m, "match_id")


RPS = "((p_h - y_h) * (p_h - y_h) + (p_h + p_d - y_h - y_d) * (p_h + p_d - y_h - y_d)) / 2"
BRIER = "((p_h - y_h) * (p_h - y_h) + (p_d - y_d) * (p_d - y_d) + (p_a - y_a) * (p_a - y_a))"


def rps():
    return ((H() - YH()) * (H() - YH()) + (H() + D() - YH() - YD()) * (H() + D() - YH() - YD())) / 2


def brier():
    return (H() - YH()) * (H() - YH()) + (D() - YD()) * (D() - YD()) + (A() - YA()) * (A() - YA())


def log_loss():
    return -F.ln(F.greatest(F.lit(1e-15), H() * YH() + D() * YD() + A() * YA()))


HIT = "(CASE WHEN p_h >= p_d AND p_h >= p_a THEN y_h WHEN p_d >= p_a THEN y_d ELSE y_a END)"


def hit():
    """Whether the first largest probability is the outcome's."""
    return F.when((H() >= D()) & (H() >= A()), YH()).when(D() >= A(), YD()).otherwise(YA())


@query("evl_01_rps", f"WITH {SCORED} SELECT model_version, count(*) AS n, round(avg({RPS}), 6) AS rps FROM e GROUP BY 1")
def evl_01(spark, d):
    return scored(spark, d).groupBy("model_version").agg(F.count("*").alias("n"), r6(F.avg(rps())).alias("rps"))


@query("evl_02_brier", f"WITH {SCORED} SELECT model_version, round(avg({BRIER}), 6) AS brier_sum, round(avg({BRIER} / 3), 6) AS brier_mean, round(avg((p_h - y_h) * (p_h - y_h)), 6) AS brier_home FROM e GROUP BY 1")
def evl_02(spark, d):
    return scored(spark, d).groupBy("model_version").agg(r6(F.avg(brier())).alias("brier_sum"), r6(F.avg(brier() / 3)).alias("brier_mean"), r6(F.avg((H() - YH()) * (H() - YH()))).alias("brier_home"))


LONG = f"{SCORED}, l AS (SELECT model_version, 'h' AS class, p_h AS p, y_h AS y FROM e UNION ALL SELECT model_version, 'd', p_d, y_d FROM e UNION ALL SELECT model_version, 'a', p_a, y_a FROM e)"


def by_class(spark, d):
    one = lambda k: F.struct(F.lit(k).alias("class"), F.col(f"p_{k}").alias("p"), F.col(f"y_{k}").alias("y"))
    return scored(spark, d).select("model_version", F.explode(F.array(*map(one, "hda"))).alias("s")).select("model_version", "s.*")


@query("evl_03_ece", f"WITH {LONG}, b AS (SELECT model_version, class, ceil(round(p * 10, 9)) AS bin, count(*) AS n, avg(p) AS p, avg(y) AS y FROM l WHERE p > 0 GROUP BY ALL) SELECT model_version, class, round(sum(n * abs(p - y)) / sum(n), 4) AS ece FROM b GROUP BY ALL")
def evl_03(spark, d):
    b = by_class(spark, d).where("p > 0").groupBy("model_version", "class", F.ceil(F.round(F.col("p") * 10, 9)).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg("y").alias("y"))
    return b.groupBy("model_version", "class").agg(F.round(F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n"), 4).alias("ece"))


@query("evl_04_top_label", f"WITH {SCORED}, b AS (SELECT model_version, floor(round(confidence * 10, 9)) AS bin, count(*) AS n, avg(confidence) AS c, avg({HIT}) AS acc FROM e GROUP BY ALL) SELECT model_version, round(sum(n * abs(c - acc)) / sum(n), 4) AS error FROM b GROUP BY 1")
def evl_04(spark, d):
    b = scored(spark, d).groupBy("model_version", F.floor(F.round(F.col("confidence") * 10, 9)).alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg(hit()).alias("acc"))
    return b.groupBy("model_version").agg(F.round(F.sum(F.col("n") * F.abs(F.col("c") - F.col("acc"))) / F.sum("n"), 4).alias("error"))


@query("evl_05_murphy", f"WITH {LONG}, b AS (SELECT model_version, class, ceil(round(p * 10, 9)) AS bin, count(*) AS n, avg(p) AS p, avg(y) AS y FROM l GROUP BY ALL), t AS (SELECT model_version, class, sum(n) AS n, sum(n * y) / sum(n) AS base FROM b GROUP BY ALL) SELECT model_version, class, round(sum(b.n * (b.p - b.y) * (b.p - b.y)) / max(t.n), 6) AS reliability, round(sum(b.n * (b.y - base) * (b.y - base)) / max(t.n), 6) AS resolution, round(max(base * (1 - base)), 6) AS uncertainty, count(*) AS bins FROM b JOIN t USING (model_version, class) GROUP BY ALL")
def evl_05(spark, d):
    b = by_class(spark, d).groupBy("model_version", "class", F.ceil(F.round(F.col("p") * 10, 9)).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg("y").alias("y"))
    w = Window.partitionBy("model_version", "class")
    b = b.withColumn("total", F.sum("n").over(w)).withColumn("base", F.sum(F.col("n") * F.col("y")).over(w) / F.col("total"))
    part = lambda x: r6(F.sum(F.col("n") * x * x) / F.max("total"))
    return b.groupBy("model_version", "class").agg(part(F.col("p") - F.col("y")).alias("reliability"), part(F.col("y") - F.col("base")).alias("resolution"), r6(F.max(F.col("base") * (1 - F.col("base")))).alias("uncertainty"), F.count("*").alias("bins"))


@query("evl_06_walk_forward", f"WITH {SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY league_id ORDER BY match_date, match_id, snap_no, part_no, supp_no) - 1 AS i, count(*) OVER (PARTITION BY league_id) // 6 AS size FROM e WHERE abs(p_h + p_d + p_a - 1) <= 1e-6) SELECT league_id, CAST(i // size AS BIGINT) AS fold, count(*) AS n, round(avg({RPS}), 6) AS rps, round(avg({BRIER}), 6) AS brier, round(avg({HIT}), 6) AS accuracy, CAST(min(match_date) AS DATE) AS from_day, CAST(max(match_date) AS DATE) AS to_day FROM k WHERE i // size BETWEEN 1 AND 5 GROUP BY ALL")
def evl_06(spark, d, folds=5):
    w = Window.partitionBy("league_id")
    k = scored(spark, d).where(F.abs(H() + D() + A() - 1) <= 1e-6)
    k = k.withColumn("fold", F.floor((F.row_number().over(w.orderBy("match_date", "match_id", "snap_no", "part_no", "supp_no")) - 1) / F.floor(F.count("*").over(w) / (folds + 1))))
    return k.where(F.col("fold").between(1, folds)).groupBy("league_id", "fold").agg(F.count("*").alias("n"), r6(F.avg(rps())).alias("rps"), r6(F.avg(brier())).alias("brier"), r6(F.avg(hit())).alias("accuracy"), F.to_date(F.min("match_date")).alias("from_day"), F.to_date(F.max("match_date")).alias("to_day"))


CALLED = "CASE WHEN p_h >= p_d AND p_h >= p_a THEN 'h' WHEN p_d >= p_a THEN 'd' ELSE 'a' END"


def called():
    """The class of the first largest probability."""
    return F.when((H() >= D()) & (H() >= A()), "h").when(D() >= A(), "d").otherwise("a")


# of each class: rows called and right, rows called, rows of the class
COUNTS = ", ".join(f"(count(*) FILTER (y_{k} = 1 AND {CALLED} = '{k}'))::DOUBLE AS t_{k}, (count(*) FILTER ({CALLED} = '{k}'))::DOUBLE AS c_{k}, (count(*) FILTER (y_{k} = 1))::DOUBLE AS n_{k}" for k in "hda")
MEAN_OF = "list_avg(list_filter([{}], lambda v: v IS NOT NULL))".format


@query("evl_07_league_breakdown", f"""WITH {SCORED}, k AS (SELECT league_id, count(*) AS matches, avg({HIT}) AS accuracy, avg(-ln(greatest(1e-15, p_h * y_h + p_d * y_d + p_a * y_a))) AS log_loss, avg({RPS}) AS rps, avg({BRIER}) AS brier, avg(y_d) AS draw_rate, {COUNTS} FROM e GROUP BY 1)
SELECT league_id, matches, round(accuracy, 6) AS accuracy, round(log_loss, 6) AS log_loss, round(rps, 6) AS rps, round(brier, 6) AS brier, round(draw_rate, 6) AS draw_rate, round({MEAN_OF(', '.join(f'2 * t_{k} / nullif(c_{k} + n_{k}, 0)' for k in 'hda'))}, 6) AS macro_f1,
 round({MEAN_OF(', '.join(f't_{k} / nullif(n_{k}, 0)' for k in 'hda'))}, 6) AS balanced_accuracy, round(coalesce(t_d / nullif(c_d, 0), 0), 6) AS draw_precision, round(coalesce(t_d / nullif(n_d, 0), 0), 6) AS draw_recall, round(coalesce(2 * t_d / nullif(c_d + n_d, 0), 0), 4) AS draw_f1 FROM k""")
def evl_07(spark, d):
    """One pass: scores and the confusion counts a league. Macro-F1 is over classes that occur or are called, balanced accuracy over those that occur."""
    count = lambda x: F.count_if(x).cast("double")
    counts = [count(x).alias(n + k) for k in "hda" for n, x in (("t_", (F.col(f"y_{k}") == 1) & (called() == k)), ("c_", called() == k), ("n_", F.col(f"y_{k}") == 1))]
    mean = {"accuracy": hit(), "log_loss": log_loss(), "rps": rps(), "brier": brier(), "draw_rate": YD()}
    g = scored(spark, d).groupBy("league_id").agg(F.count("*").alias("matches"), *[F.avg(x).alias(n) for n, x in mean.items()], *counts)
    t, c, n = ({k: F.col(f"{x}_{k}") for k in "hda"} for x in "tcn")
    over = lambda xs: F.aggregate(F.array_compact(F.array(*xs)), F.lit(0.0), lambda s, x: s + x) / F.size(F.array_compact(F.array(*xs)))
    part = lambda x, places=6: F.round(F.coalesce(x, F.lit(0.0)), places)
    return g.select(
        "league_id", "matches", *[r6(x).alias(x) for x in mean], r6(over([F.try_divide(2 * t[k], c[k] + n[k]) for k in "hda"])).alias("macro_f1"), r6(over([F.try_divide(t[k], n[k]) for k in "hda"])).alias("balanced_accuracy"),
        part(F.try_divide(t["d"], c["d"])).alias("draw_precision"), part(F.try_divide(t["d"], n["d"])).alias("draw_recall"), part(F.try_divide(2 * t["d"], c["d"] + n["d"]), 4).alias("draw_f1"),
    )


LOSS = "-ln(greatest(1e-15, p_h * y_h + p_d * y_d + p_a * y_a))"


@query("evl_08_confusion", f"WITH {SCORED}, n AS (SELECT model_version, count(*)::DOUBLE AS n, avg({LOSS}) AS loss FROM e GROUP BY 1), k AS (SELECT model_version, {CALLED} AS called, count(*) AS rows, count(*) FILTER (y_h = 1) AS h, count(*) FILTER (y_d = 1) AS d, count(*) FILTER (y_a = 1) AS a FROM e GROUP BY ALL) SELECT model_version, called, h, d, a, round(rows / n, 6) AS called_share, round(sum(h) OVER v / n, 6) AS h_share, round(sum(d) OVER v / n, 6) AS d_share, round(sum(a) OVER v / n, 6) AS a_share, round(loss, 6) AS log_loss FROM k JOIN n USING (model_version) WINDOW v AS (PARTITION BY model_version)")
def evl_08(spark, d):
    """By version: the confusion matrix, how often each class is called and comes, and the log loss. At most three rows a version are windowed."""
    k = scored(spark, d).groupBy("model_version", called().alias("called")).agg(F.count("*").alias("rows"), *[F.count_if(F.col(f"y_{k}") == 1).alias(k) for k in "hda"], F.sum(log_loss()).alias("loss"))
    v = Window.partitionBy("model_version")
    n = F.sum("rows").over(v)
    return k.select("model_version", "called", "h", "d", "a", r6(F.col("rows") / n).alias("called_share"), *[r6(F.sum(x).over(v) / n).alias(f"{x}_share") for x in "hda"], r6(F.sum("loss").over(v) / n).alias("log_loss"))


@query("evl_10_simplex", f"WITH {P} SELECT model_version, count(*) FILTER (least(p_h, p_d, p_a) >= 0 AND abs(p_h + p_d + p_a - 1) <= 1e-6) AS ok, count(*) AS n FROM preds GROUP BY 1")
def evl_10(spark, d):
    ok = (F.least(H(), D(), A()) >= 0) & (F.abs(H() + D() + A() - 1) <= 1e-6)
    return src.predictions(spark, d).groupBy("model_version").agg(F.count_if(ok).alias("ok"), F.count("*").alias("n"))


@query("cal_02_temperature", f"WITH {SCORED}, g AS (SELECT 0.1::DOUBLE + i * 9.9::DOUBLE / 199 AS t FROM range(200) AS r(i)), z AS (SELECT p_h, p_d, p_a, p_h * y_h + p_d * y_d + p_a * y_a AS q, count(*) AS n FROM e GROUP BY ALL), l AS (SELECT t, sum(-n * ln(pow(q, 1 / t) / (pow(p_h, 1 / t) + pow(p_d, 1 / t) + pow(p_a, 1 / t)))) / sum(n) AS nll FROM z, g GROUP BY 1) SELECT round(t, 6) AS t, round(nll, 6) AS nll FROM l ORDER BY round(nll, 9), t LIMIT 1")
def cal_02(spark, d):
    """Grid search for the softmax temperature, 200 from 0.1 to 10: equal rows are counted before the grid is laid over them."""
    z = scored(spark, d).groupBy("p_h", "p_d", "p_a", (H() * YH() + D() * YD() + A() * YA()).alias("q")).agg(F.count("*").alias("n"))
    g = z.withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: 0.1 + i * F.lit(9.9) / 199)))
    inv = 1 / F.col("t")
    nll = -F.ln(F.pow("q", inv) / (F.pow(H(), inv) + F.pow(D(), inv) + F.pow(A(), inv)))
    best = g.groupBy("t").agg((F.sum(F.col("n") * nll) / F.sum("n")).alias("nll"))
    return best.orderBy(F.round("nll", 9), "t").limit(1).select(r6("t").alias("t"), r6("nll").alias("nll"))


@query("cal_05_draw_inflation", f"WITH {SCORED}, f AS (SELECT league_id, avg(y_d) / avg(p_d) AS factor FROM e GROUP BY 1) SELECT league_id, round(factor, 6) AS factor, round(least(0.6, avg(p_d) * max(factor)), 6) AS draw FROM e JOIN f USING (league_id) GROUP BY league_id, factor")
def cal_05(spark, d):
    return scored(spark, d).groupBy("league_id").agg(r6(F.avg(YD()) / F.avg(D())).alias("factor"), r6(F.least(F.lit(0.6), F.avg(D()) * (F.avg(YD()) / F.avg(D())))).alias("draw"))


#: The share of draws that a ratio of one means, the least ratio, the weight of a shortfall.
DRAWS, LEAST_RATIO, SHORTFALL = 0.246, 0.998, 2.0


@query("cal_08_draw_policy", f"""WITH {SCORED}, z0 AS (SELECT p_h, p_d, p_a, y_h, y_d, y_a, count(*) AS n FROM e GROUP BY ALL), z AS (SELECT *, sum(n) OVER () AS total, sum(n) OVER (ORDER BY p_d DESC, p_h, p_a, y_h, y_d ROWS UNBOUNDED PRECEDING) - n AS before FROM z0),
 r AS (SELECT i, j, p_d >= (5 + i) / 100.0::DOUBLE OR abs(p_h - p_a) <= j / 100.0::DOUBLE AS masked, (p_d > p_h AND p_d >= p_a) AS argmax, z.* FROM z, range(71) AS a(i), range(36) AS b(j)),
 s AS (SELECT i, j, sum(CASE WHEN masked OR argmax THEN n ELSE 0 END) / max(total)::DOUBLE / {DRAWS}::DOUBLE AS ratio FROM r GROUP BY ALL),
 k AS (SELECT r.*, CASE WHEN masked OR argmax THEN n WHEN s.ratio < {LEAST_RATIO}::DOUBLE THEN least(n, greatest(0, ceil({LEAST_RATIO}::DOUBLE * {DRAWS}::DOUBLE * total) - before)) ELSE 0 END AS drawn FROM r JOIN s USING (i, j)),
 t AS (SELECT i, j, sum(drawn * y_d + (n - drawn) * CASE WHEN p_h >= p_a THEN y_h ELSE y_a END) / max(total) AS accuracy, sum(drawn) / max(total) / {DRAWS}::DOUBLE AS ratio FROM k GROUP BY ALL)
SELECT round((5 + i) / 100.0::DOUBLE, 2) AS threshold, round(j / 100.0::DOUBLE, 2) AS margin, round(accuracy, 6) AS accuracy, round(ratio, 6) AS ratio FROM t ORDER BY round(accuracy - {SHORTFALL} * greatest(0, {LEAST_RATIO}::DOUBLE - ratio), 9) DESC, i, j LIMIT 1""")
def cal_08(spark, d):
    """The best of 71 thresholds and 36 margins. A row is called a draw if its draw probability reaches the threshold, home and
    away are within the margin, or draw is largest; with too few draws those with the largest draw probability are added. Equal
    rows are counted first, and the rank of a count is the rows before it; that one ordered pass is over different triples."""
    z = scored(spark, d).groupBy("p_h", "p_d", "p_a", "y_h", "y_d", "y_a").agg(F.count("*").alias("n"))
    first = Window.orderBy(F.desc("p_d"), "p_h", "p_a", "y_h", "y_d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    z = z.withColumns({"total": F.sum("n").over(Window.partitionBy(F.lit(0))), "before": F.sum("n").over(first) - F.col("n")})
    n, total = F.col("n"), F.max("total")
    r = z.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(70)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(35))))
    masked = (D() >= (5 + F.col("i")) / 100.0) | (F.abs(H() - A()) <= F.col("j") / 100.0) | ((D() > H()) & (D() >= A()))
    other = F.when(H() >= A(), YH()).otherwise(YA())
    # both outcomes of the top-up in one aggregation: without it, and with it
    target = F.ceil(F.lit(LEAST_RATIO) * F.lit(DRAWS) * F.col("total"))
    plain, filled = F.when(masked, n).otherwise(0), F.when(masked, n).otherwise(F.least(n, F.greatest(F.lit(0), target - F.col("before"))))
    right = lambda drawn: F.sum(drawn * YD() + (n - drawn) * other) / total
    t = r.groupBy("i", "j").agg((F.sum(plain) / total / DRAWS).alias("r0"), right(plain).alias("a0"), (F.sum(filled) / total / DRAWS).alias("r1"), right(filled).alias("a1"))
    few = F.col("r0") < LEAST_RATIO
    t = t.select("i", "j", F.when(few, F.col("r1")).otherwise(F.col("r0")).alias("ratio"), F.when(few, F.col("a1")).otherwise(F.col("a0")).alias("accuracy"))
    score = F.round(F.col("accuracy") - SHORTFALL * F.greatest(F.lit(0.0), LEAST_RATIO - F.col("ratio")), 9)
    return t.orderBy(F.desc(score), "i", "j").limit(1).select(F.round((5 + F.col("i")) / 100.0, 2).alias("threshold"), F.round(F.col("j") / 100.0, 2).alias("margin"), r6("accuracy").alias("accuracy"), r6("ratio").alias("ratio"))


@query("cal_10_draw_blend", f"WITH {P} SELECT match_id, snap_no, part_no, supp_no, round(sqrt(p_d * 0.28::DOUBLE) / (p_h + p_a + sqrt(p_d * 0.28::DOUBLE)), 6) AS draw FROM preds")
def cal_10(spark, d, q=0.28):
    b = F.sqrt(D() * q)
    return src.predictions(spark, d).select("match_id", "snap_no", "part_no", "supp_no", r6(b / (H() + A() + b)).alias("draw"))


@query("cal_11_diversity", f"WITH {P}, m AS (SELECT match_id, avg(p_h) FILTER (model_version = 'F') AS f, avg(p_h) FILTER (model_version = 'O') AS o FROM preds GROUP BY 1) SELECT count(*) AS n, round(corr(f, o), 6) AS r, round(avg(abs(f - o)), 6) AS disagreement FROM m WHERE f IS NOT NULL AND o IS NOT NULL")
def cal_11(spark, d):
    m = src.predictions(spark, d).groupBy("match_id").agg(*[F.avg(F.when(F.col("model_version") == v, H())).alias(v.lower()) for v in "FO"]).where("f IS NOT NULL AND o IS NOT NULL")
    return m.agg(F.count("*").alias("n"), r6(F.corr("f", "o")).alias("r"), r6(F.avg(F.abs(F.col("f") - F.col("o")))).alias("disagreement"))


@query("drf_01_ks", "WITH u AS (SELECT l_quantity AS v, (l_returnflag = 'R')::INT AS s FROM lineitem), g AS (SELECT v, count(*) FILTER (s = 1) AS a, count(*) FILTER (s = 0) AS b FROM u GROUP BY 1), c AS (SELECT sum(a) OVER (ORDER BY v)::DOUBLE / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY v)::DOUBLE / sum(b) OVER () AS fb FROM g) SELECT 'quantity' AS feature, round(max(abs(fa - fb)), 6) AS statistic FROM c")
def drf_01(spark, d):
    """Two-sample Kolmogorov-Smirnov. Counts by value come first; the one ordered pass is over
    different values (rounded quantities), not rows. Continuous features are binned before."""
    g = src.table(spark, d, "lineitem").groupBy(F.col("l_quantity").alias("v")).agg(F.count_if(F.col("l_returnflag") == "R").alias("a"), F.count_if(F.col("l_returnflag") != "R").alias("b"))
    w, whole = Window.orderBy("v"), Window.partitionBy(F.lit(0))
    cdf = lambda c: F.sum(c).over(w) / F.sum(c).over(whole)
    return g.select(F.abs(cdf("a") - cdf("b")).alias("gap")).agg(F.lit("quantity").alias("feature"), r6(F.max("gap")).alias("statistic"))


@query("drf_02_benjamini_hochberg", "WITH p AS (SELECT p_partkey AS id, (p_partkey * 37 % 1000 + 1) / 1001.0::DOUBLE AS p FROM part), k AS (SELECT *, row_number() OVER (ORDER BY p, id) AS i, count(*) OVER () AS n FROM p) SELECT id, round(least(1, min(p * n / i) OVER (ORDER BY i DESC)), 6) AS adjusted FROM k")
def drf_02(spark, d):
    """Equal p-values have one adjusted value, that of the last of them, so the ordered passes are over different p-values."""
    p = src.table(spark, d, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 37 % 1000 + 1) / 1001.0).alias("p"))
    g = p.groupBy("p").agg(F.count("*").alias("n"))
    g = g.withColumns({"i": F.sum("n").over(Window.orderBy("p")), "total": F.sum("n").over(Window.partitionBy(F.lit(0)))})
    adjusted = F.least(F.lit(1.0), F.min(F.col("p") * F.col("total") / F.col("i")).over(Window.orderBy(F.desc("p"))))
    return p.join(g.select("p", r6(adjusted).alias("adjusted")), "p").select("id", "adjusted")


@query("drf_05_causal_screen", "WITH m AS (SELECT quantile_cont(l_quantity, 0.5) AS m FROM lineitem), a AS (SELECT (l_quantity > m)::INT AS arm, l_extendedprice AS y FROM lineitem, m), s AS (SELECT count(*) FILTER (arm = 1) AS n1, count(*) FILTER (arm = 0) AS n0, avg(y) FILTER (arm = 1) AS m1, avg(y) FILTER (arm = 0) AS m0, var_samp(y) FILTER (arm = 1) AS v1, var_samp(y) FILTER (arm = 0) AS v0 FROM a) SELECT n1, n0, round(m1 - m0, 4) AS ate, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 3) AS z FROM s")
def drf_05(spark, d):
    li = src.table(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    a = li.join(F.broadcast(li.agg(F.median("l_quantity").alias("m"))), F.lit(True)).withColumn("arm", F.col("l_quantity") > F.col("m"))
    y = F.col("l_extendedprice")
    arm = lambda on: F.when(F.col("arm") if on else ~F.col("arm"), y)
    s = a.agg(F.count(arm(True)).alias("n1"), F.count(arm(False)).alias("n0"), F.avg(arm(True)).alias("m1"), F.avg(arm(False)).alias("m0"), F.var_samp(arm(True)).alias("v1"), F.var_samp(arm(False)).alias("v0"))
    return s.select("n1", "n0", F.round(F.col("m1") - F.col("m0"), 4).alias("ate"), F.round((F.col("m1") - F.col("m0")) / F.sqrt(F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0")), 3).alias("z"))


@query("unc_01_entropy", f"WITH {P} SELECT match_id, snap_no, part_no, supp_no, round(-(p_h * ln(p_h) + p_d * ln(p_d) + p_a * ln(p_a)) / ln(3), 6) AS aleatoric, round(1 - confidence, 6) AS epistemic FROM preds")
def unc_01(spark, d):
    return src.predictions(spark, d).select("match_id", "snap_no", "part_no", "supp_no", r6(mk.entropy(H(), D(), A()) / F.ln(F.lit(3.0))).alias("aleatoric"), r6(1 - F.col("confidence")).alias("epistemic"))


LAMBDAS = f"{S}, t AS (SELECT league_id, round(avg(home_score), 6) AS lh, round(avg(away_score), 6) AS la FROM settled GROUP BY 1)"


def poisson_grid(spark, d, scale_h=1.0, scale_a=1.0, top=10):
    """Exact scoreline probabilities 0..top a league, renormalised: an 11 x 11 grid a row."""
    t = ops.settled(src.matches(spark, d)).groupBy("league_id").agg((F.round(F.avg("home_score"), 6) * scale_h).alias("lh"), (F.round(F.avg("away_score"), 6) * scale_a).alias("la"))
    pmf = lambda lam, k: F.exp(-lam) * F.pow(lam, k) / F.factorial(k)
    g = t.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(top))))
    g = g.withColumn("p", pmf(F.col("lh"), F.col("i")) * pmf(F.col("la"), F.col("j")))
    return g.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("league_id")))


GRID = f"{LAMBDAS}, g0 AS (SELECT league_id, i, j, exp(-lh) * pow(lh, i) / factorial(i::INT) * exp(-la) * pow(la, j) / factorial(j::INT) AS p FROM t, range(11) AS a(i), range(11) AS b(j)), g AS (SELECT league_id, i, j, p / sum(p) OVER (PARTITION BY league_id) AS p FROM g0)"


@query("sim_01_poisson_exact", f"WITH {GRID} SELECT league_id, round(sum(p) FILTER (i > j), 6) AS home, round(sum(p) FILTER (i = j), 6) AS draw, round(sum(p) FILTER (i < j), 6) AS away, round(sum(p) FILTER (i + j > 2), 6) AS over_2_5, round(sum(p) FILTER (i > 0 AND j > 0), 6) AS btts, round(sum(p) FILTER (j = 0), 6) AS home_clean FROM g GROUP BY 1")
def sim_01(spark, d):
    i, j, p = F.col("i"), F.col("j"), F.col("p")
    part = lambda c: r6(F.sum(F.when(c, p)))
    return poisson_grid(spark, d).groupBy("league_id").agg(part(i > j).alias("home"), part(i == j).alias("draw"), part(i < j).alias("away"), part(i + j > 2).alias("over_2_5"), part((i > 0) & (j > 0)).alias("btts"), part(j == 0).alias("home_clean"))


@query("sim_01_top_scorelines", f"WITH {GRID} SELECT league_id, CAST(i AS BIGINT) AS home, CAST(j AS BIGINT) AS away, round(p, 6) AS p FROM g QUALIFY row_number() OVER (PARTITION BY league_id ORDER BY round(p, 9) DESC, i, j) <= 5")
def sim_01_top(spark, d):
    w = Window.partitionBy("league_id").orderBy(F.desc(F.round("p", 9)), "i", "j")
    g = poisson_grid(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 5")
    return g.select("league_id", F.col("i").cast("long").alias("home"), F.col("j").cast("long").alias("away"), r6("p").alias("p"))


@query("sim_04_xg_forecast", f"WITH {src.TEAM_ROWS}, t AS (SELECT team, avg(gf) AS f, avg(ga) AS a FROM team_rows GROUP BY 1) SELECT match_id, round((h.f + w.a) / 2 * 1.1, 4) AS xg_home, round((w.f + h.a) / 2 * 0.9, 4) AS xg_away FROM settled JOIN t h ON h.team = home_id JOIN t w ON w.team = away_id")
def sim_04(spark, d):
    m = ops.settled(src.matches(spark, d))
    t = ops.team_rows(m).groupBy("team").agg(F.avg("gf").alias("f"), F.avg("ga").alias("a"))
    side = lambda k: t.select(F.col("team").alias(f"{k}_id"), F.col("f").alias(f"{k}_f"), F.col("a").alias(f"{k}_a"))
    j = m.join(side("home"), "home_id").join(side("away"), "away_id")
    return j.select("match_id", F.round((F.col("home_f") + F.col("away_a")) / 2 * 1.1, 4).alias("xg_home"), F.round((F.col("away_f") + F.col("home_a")) / 2 * 0.9, 4).alias("xg_away"))
