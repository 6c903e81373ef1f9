"""The rest of the inventory: further aggregates, windows, blocks of features, decisions and identities."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.functions import market as mk
from touchline.operators import matches as ops
from touchline.operators import similarity as sim
from touchline.plans.evaluation import SCORED, brier, hit, scored
from touchline.plans.market import BOTH, IDS, IDS_SQL, TOTAL, joined
from touchline.plans.registry import query
from touchline.plans.timeline import TEAM, W_TEAM, lagged, lagged_sql, r6, rows_of
from touchline.sources import adapters as src

M, S, T, N, P = src.MATCHES, src.SETTLED, src.TEAM_ROWS, src.SNAPSHOTS, src.PREDICTIONS
HIT = "(CASE WHEN p_h >= p_d AND p_h >= p_a THEN y_h WHEN p_d >= p_a THEN y_d ELSE y_a END)"
BRIER = "((p_h - y_h) * (p_h - y_h) + (p_d - y_d) * (p_d - y_d) + (p_a - y_a) * (p_a - y_a))"
c = lambda name: F.col(name)


@query("prj_05_team_matches", f"WITH {T} SELECT match_id, opponent, is_home FROM team_rows WHERE team = 4")
def prj_05(spark, d, team=4):
    return rows_of(spark, d).where(c("team") == team).select("match_id", "opponent", "is_home")


@query("prj_06_canonical_vector", f"WITH {T}, k AS (SELECT match_id, team, avg(gf) OVER w AS f, avg(ga) OVER w AS a FROM team_rows WINDOW w AS ({W_TEAM} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) SELECT match_id, team, round(coalesce(f, 1.4), 6) AS gf, round(coalesce(a, 1.4), 6) AS ga, concat_ws(',', CASE WHEN f IS NULL THEN 'gf' END, CASE WHEN a IS NULL THEN 'ga' END) AS gaps FROM k")
def prj_06(spark, d):
    """Defaults for missing features, and which of them are defaults."""
    w = TEAM().rowsBetween(-5, -1)
    k = rows_of(spark, d).select("match_id", "team", F.avg("gf").over(w).alias("f"), F.avg("ga").over(w).alias("a"))
    gaps = F.array_compact(F.array(F.when(c("f").isNull(), "gf"), F.when(c("a").isNull(), "ga")))
    return k.select("match_id", "team", r6(F.coalesce("f", F.lit(1.4))).alias("gf"), r6(F.coalesce("a", F.lit(1.4))).alias("ga"), F.array_join(gaps, ",").alias("gaps"))


@query("prj_07_clamped_override", "SELECT o_orderkey, round(least(0.9, greatest(0.1, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 100) / 100.0::DOUBLE END, 0.5))), 6) AS v FROM orders")
def prj_07(spark, d):
    raw = F.when(c("o_orderkey") % 3 != 0, c("o_orderkey") % 100 / 100.0)
    return src.table(spark, d, "orders").select("o_orderkey", r6(mk.clamp(F.coalesce(raw, F.lit(0.5)), 0.1, 0.9)).alias("v"))


@query("prj_08_required_evidence", f"WITH {BOTH} SELECT {IDS_SQL}, concat_ws(',', CASE WHEN odds_h <= 1.5 THEN 'odds' END, CASE WHEN confidence < 0.4 THEN 'confidence' END) AS missing FROM j WHERE odds_h <= 1.5 OR confidence < 0.4")
def prj_08(spark, d):
    missing = F.array_compact(F.array(F.when(c("odds_h") <= 1.5, "odds"), F.when(c("confidence") < 0.4, "confidence")))
    return joined(spark, d).withColumn("m", missing).where(F.size("m") > 0).select(*IDS, F.array_join("m", ",").alias("missing"))


@query("jon_08_asof_event_features", "SELECT a.event_id, (SELECT round(avg(value), 6) FROM (SELECT value FROM events b WHERE b.user_id = a.user_id AND b.ts < a.ts ORDER BY b.ts DESC, b.event_id DESC LIMIT 5)) AS mean_5 FROM events a WHERE a.event_type = 'purchase'")
def jon_08(spark, d):
    """The last five values of the key before each event: one ordered window (times are unique within a user)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-5, -1)
    return src.table(spark, d, "events").withColumn("mean_5", r6(F.avg("value").over(w))).where("event_type = 'purchase'").select("event_id", "mean_5")


BANKROLL = 10_000
PICK = "CASE WHEN p_h >= p_d AND p_h >= p_a THEN {0}_h WHEN p_d >= p_a THEN {0}_d ELSE {0}_a END"


@query("agg_13_week_performance", f"""WITH {SCORED}, {N}, t AS (SELECT max(match_date) AS t FROM e), k AS (SELECT *, {HIT} AS y, {PICK.format('odds')} AS o FROM e JOIN snaps USING ({IDS_SQL}), t WHERE match_date > t - INTERVAL 7 DAY),
b AS (SELECT *, {BANKROLL} * least(0.05, greatest(0, ((o - 1) * confidence - (1 - confidence)) / (o - 1)) / 4) AS stake FROM k)
SELECT model_version, count(*) AS n, round(avg(y), 6) AS accuracy, round(avg({BRIER}), 6) AS brier, count(*) FILTER (stake > 0) AS bets, round(sum(stake * (y * o - 1)) + 1e-6, 2) AS roi, round(coalesce(sum(stake * (y * o - 1)) / nullif(count(*) FILTER (stake > 0) * {BANKROLL}, 0) * 100, 0), 4) AS roi_percent FROM b GROUP BY 1""")
def agg_13(spark, d, days=7):
    """Accuracy, Brier score, and what quarter-Kelly bets on the called outcome won, over the last days before the latest match."""
    e = scored(spark, d)
    e = e.join(F.broadcast(e.agg(F.max("match_date").alias("t"))), F.lit(True)).where(c("match_date") > c("t") - F.expr(f"INTERVAL {days} DAYS"))
    b = e.join(src.snapshots(spark, d).select(*IDS, "odds_h", "odds_d", "odds_a"), IDS).withColumns({"y": hit(), "o": F.expr(PICK.format("odds"))})
    b = b.withColumn("stake", BANKROLL * F.least(F.lit(0.05), F.greatest(F.lit(0.0), ((c("o") - 1) * c("confidence") - (1 - c("confidence"))) / (c("o") - 1)) / 4))
    won, bets = F.sum(c("stake") * (c("y") * c("o") - 1)), F.count_if(c("stake") > 0)
    return b.groupBy("model_version").agg(F.count("*").alias("n"), r6(F.avg("y")).alias("accuracy"), r6(F.avg(brier())).alias("brier"), bets.alias("bets"), F.round(won + 1e-6, 2).alias("roi"), F.round(F.coalesce(F.try_divide(won, bets * BANKROLL) * 100, F.lit(0.0)), 4).alias("roi_percent"))


BAND = "CASE WHEN confidence < 0.4 THEN 'low' WHEN confidence < 0.6 THEN 'medium' ELSE 'high' END"


@query("agg_15_confidence_bands", f"WITH {SCORED}, k AS (SELECT {BAND} AS band, count(*) AS n, avg({HIT}) AS accuracy, abs(avg(confidence) - avg({HIT})) AS gap FROM e GROUP BY 1) SELECT band, n, round(accuracy, 6) AS accuracy, round(gap, 6) AS gap, round(sum(n * gap) OVER () / sum(n) OVER (), 6) AS error FROM k")
def agg_15(spark, d):
    """Accuracy of each band, and beside it the error of all bands weighted by their rows (a window over three rows)."""
    band = F.when(c("confidence") < 0.4, "low").when(c("confidence") < 0.6, "medium").otherwise("high")
    k = scored(spark, d).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg(hit()).alias("accuracy"), F.abs(F.avg("confidence") - F.avg(hit())).alias("gap"))
    whole = Window.partitionBy(F.lit(0))
    return k.select("band", "n", r6("accuracy").alias("accuracy"), r6("gap").alias("gap"), r6(F.sum(c("n") * c("gap")).over(whole) / F.sum("n").over(whole)).alias("error"))


@query("agg_16_accuracy_by_outcome", f"WITH {SCORED} SELECT CASE WHEN y_h = 1 THEN 'h' WHEN y_d = 1 THEN 'd' ELSE 'a' END AS actual, count(*) AS n, round(avg({HIT}), 6) AS accuracy FROM e GROUP BY 1")
def agg_16(spark, d):
    actual = F.when(c("y_h") == 1, "h").when(c("y_d") == 1, "d").otherwise("a")
    return scored(spark, d).groupBy(actual.alias("actual")).agg(F.count("*").alias("n"), r6(F.avg(hit())).alias("accuracy"))


@query("agg_20_overperformance", f"WITH {T} SELECT match_id, team, round(avg(gf) OVER w, 6) AS f10, round(avg(ga) OVER w, 6) AS a10, round(avg(gf - ga) OVER w, 6) AS over10 FROM team_rows WINDOW w AS ({W_TEAM} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)")
def agg_20(spark, d):
    w = TEAM().rowsBetween(-10, -1)
    return rows_of(spark, d).select("match_id", "team", r6(F.avg("gf").over(w)).alias("f10"), r6(F.avg("ga").over(w)).alias("a10"), r6(F.avg(c("gf") - c("ga")).over(w)).alias("over10"))


@query("agg_21_squad_value", "WITH v AS (SELECT o_custkey AS team, o_orderdate AS d, o_orderkey AS k, o_totalprice AS v FROM orders) SELECT k AS order_id, round(sum(v) OVER (PARTITION BY team ORDER BY d, k), 2) AS value FROM v")
def agg_21(spark, d):
    """Sum of all valuations up to and with each; running, so no range join."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return src.table(spark, d, "orders").select(c("o_orderkey").alias("order_id"), F.round(F.sum("o_totalprice").over(w), 2).alias("value"))


@query("agg_29_member_redundancy", f"WITH {P}, m AS (SELECT match_id, avg(p_h) FILTER (model_version = 'F') AS f, avg(p_h) FILTER (model_version = 'O') AS o FROM preds GROUP BY 1) SELECT round(corr(f, o), 6) AS r, coalesce(corr(f, o) > 0.92, FALSE) AS redundant FROM m")
def agg_29(spark, d):
    m = src.predictions(spark, d).groupBy("match_id").agg(*[F.avg(F.when(c("model_version") == v, c("p_h"))).alias(v.lower()) for v in "FO"])
    return m.agg(r6(F.corr("f", "o")).alias("r"), F.coalesce(F.corr("f", "o") > 0.92, F.lit(False)).alias("redundant"))


@query("win_16_xg_trend", f"""WITH {src.SHOTS}, x AS (SELECT team, match_id, round(sum(xg), 6) AS xg FROM shots GROUP BY ALL HAVING round(sum(xg), 6) > 0), k AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY match_id) AS i FROM x),
v AS (SELECT team, match_id, count(*) OVER w AS n, avg(xg) OVER f AS five, avg(xg) OVER w AS ten, stddev_pop(xg) OVER w AS std, regr_slope(xg, i) OVER f AS slope FROM k WINDOW w AS (PARTITION BY team ORDER BY match_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY team ORDER BY match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT team, match_id, round(coalesce(five, 0), 6) AS mean_5, round(CASE WHEN n >= 5 THEN ten ELSE coalesce(five, 0) END, 6) AS mean_10, round(CASE WHEN n >= 5 THEN std ELSE 1 END, 6) AS consistency, round(CASE WHEN n >= 5 THEN slope ELSE 0 END, 6) AS trend FROM v""")
def win_16(spark, d, least=5):
    """Expected goals of the matches before: means of five and ten, their spread, and the slope of the last five in time order."""
    x = src.shots(spark, d).groupBy("team", "match_id").agg(r6(F.sum("xg")).alias("xg")).where("xg > 0")
    w = Window.partitionBy("team").orderBy("match_id")
    five, ten = w.rowsBetween(-5, -1), w.rowsBetween(-10, -1)
    enough = F.count("*").over(ten) >= least
    mean = F.coalesce(F.avg("xg").over(five), F.lit(0.0))
    k = x.withColumn("i", F.row_number().over(w))
    return k.select("team", "match_id", r6(mean).alias("mean_5"), r6(F.when(enough, F.avg("xg").over(ten)).otherwise(mean)).alias("mean_10"), r6(F.when(enough, F.stddev_pop("xg").over(ten)).otherwise(1.0)).alias("consistency"), r6(F.when(enough, F.regr_slope("xg", "i").over(five)).otherwise(0.0)).alias("trend"))


LINEAR = [1.5, 1.3, 1.1, 0.9, 0.7]


@query("win_22_linear_trend", f"WITH {T} SELECT match_id, team, round({lagged_sql('points', LINEAR)}, 4) AS trend FROM team_rows WINDOW w AS ({W_TEAM})")
def win_22(spark, d):
    return rows_of(spark, d).select("match_id", "team", F.round(lagged("points", LINEAR), 4).alias("trend"))


@query("win_25_home_last20", f"WITH {T} SELECT match_id, team, count(*) OVER w AS n, round(avg(gf) OVER w, 6) AS gf, round(avg((points = 3)::INT) OVER w, 6) AS win_rate FROM team_rows WHERE is_home WINDOW w AS ({W_TEAM} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)")
def win_25(spark, d):
    w = TEAM().rowsBetween(-20, -1)
    return rows_of(spark, d).where("is_home").select("match_id", "team", F.count("*").over(w).alias("n"), r6(F.avg("gf").over(w)).alias("gf"), r6(F.avg((c("points") == 3).cast("int")).over(w)).alias("win_rate"))


@query("win_26_team_stats", f"WITH {T} SELECT match_id, team, round(coalesce(sum(points) OVER w5 / 15.0::DOUBLE, 0.5), 6) AS form_5, round(coalesce(avg((points = 3)::INT) OVER w20, 0.4), 6) AS win_20 FROM team_rows WINDOW w5 AS ({W_TEAM} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), w20 AS ({W_TEAM} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)")
def win_26(spark, d):
    w5, w20 = TEAM().rowsBetween(-5, -1), TEAM().rowsBetween(-20, -1)
    return rows_of(spark, d).select("match_id", "team", r6(F.coalesce(F.sum("points").over(w5) / 15.0, F.lit(0.5))).alias("form_5"), r6(F.coalesce(F.avg((c("points") == 3).cast("int")).over(w20), F.lit(0.4))).alias("win_20"))


@query("win_30_short_trend", f"WITH {T}, k AS (SELECT match_id, team, count(*) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n, (lag(gf, 1) OVER w + lag(gf, 2) OVER w) / 2.0::DOUBLE - (lag(gf, 4) OVER w + lag(gf, 5) OVER w) / 2.0::DOUBLE AS gap FROM team_rows WINDOW w AS ({W_TEAM})) SELECT match_id, team, CASE WHEN gap IS NULL THEN 'insufficient' WHEN gap > 0.2 THEN 'up' WHEN gap < -0.2 THEN 'down' ELSE 'flat' END AS trend FROM k")
def win_30(spark, d):
    """The newest two against the fourth and fifth; the third is skipped."""
    at = lambda k: F.lag("gf", k).over(TEAM())
    k = rows_of(spark, d).withColumn("gap", (at(1) + at(2)) / 2.0 - (at(4) + at(5)) / 2.0)
    return k.select("match_id", "team", F.when(c("gap").isNull(), "insufficient").when(c("gap") > 0.2, "up").when(c("gap") < -0.2, "down").otherwise("flat").alias("trend"))


@query("win_38_own_minus_opponent", "WITH k AS (SELECT l_orderkey AS match_id, l_linenumber, l_partkey, l_suppkey, l_quantity - avg(l_quantity) OVER w AS gap, count(*) OVER w AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)) SELECT match_id, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN n = 2 THEN 2 * gap ELSE gap END, 6) AS edge FROM k WHERE n >= 2")
def win_38(spark, d):
    w = Window.partitionBy("l_orderkey")
    k = src.table(spark, d, "lineitem").withColumns({"gap": c("l_quantity") - F.avg("l_quantity").over(w), "n": F.count("*").over(w)}).where("n >= 2")
    return k.select(c("l_orderkey").alias("match_id"), "l_linenumber", "l_partkey", "l_suppkey", r6(F.when(c("n") == 2, 2 * c("gap")).otherwise(c("gap"))).alias("edge"))


@query("mkt_08_drift", f"WITH {N}, o AS (SELECT match_id, " + ", ".join(f"1 / arg_max(odds_{k}, {{'t': captured_at, 'a': snap_no, 'b': part_no, 'c': supp_no}}) - 1 / arg_min(odds_{k}, {{'t': captured_at, 'a': snap_no, 'b': part_no, 'c': supp_no}}) AS d_{k}" for k in "hda") + " FROM snaps GROUP BY 1) SELECT match_id, round(d_h, 5) AS d_h, round(d_d, 5) AS d_d, round(d_a, 5) AS d_a, CASE WHEN abs(d_h) >= abs(d_d) AND abs(d_h) >= abs(d_a) THEN 0 WHEN abs(d_d) >= abs(d_a) THEN 1 ELSE 2 END AS direction FROM o")
def mkt_08(spark, d):
    at = F.struct("captured_at", "snap_no", "part_no", "supp_no")
    o = src.snapshots(spark, d).groupBy("match_id").agg(*[(1 / F.max_by(f"odds_{k}", at) - 1 / F.min_by(f"odds_{k}", at)).alias(f"d_{k}") for k in "hda"])
    a = {k: F.abs(f"d_{k}") for k in "hda"}
    return o.select("match_id", *[F.round(f"d_{k}", 5).alias(f"d_{k}") for k in "hda"], F.when((a["h"] >= a["d"]) & (a["h"] >= a["a"]), 0).when(a["d"] >= a["a"], 1).otherwise(2).alias("direction"))


@query("mkt_09_favourite", f"WITH {N} SELECT {IDS_SQL}, CASE WHEN odds_h <= odds_d AND odds_h <= odds_a THEN 0 WHEN odds_d <= odds_a THEN 1 ELSE 2 END AS favourite, round(greatest(odds_h, odds_d, odds_a) / least(odds_h, odds_d, odds_a), 6) AS spread FROM snaps")
def mkt_09(spark, d):
    h, x, a = c("odds_h"), c("odds_d"), c("odds_a")
    return src.snapshots(spark, d).select(*IDS, F.when((h <= x) & (h <= a), 0).when(x <= a, 1).otherwise(2).alias("favourite"), r6(F.greatest(h, x, a) / F.least(h, x, a)).alias("spread"))


@query("mkt_12_expected_value", f"WITH {BOTH} SELECT {IDS_SQL}, round(p_d * odds_d - 1, 6) AS ev_d, round(p_a * (odds_a - 1) - (1 - p_a), 6) AS ev_a FROM j")
def mkt_12(spark, d):
    return joined(spark, d).select(*IDS, r6(mk.ev(c("p_d"), c("odds_d"))).alias("ev_d"), r6(c("p_a") * (c("odds_a") - 1) - (1 - c("p_a"))).alias("ev_a"))


@query("mkt_24_back_lay", f"WITH {N} SELECT {IDS_SQL}, round((odds_a - odds_h) / odds_h * 100, 6) AS spread_pct, odds_a > odds_h AS has_lay FROM snaps")
def mkt_24(spark, d):
    return src.snapshots(spark, d).select(*IDS, r6((c("odds_a") - c("odds_h")) / c("odds_h") * 100).alias("spread_pct"), (c("odds_a") > c("odds_h")).alias("has_lay"))


@query("mkt_29_single_book", f"WITH {N} SELECT {IDS_SQL} FROM snaps WHERE bookmaker < 2 QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY bookmaker, captured_at DESC, snap_no, part_no, supp_no) = 1")
def mkt_29(spark, d):
    order = [c("bookmaker"), F.desc("captured_at"), c("snap_no"), c("part_no"), c("supp_no")]
    return ops.latest(src.snapshots(spark, d).where("bookmaker < 2"), ["match_id"], order).select(*IDS)


@query("mkt_30_quality_score", f"WITH {BOTH} SELECT {IDS_SQL}, round(0.4::DOUBLE * least(1, greatest(0, p_h * odds_h - 1)) + 0.3::DOUBLE * confidence + 0.2::DOUBLE * (odds_h BETWEEN 1.5 AND 4)::INT + 0.1::DOUBLE * is_closing::INT, 6) AS quality FROM j")
def mkt_30(spark, d):
    score = 0.4 * mk.clamp(mk.ev(c("p_h"), c("odds_h")), 0, 1) + 0.3 * c("confidence") + 0.2 * c("odds_h").between(1.5, 4).cast("int") + 0.1 * c("is_closing").cast("int")
    return joined(spark, d).select(*IDS, r6(score).alias("quality"))


@query("mkt_34_abstaining_stake", f"WITH {BOTH} SELECT {IDS_SQL}, round(CASE WHEN confidence < 0.45 OR p_h * odds_h <= 1.02 THEN 0 ELSE least(0.05, greatest(0, ((odds_h - 1) * p_h - (1 - p_h)) / (odds_h - 1)) / 4) END, 6) AS stake FROM j")
def mkt_34(spark, d):
    abstain = (c("confidence") < 0.45) | (c("p_h") * c("odds_h") <= 1.02)
    return joined(spark, d).select(*IDS, r6(F.when(abstain, 0.0).otherwise(mk.kelly(c("p_h"), c("odds_h"), 0.25, 0.05))).alias("stake"))


STANDINGS = f"{T}, sums AS (SELECT league_id, team, sum(points) AS p, sum(gf - ga) AS gd, sum(gf) AS f FROM team_rows GROUP BY 1, 2), st AS (SELECT league_id, team, row_number() OVER (PARTITION BY league_id ORDER BY p DESC, gd DESC, f DESC, team) AS position FROM sums)"


@query("mkt_36_importance", f"WITH {STANDINGS} SELECT match_id, round(least(1, 0.4::DOUBLE + CASE WHEN least(h.position, a.position) <= 4 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN greatest(h.position, a.position) >= 18 THEN 0.3::DOUBLE ELSE 0 END), 6) AS importance FROM settled m JOIN st h ON h.league_id = m.league_id AND h.team = home_id JOIN st a ON a.league_id = m.league_id AND a.team = away_id")
def mkt_36(spark, d):
    m = src.matches(spark, d)
    st = ops.standings(m)
    side = lambda k: st.select("league_id", c("team").alias(f"{k}_id"), c("position").alias(f"{k}_pos"))
    j = ops.settled(m).join(side("home"), ["league_id", "home_id"]).join(side("away"), ["league_id", "away_id"])
    low, high = F.least("home_pos", "away_pos"), F.greatest("home_pos", "away_pos")
    return j.select("match_id", r6(F.least(F.lit(1.0), 0.4 + F.when(low <= 4, 0.3).otherwise(0.0) + F.when(high >= 18, 0.3).otherwise(0.0))).alias("importance"))


@query("mkt_37_tactical_edge", "SELECT o_orderkey, round(0.25::DOUBLE * (o_orderkey % 5) + 0.2::DOUBLE * (o_orderkey % 7) + 0.25::DOUBLE * (o_orderkey % 3) + 0.2::DOUBLE * (o_orderkey % 11) + 0.1::DOUBLE * (o_orderkey % 2), 6) AS edge FROM orders")
def mkt_37(spark, d):
    k = c("o_orderkey")
    return src.table(spark, d, "orders").select("o_orderkey", r6(sum((w * (k % m) for w, m in ((0.25, 5), (0.2, 7), (0.25, 3), (0.2, 11), (0.1, 2))), F.lit(0.0))).alias("edge"))


@query("mkt_39_value_flag", f"WITH {BOTH} SELECT {IDS_SQL}, p_h - 1 / odds_h / {TOTAL} > 0.03 AS value, CASE WHEN confidence >= 0.5 THEN 'low' WHEN confidence >= 0.4 THEN 'medium' ELSE 'high' END AS risk FROM j WHERE p_h >= p_d AND p_h >= p_a")
def mkt_39(spark, d):
    q = mk.proportional(c("odds_h"), c("odds_d"), c("odds_a"))[0]
    risk = F.when(c("confidence") >= 0.5, "low").when(c("confidence") >= 0.4, "medium").otherwise("high")
    return joined(spark, d).where("p_h >= p_d AND p_h >= p_a").select(*IDS, (c("p_h") - q > 0.03).alias("value"), risk.alias("risk"))


@query("mkt_40_league_edge", f"WITH {M}, {BOTH} SELECT league_id, count(*) AS bets, round(avg(least(CASE league_id WHEN '1-URGENT' THEN 0.03 ELSE 0.02 END, greatest(0, ((odds_h - 1) * p_h - (1 - p_h)) / (odds_h - 1)))), 6) AS stake FROM j JOIN matches USING (match_id) WHERE p_h - 1 / odds_h > 0.042 GROUP BY 1")
def mkt_40(spark, d):
    j = joined(spark, d).where(c("p_h") - 1 / c("odds_h") > 0.042).join(src.matches(spark, d).select("match_id", "league_id"), "match_id")
    cap = F.when(c("league_id") == "1-URGENT", 0.03).otherwise(0.02)
    return j.groupBy("league_id").agg(F.count("*").alias("bets"), r6(F.avg(F.least(cap, mk.kelly(c("p_h"), c("odds_h"))))).alias("stake"))


@query("evl_09_fold_series", f"WITH {SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY league_id ORDER BY match_date, match_id, snap_no, part_no, supp_no) - 1 AS i, count(*) OVER (PARTITION BY league_id) // 6 AS size FROM e), f AS (SELECT league_id, CAST(i // size AS BIGINT) AS fold, avg({HIT}) AS accuracy FROM k WHERE i // size BETWEEN 1 AND 5 GROUP BY ALL) SELECT league_id, fold, round(accuracy - lag(accuracy) OVER (PARTITION BY league_id ORDER BY fold), 6) AS change FROM f")
def evl_09(spark, d):
    w = Window.partitionBy("league_id")
    k = scored(spark, d).withColumn("fold", F.floor((F.row_number().over(w.orderBy("match_date", "match_id", "snap_no", "part_no", "supp_no")) - 1) / F.floor(F.count("*").over(w) / 6))).where("fold BETWEEN 1 AND 5")
    f = k.groupBy("league_id", "fold").agg(F.avg(hit()).alias("accuracy"))
    return f.select("league_id", "fold", r6(c("accuracy") - F.lag("accuracy").over(w.orderBy("fold"))).alias("change"))


@query("cal_04_skellam_draw", f"WITH {S}, t AS (SELECT league_id, round(avg(home_score), 6) AS lh, round(avg(away_score), 6) AS la FROM settled GROUP BY 1) SELECT league_id, round(sum(exp(-(lh + la)) * pow(lh * la, k) / (factorial(k::INT)::DOUBLE * factorial(k::INT)::DOUBLE)), 6) AS draw FROM t, range(16) AS r(k) GROUP BY 1")
def cal_04(spark, d, terms=16):
    """P(draw) = exp(-(a + b)) I0(2 sqrt(ab)); the Bessel function by its series, inside the expression."""
    t = ops.settled(src.matches(spark, d)).groupBy("league_id").agg(r6(F.avg("home_score")).alias("lh"), r6(F.avg("away_score")).alias("la"))
    ab = c("lh") * c("la")
    series = sum((F.pow(ab, F.lit(float(k))) / float(math.factorial(k)) ** 2 for k in range(terms)), F.lit(0.0))
    return t.select("league_id", r6(F.exp(-(c("lh") + c("la"))) * series).alias("draw"))


GOALS, TERMS = 2.65, 16


@query("cal_04_skellam_overlay", f"""WITH {SCORED}, z AS (SELECT p_h, p_d, p_a, y_h, y_d, y_a, count(*) AS n, {GOALS}::DOUBLE * p_h / (p_h + p_a) * {GOALS}::DOUBLE * p_a / (p_h + p_a) AS ab FROM e GROUP BY ALL),
k AS (SELECT *, exp(-{GOALS}::DOUBLE) * (SELECT sum(pow(ab, t) / (factorial(t::INT)::DOUBLE * factorial(t::INT)::DOUBLE)) FROM range({TERMS}) AS r(t)) AS draw FROM z),
g AS (SELECT a, n, y_h, y_d, y_a, p_h, p_a, (1 - a / 50.0::DOUBLE) * p_d + a / 50.0::DOUBLE * draw AS b FROM k, range(51) AS r(a)), s AS (SELECT *, p_h + b + p_a AS t FROM g),
v AS (SELECT a, sum(n * y_d * -ln(least(1 - 1e-9, greatest(1e-9, b / t)))) / sum(n * y_d) AS nll, sum(n * ((p_h / t - y_h) * (p_h / t - y_h) + (b / t - y_d) * (b / t - y_d) + (p_a / t - y_a) * (p_a / t - y_a))) / sum(n) AS brier,
 coalesce(2 * sum(n * y_d) FILTER (b > p_h AND b >= p_a) / nullif(coalesce(sum(n) FILTER (b > p_h AND b >= p_a), 0) + sum(n * y_d), 0), 0) AS f1 FROM s GROUP BY 1),
w AS (SELECT * FROM v ORDER BY round(nll, 9), a LIMIT 1) SELECT CASE WHEN w.f1 >= o.f1 AND w.brier <= o.brier THEN w.a / 50.0::DOUBLE ELSE 0 END AS alpha, round(w.a / 50.0::DOUBLE, 4) AS tried, w.f1 >= o.f1 AND w.brier <= o.brier AS passed, round(o.f1, 4) AS f1_before, round(w.f1, 4) AS f1_after, round(o.brier, 4) AS brier_before, round(w.brier, 4) AS brier_after FROM w, v o WHERE o.a = 0""")
def cal_04_overlay(spark, d, goals=GOALS, terms=TERMS):
    """The mixing weight of 51 with the least loss on draws, kept only if neither the draw F1 nor the Brier score gets worse."""
    z = scored(spark, d).groupBy("p_h", "p_d", "p_a", "y_h", "y_d", "y_a").agg(F.count("*").alias("n"))
    ab = goals * c("p_h") / (c("p_h") + c("p_a")) * goals * c("p_a") / (c("p_h") + c("p_a"))
    series = sum((F.pow("ab", F.lit(float(k))) / float(math.factorial(k)) ** 2 for k in range(terms)), F.lit(0.0))
    g = z.withColumn("ab", ab).withColumn("draw", math.exp(-goals) * series).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(50))))
    s = g.withColumn("b", (1 - c("a") / 50.0) * c("p_d") + c("a") / 50.0 * c("draw")).withColumn("t", c("p_h") + c("b") + c("p_a"))
    gap = lambda p, y: (p / c("t") - y) * (p / c("t") - y)
    called, draws = (c("b") > c("p_h")) & (c("b") >= c("p_a")), c("n") * c("y_d")
    nll = F.sum(draws * -F.ln(F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), c("b") / c("t"))))) / F.sum(draws)
    f1 = F.try_divide(2 * F.sum(F.when(called, draws).otherwise(0)), F.sum(F.when(called, c("n")).otherwise(0)) + F.sum(draws))
    v = s.groupBy("a").agg(nll.alias("nll"), (F.sum(c("n") * (gap(c("p_h"), c("y_h")) + gap(c("b"), c("y_d")) + gap(c("p_a"), c("y_a")))) / F.sum("n")).alias("brier"), F.coalesce(f1, F.lit(0.0)).alias("f1"))
    w = v.agg(F.min_by(F.struct("a", "f1", "brier"), F.struct(F.round("nll", 9), "a")).alias("w"), F.max(F.when(c("a") == 0, F.struct("f1", "brier"))).alias("o"))
    ok, alpha = (c("w.f1") >= c("o.f1")) & (c("w.brier") <= c("o.brier")), c("w.a") / 50.0
    return w.select(F.when(ok, alpha).otherwise(0.0).alias("alpha"), F.round(alpha, 4).alias("tried"), ok.alias("passed"), *[F.round(f"{t}.{x}", 4).alias(f"{x}_{n}") for x in ("f1", "brier") for t, n in (("o", "before"), ("w", "after"))])


@query("cal_07_softmax_meta", f"WITH {P}, z AS (SELECT {IDS_SQL}, exp(1.2::DOUBLE * ln(p_h) + 0.1::DOUBLE) AS a, exp(1.2::DOUBLE * ln(p_d) - 0.1::DOUBLE) AS b, exp(1.2::DOUBLE * ln(p_a)) AS k FROM preds) SELECT {IDS_SQL}, round(a / (a + b + k), 6) AS p_h, round(b / (a + b + k), 6) AS p_d FROM z")
def cal_07(spark, d):
    e = [F.exp(1.2 * F.ln(f"p_{k}") + b) for k, b in (("h", 0.1), ("d", -0.1), ("a", 0.0))]
    return src.predictions(spark, d).select(*IDS, r6(e[0] / (e[0] + e[1] + e[2])).alias("p_h"), r6(e[1] / (e[0] + e[1] + e[2])).alias("p_d"))


@query("cal_09_prior_smoothing", f"WITH {SCORED}, g AS (SELECT i / 36.0::DOUBLE AS alpha FROM range(36) AS r(i)), z AS (SELECT p_h * y_h + p_d * y_d + p_a * y_a AS q, count(*) AS n FROM e GROUP BY 1) SELECT round(alpha, 6) AS alpha, round(sum(-n * ln(greatest(1e-15, (1 - alpha) * q + alpha / 3))) / sum(n), 6) AS loss FROM z, g GROUP BY 1")
def cal_09(spark, d):
    z = scored(spark, d).groupBy((c("p_h") * c("y_h") + c("p_d") * c("y_d") + c("p_a") * c("y_a")).alias("q")).agg(F.count("*").alias("n"))
    g = z.withColumn("alpha", F.explode(F.array(*[F.lit(i / 36.0) for i in range(36)])))
    loss = -F.ln(F.greatest(F.lit(1e-15), (1 - c("alpha")) * c("q") + c("alpha") / 3))
    return g.groupBy(r6("alpha").alias("alpha")).agg(r6(F.sum(c("n") * loss) / F.sum("n")).alias("loss"))


KS = [("quantity", "l_quantity"), ("discount", "l_discount"), ("tax", "l_tax")]


@query("drf_03_dataset_drift", "WITH u AS (" + " UNION ALL ".join(f"SELECT '{n}' AS f, {v} AS v, (l_returnflag = 'R')::INT AS s FROM lineitem" for n, v in KS) + "), g AS (SELECT f, v, count(*) FILTER (s = 1) AS a, count(*) FILTER (s = 0) AS b FROM u GROUP BY ALL), k AS (SELECT f, abs(sum(a) OVER (PARTITION BY f ORDER BY v)::DOUBLE / sum(a) OVER (PARTITION BY f) - sum(b) OVER (PARTITION BY f ORDER BY v)::DOUBLE / sum(b) OVER (PARTITION BY f)) AS gap FROM g), m AS (SELECT f, max(gap) AS ks FROM k GROUP BY 1) SELECT count(*) AS features, count(*) FILTER (ks > 0.05) AS drifting, avg((ks > 0.05)::INT) >= 0.3 AS drift FROM m")
def drf_03(spark, d):
    li = src.table(spark, d, "lineitem").select("l_returnflag", *[v for _, v in KS]).unpivot(["l_returnflag"], [v for _, v in KS], "f", "v")
    g = li.groupBy("f", "v").agg(F.count_if(c("l_returnflag") == "R").alias("a"), F.count_if(c("l_returnflag") != "R").alias("b"))
    w = Window.partitionBy("f")
    cdf = lambda x: F.sum(x).over(w.orderBy("v")) / F.sum(x).over(w)
    m = g.withColumn("gap", F.abs(cdf("a") - cdf("b"))).groupBy("f").agg(F.max("gap").alias("ks"))
    return m.agg(F.count("*").alias("features"), F.count_if(c("ks") > 0.05).alias("drifting"), (F.avg((c("ks") > 0.05).cast("int")) >= 0.3).alias("drift"))


@query("drf_04_health_ladder", f"WITH {SCORED}, k AS (SELECT league_id, avg({HIT}) AS acc FROM e GROUP BY 1) SELECT league_id, CASE WHEN acc < 0.30 THEN 'critical' WHEN acc < 0.35 THEN 'degraded' ELSE 'healthy' END AS status FROM k")
def drf_04(spark, d):
    k = scored(spark, d).groupBy("league_id").agg(F.avg(hit()).alias("acc"))
    return k.select("league_id", F.when(c("acc") < 0.30, "critical").when(c("acc") < 0.35, "degraded").otherwise("healthy").alias("status"))


#: Name, factors and summands of the home and away rates.
SCENARIOS = [("base", 1.0, 0.0, 1.0, 0.0), ("red_card", 0.7, 0.0, 1.0, 0.25), ("storm", 0.85, 0.0, 0.85, 0.0), ("late_push", 1.0, 0.3, 1.0, 0.1)]


@query("sim_02_scenarios", f"""WITH {S}, t AS (SELECT league_id, round(avg(home_score), 6) AS lh, round(avg(away_score), 6) AS la FROM settled GROUP BY 1), s(name, hk, hb, ak, ab) AS (VALUES {', '.join(f"('{n}', " + ', '.join(f'{x}::DOUBLE' for x in v) + ')' for n, *v in SCENARIOS)}),
r AS (SELECT league_id, name, greatest(0.05, lh * hk + hb) AS lh, greatest(0.05, la * ak + ab) AS la FROM t, s), g AS (SELECT league_id, name, i, j, exp(-lh) * pow(lh, i) / factorial(i::INT) * exp(-la) * pow(la, j) / factorial(j::INT) AS p FROM r, range(11) AS a(i), range(11) AS b(j)),
k AS (SELECT league_id, name, sum(p) FILTER (i > j) / sum(p) AS home, sum(p) FILTER (i = j) / sum(p) AS draw, sum(p) FILTER (i < j) / sum(p) AS away FROM g GROUP BY ALL)
SELECT league_id, name, round(k.home, 6) AS home, round(k.draw, 6) AS draw, round(k.away, 6) AS away, round(k.home - b.home + 1e-9, 6) AS home_change, round(k.draw - b.draw + 1e-9, 6) AS draw_change, round(k.away - b.away + 1e-9, 6) AS away_change FROM k JOIN (SELECT * FROM k WHERE name = 'base') b USING (league_id)""".replace("SELECT league_id, name, round(k.home", "SELECT league_id, k.name, round(k.home"))
def sim_02(spark, d):
    """Outcome probabilities of a league under each scenario, and what it changes against the base."""
    t = ops.settled(src.matches(spark, d)).groupBy("league_id").agg(r6(F.avg("home_score")).alias("lh"), r6(F.avg("away_score")).alias("la"))
    s = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), *[F.lit(x).alias(k) for k, x in zip(("hk", "hb", "ak", "ab"), v)]) for n, *v in SCENARIOS]))
    rate = lambda lam, k, b: F.greatest(F.lit(0.05), c(lam) * c(k) + c(b))
    g = t.withColumn("s", s).select("league_id", "s.name", rate("lh", "s.hk", "s.hb").alias("lh"), rate("la", "s.ak", "s.ab").alias("la"))
    g = g.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(10)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(10))))
    pmf = lambda lam, k: F.exp(-c(lam)) * F.pow(lam, k) / F.factorial(k)
    g = g.withColumn("p", pmf("lh", "i") * pmf("la", "j"))
    part = lambda on: F.sum(F.when(on, c("p"))) / F.sum("p")
    k = g.groupBy("league_id", "name").agg(part(c("i") > c("j")).alias("home"), part(c("i") == c("j")).alias("draw"), part(c("i") < c("j")).alias("away"))
    base = lambda x: F.max(F.when(c("name") == "base", c(x))).over(Window.partitionBy("league_id"))
    return k.select("league_id", "name", *[r6(x).alias(x) for x in ("home", "draw", "away")], *[r6(c(x) - base(x) + 1e-9).alias(f"{x}_change") for x in ("home", "draw", "away")])


@query("ent_03_alias_map", "SELECT n_nationkey, CASE n_name WHEN 'UNITED STATES' THEN 'usa' WHEN 'UNITED KINGDOM' THEN 'uk' ELSE lower(n_name) END AS name FROM nation")
def ent_03(spark, d):
    aliases = F.create_map(*map(F.lit, ("UNITED STATES", "usa", "UNITED KINGDOM", "uk")))
    return src.table(spark, d, "nation").select("n_nationkey", F.coalesce(F.try_element_at(aliases, c("n_name")), F.lower("n_name")).alias("name"))


@query("ent_10_json_hash", "SELECT s_suppkey, sha256('{\"name\":\"' || s_name || '\",\"nation\":' || s_nationkey || '}') AS hash FROM supplier")
def ent_10(spark, d):
    return src.table(spark, d, "supplier").select("s_suppkey", F.sha2(F.to_json(F.struct(c("s_name").alias("name"), c("s_nationkey").alias("nation"))), 256).alias("hash"))


@query("txt_05_descriptor", f"WITH {S} SELECT match_id, 'team ' || home_id || ' ' || home_score || '-' || away_score || ' team ' || away_id || CASE WHEN home_score + away_score > 4 THEN ' (goal fest)' WHEN home_score + away_score = 0 THEN ' (goalless)' ELSE '' END AS text FROM settled")
def txt_05(spark, d):
    goals = c("home_score") + c("away_score")
    return ops.settled(src.matches(spark, d)).select("match_id", F.concat(F.format_string("team %d %d-%d team %d", "home_id", "home_score", "away_score", "away_id"), F.when(goals > 4, " (goal fest)").when(goals == 0, " (goalless)").otherwise("")).alias("text"))


@query("aud_07_season_remap", f"WITH {M} SELECT match_id, (year(match_date) - (month(match_date) < 7)::INT) || '/' || (year(match_date) - (month(match_date) < 7)::INT + 1) AS season, CASE league_id WHEN '4-NOT SPECIFIED' THEN '5-LOW' ELSE league_id END AS league_id FROM matches")
def aud_07(spark, d):
    y = F.year("match_date") - (F.month("match_date") < 7).cast("int")
    return src.matches(spark, d).select("match_id", F.format_string("%d/%d", y, y + 1).alias("season"), F.when(c("league_id") == "4-NOT SPECIFIED", "5-LOW").otherwise(c("league_id")).alias("league_id"))


@query("srt_01_date_id", f"WITH {M} SELECT match_id, row_number() OVER (PARTITION BY league_id ORDER BY match_date, match_id) AS place FROM matches")
def srt_01(spark, d):
    return src.matches(spark, d).select("match_id", F.row_number().over(Window.partitionBy("league_id").orderBy("match_date", "match_id")).cast("long").alias("place"))


@query("srt_02_nulls_last", f"WITH {M} SELECT match_id, row_number() OVER (PARTITION BY league_id ORDER BY CASE WHEN match_id % 3 > 0 THEN match_date END NULLS LAST, match_id) AS place FROM matches")
def srt_02(spark, d):
    day = F.when(c("match_id") % 3 > 0, c("match_date"))
    return src.matches(spark, d).select("match_id", F.row_number().over(Window.partitionBy("league_id").orderBy(day.asc_nulls_last(), "match_id")).cast("long").alias("place"))


@query("srt_03_mixed_rank", f"WITH {T} SELECT match_id, team, row_number() OVER (PARTITION BY league_id, team ORDER BY points DESC, gf - ga DESC, match_date, match_id) AS place FROM team_rows")
def srt_03(spark, d):
    w = Window.partitionBy("league_id", "team").orderBy(F.desc("points"), F.desc(c("gf") - c("ga")), "match_date", "match_id")
    return rows_of(spark, d).select("match_id", "team", F.row_number().over(w).cast("long").alias("place"))


@query("top_04_best_model", f"WITH {SCORED}, k AS (SELECT model_version, avg({BRIER}) AS b FROM e GROUP BY 1) SELECT model_version, round(b, 6) AS brier FROM k ORDER BY round(b, 9), model_version LIMIT 1")
def top_04(spark, d):
    k = scored(spark, d).groupBy("model_version").agg(F.avg(brier()).alias("b"))
    return k.orderBy(F.round("b", 9), "model_version").limit(1).select("model_version", r6("b").alias("brier"))


@query("fn_01_strings", "SELECT p_partkey, regexp_replace(lower(p_name), '^(the|fc|afc) | (fc|afc|cf)$', '') AS bare, len(list_distinct(string_split(lower(p_name), ' '))) AS words FROM part")
def fn_01(spark, d):
    name = F.lower("p_name")
    return src.table(spark, d, "part").select("p_partkey", F.expr("regexp_replace(lower(p_name), '^(the|fc|afc) | (fc|afc|cf)$', '')").alias("bare"), F.size(F.array_distinct(F.split(name, " "))).cast("long").alias("words"))


@query("fn_04_season_phase", f"WITH {M}, k AS (SELECT match_id, month(match_date) AS m FROM matches) SELECT match_id, CASE WHEN m IN (8, 9, 10) THEN 0 WHEN m IN (11, 12, 1) THEN 1 WHEN m IN (2, 3, 4) THEN 2 ELSE 3 END::BIGINT AS by_season, ((m - 1) // 3)::BIGINT AS by_quarter, round((m - 1) / 11.0::DOUBLE, 6) AS by_year FROM k")
def fn_04(spark, d):
    """Three definitions that don't agree: thirds of the season and its end, quarters of the year, the share of the year that is gone."""
    m = F.month("match_date")
    season = F.when(m.isin(8, 9, 10), 0).when(m.isin(11, 12, 1), 1).when(m.isin(2, 3, 4), 2).otherwise(3)
    return src.matches(spark, d).select("match_id", season.cast("long").alias("by_season"), F.floor((m - 1) / 3).alias("by_quarter"), F.round((m - 1) / 11.0, 6).alias("by_year"))


@query("fn_05_math", "SELECT o_orderkey, round(1 / (1 + exp(-(o_orderkey % 9 - 4) / 2.0::DOUBLE)), 6) AS logistic, round(exp(-2.0::DOUBLE) * pow(2, o_orderkey % 6) / factorial((o_orderkey % 6)::INT), 6) AS poisson FROM orders")
def fn_05(spark, d):
    k = c("o_orderkey")
    return src.table(spark, d, "orders").select("o_orderkey", r6(1 / (1 + F.exp(-(k % 9 - 4) / 2.0))).alias("logistic"), r6(F.exp(F.lit(-2.0)) * F.pow(F.lit(2.0), k % 6) / F.factorial((k % 6).cast("int"))).alias("poisson"))


@query("fn_07_json", "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS other FROM events")
def fn_07(spark, d):
    return src.table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(-1)).alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("other"))


@query("fn_09_interactions", f"WITH {P} SELECT {IDS_SQL}, round(p_h / (p_a + 1e-6), 5) AS ratio, round(p_h * p_d, 6) AS product, (p_h > p_a) = (p_h > 0.4) AS agree FROM preds")
def fn_09(spark, d):
    return src.predictions(spark, d).select(*IDS, F.round(c("p_h") / (c("p_a") + 1e-6), 5).alias("ratio"), r6(c("p_h") * c("p_d")).alias("product"), ((c("p_h") > c("p_a")) == (c("p_h") > 0.4)).alias("agree"))


@query("fn_10_last5_from_rates", "SELECT o_orderkey, round_even((o_orderkey % 11) / 10.0::DOUBLE * 5, 0)::BIGINT AS wins FROM orders")
def fn_10(spark, d):
    """Half-even rounding, as in Python."""
    return src.table(spark, d, "orders").select("o_orderkey", F.bround((c("o_orderkey") % 11) / 10.0 * 5, 0).cast("long").alias("wins"))


@query("fn_11_position", f"WITH {STANDINGS} SELECT league_id, team, position <= 6 AS top_6, position > 14 AS bottom_6, position <= 4 OR position >= 18 AS pressure FROM st")
def fn_11(spark, d):
    return ops.standings(src.matches(spark, d)).select("league_id", "team", (c("position") <= 6).alias("top_6"), (c("position") > 14).alias("bottom_6"), ((c("position") <= 4) | (c("position") >= 18)).alias("pressure"))


@query("fn_12_value_share", f"WITH {M}, v AS (SELECT c_custkey % 20 AS team, sum(c_acctbal + 2000) AS v FROM customer GROUP BY 1) SELECT match_id, round(h.v / (h.v + a.v), 6) AS home_share FROM matches JOIN v h ON h.team = home_id JOIN v a ON a.team = away_id")
def fn_12(spark, d):
    v = src.table(spark, d, "customer").groupBy((c("c_custkey") % 20).alias("team")).agg(F.sum(c("c_acctbal") + 2000).alias("v"))
    side = lambda k: v.select(c("team").alias(f"{k}_id"), c("v").alias(f"{k}_v"))
    return src.matches(spark, d).join(side("home"), "home_id").join(side("away"), "away_id").select("match_id", r6(c("home_v") / (c("home_v") + c("away_v"))).alias("home_share"))


@query("fn_14_spatial_flags", f"WITH {src.SHOTS} SELECT seq, x >= 80 AS final_third, least(11, x // 10) AS gx, least(7, y // 10) AS gy FROM shots")
def fn_14(spark, d):
    return src.shots(spark, d).select("seq", (c("x") >= 80).alias("final_third"), F.least(F.lit(11), F.floor(c("x") / 10)).alias("gx"), F.least(F.lit(7), F.floor(c("y") / 10)).alias("gy"))


@query("fn_15_category_codes", "WITH k AS (SELECT DISTINCT o_orderstatus AS v FROM orders) SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM k")
def fn_15(spark, d):
    """Codes over the distinct values, which are few."""
    k = src.table(spark, d, "orders").select(c("o_orderstatus").alias("v")).distinct()
    return k.select("v", F.row_number().over(Window.orderBy("v")).cast("long").alias("code") - 1).toDF("v", "code")


@query("str_12_staleness", f"WITH {M}, {N} SELECT match_id, count(*) FILTER (captured_at >= match_date - INTERVAL 30 DAY AND captured_at < match_date) AS fresh FROM snaps JOIN matches USING (match_id) GROUP BY 1")
def str_12(spark, d):
    j = src.snapshots(spark, d).join(src.matches(spark, d).select("match_id", "match_date"), "match_id")
    ok = (c("captured_at") >= c("match_date") - F.expr("INTERVAL 30 DAYS")) & (c("captured_at") < c("match_date"))
    return j.groupBy("match_id").agg(F.count_if(ok).alias("fresh"))


@query("siml_02_analog_blend", """WITH q AS (SELECT vec_id AS query_id, label AS base, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, label, list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]) AS s FROM q JOIN embeddings ON vec_id <> query_id),
k AS (SELECT query_id, count(*) FILTER (s >= 0.7) AS analogs, sum(s * label) FILTER (s >= 0.7) / nullif(sum(s) FILTER (s >= 0.7), 0) AS weighted, 1 - stddev_pop(label) FILTER (s >= 0.7) AS agreement, avg(s) FILTER (s >= 0.7) AS near, max(s) AS best FROM s GROUP BY 1)
SELECT query_id, analogs, round(coalesce(weighted, base), 5) AS analog, round(0.7 * base + 0.3 * coalesce(weighted, base), 5) AS blend, round(coalesce(agreement * near, 0), 5) AS boost, analogs < 3 OR best < 0.6 AS novel FROM k JOIN q USING (query_id)""")
def siml_02(spark, d, least=0.7, share=0.3):
    """A query's own value blended with the similarity-weighted mean of its analogs; without any the value stays."""
    e = src.table(spark, d, "embeddings").select("vec_id", "label", c("embedding").cast("array<double>").alias("e"))
    s = sim.scored(e, e.where("vec_id % 100 = 0"), "vec_id", "e", sim.cosines, sim.analogs(least), sim.ANALOGS, "label").withColumn("best", F.when(~F.isnan("best"), c("best")))
    g = s.groupBy("query_id").agg(*[F.sum(x).alias(x) for x in ("n", "near", "told", "weighted", "values", "squares")], F.max("best").alias("best"))
    # labels are whole numbers, so these sums are exact
    spread = F.sqrt(F.try_divide(c("told") * c("squares") - c("values") * c("values"), c("told") * c("told")))
    weighted = F.when(c("told") > 0, F.try_divide(c("weighted"), c("near")))
    g = g.select("query_id", c("n").alias("analogs"), weighted.alias("weighted"), (1 - spread).alias("agreement"), F.try_divide("near", "n").alias("near"), "best")
    k = g.join(e.select(c("vec_id").alias("query_id"), c("label").alias("base")), "query_id").withColumn("analog", F.coalesce("weighted", "base"))
    return k.select("query_id", "analogs", F.round("analog", 5).alias("analog"), F.round((1 - share) * c("base") + share * c("analog"), 5).alias("blend"), F.round(F.coalesce(c("agreement") * c("near"), F.lit(0.0)), 5).alias("boost"), ((c("analogs") < 3) | (c("best") < 0.6)).alias("novel"))


@query("snk_03_new_ids", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def snk_03(spark, d):
    have = src.table(spark, d, "lineitem").where("l_returnflag = 'A'").select(c("l_orderkey").alias("id"))
    return src.table(spark, d, "orders").select(c("o_orderkey").alias("id")).join(have, "id", "left_anti")


@query("siml_03_outliers", "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, list_distance(e, embedding::DOUBLE[]) AS d FROM q JOIN embeddings ON vec_id <> query_id) SELECT query_id, round(min(d), 5) AS nearest, round(avg(d), 5) AS mean, (min(d) - avg(d)) / stddev_pop(d) > 2 AS outlier FROM s GROUP BY 1")
def siml_03(spark, d):
    e = src.table(spark, d, "embeddings").select("vec_id", c("embedding").cast("array<double>").alias("e"))
    s = sim.gathered(sim.scored(e, e.where("vec_id % 100 = 0"), "vec_id", "e", sim.distances, sim.spread, sim.SPREAD))
    return s.select("query_id", F.round("nearest", 5).alias("nearest"), F.round("mean", 5).alias("mean"), (F.try_divide(c("nearest") - c("mean"), c("sd")) > 2).alias("outlier"))


@query("txt_06_narrative", f"WITH {T}, k AS (SELECT team, league_id, count(*) FILTER (points = 3) AS w, count(*) AS n FROM team_rows GROUP BY ALL) SELECT league_id, team, printf('Team %d won %d of %d', team, w, n) || CASE WHEN w * 2 > n THEN ', a strong side.' ELSE '.' END AS text FROM k")
def txt_06(spark, d):
    k = rows_of(spark, d).groupBy("league_id", "team").agg(F.count_if(c("points") == 3).alias("w"), F.count("*").alias("n"))
    return k.select("league_id", "team", F.concat(F.format_string("Team %d won %d of %d", "team", "w", "n"), F.when(c("w") * 2 > c("n"), ", a strong side.").otherwise(".")).alias("text"))


@query("aud_05_repair_manifest", f"WITH {M}, b AS (SELECT league_id, count(*) AS n, string_agg(CAST(match_id AS VARCHAR), ',' ORDER BY match_id) AS ids FROM matches WHERE status = 'postponed' GROUP BY 1) SELECT league_id, n, sha256(ids) AS plan_hash FROM b")
def aud_05(spark, d):
    """A league's pending repairs and the hash of their ordered ids (the few postponed matches)."""
    b = src.matches(spark, d).where("status = 'postponed'").groupBy("league_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("match_id")).alias("ids"))
    return b.select("league_id", "n", F.sha2(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), 256).alias("plan_hash"))


CONTRACT = [("gf_avg", "form", "team", "required"), ("rest_days", "fatigue", "team", "default"), ("odds_h", "market", "match", "required"), ("attack_diff", "rating", "match", "default")]


@query("aud_10_feature_contract", "SELECT name, grp, scope, disposition, sha256(name || '|' || grp || '|' || scope || '|' || disposition) AS row_hash FROM (VALUES " + ", ".join(str(r) for r in CONTRACT) + ") AS t(name, grp, scope, disposition)")
def aud_10(spark, d):
    rows = spark.createDataFrame(CONTRACT, "name string, grp string, scope string, disposition string")
    return rows.withColumn("row_hash", F.sha2(F.concat_ws("|", "name", "grp", "scope", "disposition"), 256))


#: A league's scale of values and its short rest in days; leagues without a pack take the default.
PACK = {"1-URGENT": (60000.0, 4), "2-HIGH": (100.0, 3), "3-MEDIUM": (30.0, 5)}
PACK_DEFAULT = (1.0, 4)


@query("fn_13_league_pack", f"WITH {M}, k(league_id, scale, rest) AS (VALUES " + ", ".join(f"('{k}', {s}::DOUBLE, {r})" for k, (s, r) in PACK.items()) + f") SELECT match_id, round((match_id % 50000) / coalesce(scale, {PACK_DEFAULT[0]}::DOUBLE), 6) AS scaled, match_id % 7 < coalesce(rest, {PACK_DEFAULT[1]}) AS short_rest FROM matches LEFT JOIN k USING (league_id)")
def fn_13(spark, d):
    """A league's constants come from one small parameter table; no league is dropped."""
    k = spark.createDataFrame([(n, s, r) for n, (s, r) in PACK.items()], "league_id string, scale double, rest int")
    j = src.matches(spark, d).join(F.broadcast(k), "league_id", "left")
    return j.select("match_id", r6(c("match_id") % 50000 / F.coalesce("scale", F.lit(PACK_DEFAULT[0]))).alias("scaled"), (c("match_id") % 7 < F.coalesce("rest", F.lit(PACK_DEFAULT[1]))).alias("short_rest"))


@query("fn_16_team_table", "SELECT n_nationkey AS team, round(50 + n_nationkey * 1.5::DOUBLE, 4) AS attack, round(80 - n_nationkey * 0.75::DOUBLE, 4) AS defence, n_nationkey > 12 AS top_half FROM nation")
def fn_16(spark, d):
    k = c("n_nationkey")
    return src.table(spark, d, "nation").select(k.alias("team"), F.round(50 + k * 1.5, 4).alias("attack"), F.round(80 - k * 0.75, 4).alias("defence"), (k > 12).alias("top_half"))


@query("src_13_read_through", "SELECT o_orderkey AS id, coalesce(l.q, o_totalprice) AS v, CASE WHEN l.q IS NULL THEN 'remote' ELSE 'local' END AS origin FROM orders LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS q FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey")
def src_13(spark, d):
    """Local rows take precedence over remote ones."""
    local = src.table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("id")).agg(F.max("l_quantity").alias("q"))
    o = src.table(spark, d, "orders").select(c("o_orderkey").alias("id"), "o_totalprice")
    return o.join(local, "id", "left").select("id", F.coalesce("q", "o_totalprice").alias("v"), F.when(c("q").isNull(), "remote").otherwise("local").alias("origin"))


@query("snk_01_sorted_write", f"WITH {S} SELECT match_id, league_id FROM settled")
def snk_01(spark, d):
    from touchline.sources.files import write_sorted
    from touchline.sources.scratch import scratch

    path = scratch(spark, "sorted")
    write_sorted(ops.settled(src.matches(spark, d)).select("match_id", "league_id"), path, "league_id", ["match_id"])
    return spark.read.parquet(path).select("match_id", "league_id")


@query("str_09_clv_pass", f"WITH {S}, {N} SELECT match_id, count(*) AS captured FROM snaps JOIN settled USING (match_id) WHERE is_closing AND captured_at < match_date AND captured_at >= match_date - INTERVAL 10 DAY GROUP BY 1")
def str_09(spark, d):
    """Due closings, streamed against the static fixtures."""
    from touchline.streaming import live

    m = ops.settled(src.matches(spark, d)).select("match_id", "match_date")
    s = live.event_stream(spark, f"{d}/lineitem.parquet").where("l_returnflag = 'R'").select(c("l_orderkey").alias("match_id"), "l_shipdate")
    due = live.on_time(s, m, "match_id", "l_shipdate", "match_date").where(c("l_shipdate") >= c("match_date") - F.expr("INTERVAL 10 DAYS"))
    return live.run_once(due.groupBy("match_id").agg(F.count("*").alias("captured")), "complete", "clv")


@query("str_10_settlement", f"WITH {S} SELECT league_id, count(*) AS settled, CAST(sum(home_score + away_score) AS BIGINT) AS goals FROM settled GROUP BY 1")
def str_10(spark, d):
    """Results streamed in, settled and summed by league."""
    from touchline.streaming import live

    o = live.event_stream(spark, f"{d}/orders.parquet").where("o_orderstatus = 'F'")
    goals = (F.floor("o_totalprice") % 5 + F.floor(c("o_totalprice") / 7) % 4).cast("long")
    return live.run_once(o.groupBy(c("o_orderpriority").alias("league_id")).agg(F.count("*").alias("settled"), F.sum(goals).alias("goals")), "complete", "settlement")
