"""Time-ordered features (WIN). Windows see strictly earlier matches unless ``parity`` asks
for the reference behaviour that includes the current row. Order: date, then match_id."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.operators import matches as ops
from touchline.plans.registry import query
from touchline.sources import adapters as src

S, T, SH = src.SETTLED, src.TEAM_ROWS, src.SHOTS


def rows_of(spark, d):
    return ops.team_rows(ops.settled(src.matches(spark, d)))


def by(*keys):
    return Window.partitionBy(*keys).orderBy("match_date", "match_id")


def r6(c):
    return F.round(c, 6)


# windows are made when a query is, since that needs a session
SIDE, TEAM = (lambda: by("league_id", "team", "is_home")), (lambda: by("league_id", "team"))
W_SIDE = "PARTITION BY league_id, team, is_home ORDER BY match_date, match_id"
W_TEAM = "PARTITION BY league_id, team ORDER BY match_date, match_id"


@query("win_02_venue_form", f"WITH {T} SELECT match_id, team, round(coalesce(avg(points) OVER w, 1.5), 6) AS form, count(*) FILTER (points = 3) OVER w AS wins, count(*) FILTER (points = 1) OVER w AS draws, count(*) FILTER (points = 0) OVER w AS losses FROM team_rows WINDOW w AS ({W_SIDE} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")
def win_02(spark, d):
    w = SIDE().rowsBetween(-5, -1)
    return rows_of(spark, d).select("match_id", "team", r6(F.coalesce(F.avg("points").over(w), F.lit(1.5))).alias("form"), *[F.count_if(F.col("points") == v).over(w).alias(k) for k, v in (("wins", 3), ("draws", 1), ("losses", 0))])


@query("win_03_venue_goals", f"WITH {T} SELECT match_id, team, round(coalesce(avg(gf) OVER w, CASE WHEN is_home THEN 1.5 ELSE 1.0 END), 6) AS gf_avg, round(coalesce(avg(ga) OVER w, 1.5), 6) AS ga_avg FROM team_rows WINDOW w AS ({W_SIDE} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")
def win_03(spark, d):
    w = SIDE().rowsBetween(-5, -1)
    return rows_of(spark, d).select("match_id", "team", r6(F.coalesce(F.avg("gf").over(w), F.when(F.col("is_home"), 1.5).otherwise(1.0))).alias("gf_avg"), r6(F.coalesce(F.avg("ga").over(w), F.lit(1.5))).alias("ga_avg"))


PAIR = "PARTITION BY least(home_id, away_id), greatest(home_id, away_id) ORDER BY match_date, match_id"


def pair_window(a, b):
    return Window.partitionBy(F.least("home_id", "away_id"), F.greatest("home_id", "away_id")).orderBy("match_date", "match_id").rowsBetween(a, b)


LOW_WINS = "((home_score > away_score) = (home_id < away_id) AND home_score <> away_score)"


def low_wins():
    h, a = F.col("home_score"), F.col("away_score")
    return ((h > a) == (F.col("home_id") < F.col("away_id"))) & (h != a)


@query("win_04_h2h_last5", f"WITH {S} SELECT match_id, count(*) OVER w AS n, count(*) FILTER ({LOW_WINS}) OVER w AS low_wins, count(*) FILTER (home_score = away_score) OVER w AS draws FROM settled WINDOW w AS ({PAIR} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")
def win_04(spark, d):
    w = pair_window(-5, -1)
    return ops.settled(src.matches(spark, d)).select("match_id", F.count("*").over(w).alias("n"), F.count_if(low_wins()).over(w).alias("low_wins"), F.count_if(F.col("home_score") == F.col("away_score")).over(w).alias("draws"))


@query("win_05_venue_record", f"WITH {T} SELECT match_id, team, round(coalesce(avg((points = 3)::INT) OVER w, 0.46), 6) AS win_rate, round(coalesce(avg((points = 1)::INT) OVER w, 0.26), 6) AS draw_rate, round(coalesce(avg((points = 0)::INT) OVER w, 0.28), 6) AS loss_rate, round(coalesce(avg((points = 3)::INT - (points = 0)::INT) OVER w, 0.18), 6) AS strength FROM team_rows WHERE is_home WINDOW w AS ({W_SIDE} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)")
def win_05(spark, d):
    """A home side's last ten at home: rates, and wins less losses a match."""
    w = SIDE().rowsBetween(-10, -1)
    is_ = lambda v: (F.col("points") == v).cast("int")
    mean = lambda x, default: r6(F.coalesce(F.avg(x).over(w), F.lit(default)))
    return rows_of(spark, d).where("is_home").select("match_id", "team", mean(is_(3), 0.46).alias("win_rate"), mean(is_(1), 0.26).alias("draw_rate"), mean(is_(0), 0.28).alias("loss_rate"), mean(is_(3) - is_(0), 0.18).alias("strength"))


#: The eight statistics of a team's match that are rolled.
ROLLED = {"gf": "gf", "ga": "ga", "gd": "gf - ga", "total": "gf + ga", "points": "points", "won": "CAST(points = 3 AS INT)", "clean": "CAST(ga = 0 AS INT)", "both": "CAST(gf > 0 AND ga > 0 AS INT)"}
SIZES = (3, 5, 10)


def rolling(spark, d, parity):
    last = 0 if parity else -1
    k = rows_of(spark, d).select("league_id", "match_date", "match_id", "team", *[F.expr(x).alias(f"v_{n}") for n, x in ROLLED.items()])
    cols = []
    for size in SIZES:
        w = TEAM().rowsBetween(last - size + 1, last)
        for n in ROLLED:
            v = F.col(f"v_{n}")
            cols += [r6(F.avg(v).over(w)).alias(f"{n}_avg_{size}"), r6(F.coalesce(F.stddev_samp(v).over(w), F.lit(0.0))).alias(f"{n}_std_{size}"), F.max(v).over(w).alias(f"{n}_max_{size}"), F.min(v).over(w).alias(f"{n}_min_{size}")]
    return k.select("match_id", "team", *cols)


def rolling_sql(parity):
    frame = lambda n: f"({W_TEAM} ROWS BETWEEN {n - 1 if parity else n} PRECEDING AND {'CURRENT ROW' if parity else '1 PRECEDING'})"
    cols = ", ".join(f"round(avg({x}) OVER w{s}, 6) AS {n}_avg_{s}, round(coalesce(stddev_samp({x}) OVER w{s}, 0), 6) AS {n}_std_{s}, max({x}) OVER w{s} AS {n}_max_{s}, min({x}) OVER w{s} AS {n}_min_{s}" for s in SIZES for n, x in ROLLED.items())
    return f"WITH {T} SELECT match_id, team, {cols} FROM team_rows WINDOW " + ", ".join(f"w{n} AS {frame(n)}" for n in SIZES)


@query("win_06_rolling", rolling_sql(False))
def win_06(spark, d):
    return rolling(spark, d, False)


@query("win_06_rolling_parity", rolling_sql(True))
def win_06_parity(spark, d):
    return rolling(spark, d, True)


@query("win_07_points_trend", f"WITH {T}, k AS (SELECT *, row_number() OVER ({W_TEAM}) AS i FROM team_rows) SELECT match_id, team, " + ", ".join(f"round(avg(points) OVER w{n}, 6) AS mean_{n}" for n in SIZES) + f", round(CASE WHEN count(*) OVER w5 >= 2 THEN regr_slope(points, i) OVER w5 ELSE 0 END, 6) AS slope_5 FROM k WINDOW " + ", ".join(f"w{n} AS ({W_TEAM} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in SIZES))
def win_07(spark, d):
    """The reference includes the current match here; points are each side's own."""
    w = {n: TEAM().rowsBetween(1 - n, 0) for n in SIZES}
    k = rows_of(spark, d).withColumn("i", F.row_number().over(TEAM()))
    slope = F.when(F.count("*").over(w[5]) >= 2, F.regr_slope("points", "i").over(w[5])).otherwise(0.0)
    return k.select("match_id", "team", *[r6(F.avg("points").over(w[n])).alias(f"mean_{n}") for n in SIZES], r6(slope).alias("slope_5"))


H2H = {"home": "home_score > away_score", "draw": "home_score = away_score", "away": "home_score < away_score"}


@query("win_08_h2h_all", f"WITH {S} SELECT match_id, count(*) OVER w AS n, " + ", ".join(f"count(*) FILTER ({x}) OVER w AS {n}_results, round(coalesce(avg(({x})::INT) OVER w, 0), 6) AS {n}_pct" for n, x in H2H.items()) + f", round(avg(home_score + away_score) OVER w, 6) AS avg_goals FROM settled WINDOW w AS ({PAIR} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def win_08(spark, d):
    """All earlier meetings of a pair: results as they were for the home side of the day, whichever that was."""
    w = pair_window(Window.unboundedPreceding, -1)
    each = [x for n, e in H2H.items() for x in (F.count_if(F.expr(e)).over(w).alias(f"{n}_results"), r6(F.coalesce(F.avg(F.expr(e).cast("int")).over(w), F.lit(0.0))).alias(f"{n}_pct"))]
    return ops.settled(src.matches(spark, d)).select("match_id", F.count("*").over(w).alias("n"), *each, r6(F.avg(F.col("home_score") + F.col("away_score")).over(w)).alias("avg_goals"))


@query("win_09_rest", f"WITH {T}, r AS (SELECT match_id, is_home, coalesce(date_diff('day', lag(match_date) OVER w, match_date), 7) AS rest FROM team_rows WINDOW w AS ({W_TEAM})) SELECT match_id, max(rest) FILTER (is_home) AS home_rest, max(rest) FILTER (NOT is_home) AS away_rest, max(rest) FILTER (is_home) - max(rest) FILTER (NOT is_home) AS rest_advantage FROM r GROUP BY 1")
def win_09(spark, d):
    """Days since each side's last match (7 before the first), and the home side's less the away side's."""
    rest = F.coalesce(F.datediff("match_date", F.lag("match_date").over(TEAM())), F.lit(7)).cast("long")
    r = rows_of(spark, d).select("match_id", "is_home", rest.alias("rest"))
    g = r.groupBy("match_id").agg(F.max(F.when(F.col("is_home"), F.col("rest"))).alias("home_rest"), F.max(F.when(~F.col("is_home"), F.col("rest"))).alias("away_rest"))
    return g.withColumn("rest_advantage", F.col("home_rest") - F.col("away_rest"))


@query("win_10_congestion", f"WITH {T} SELECT match_id, team, " + ", ".join(f"count(*) OVER (PARTITION BY league_id, team ORDER BY match_date RANGE BETWEEN INTERVAL {n - 1} DAY PRECEDING AND CURRENT ROW) AS in_{n}" for n in (7, 14, 30)) + " FROM team_rows")
def win_10(spark, d):
    day = Window.partitionBy("league_id", "team").orderBy(F.unix_date(F.to_date("match_date")))
    return rows_of(spark, d).select("match_id", "team", *[F.count("*").over(day.rangeBetween(-(n - 1), 0)).alias(f"in_{n}") for n in (7, 14, 30)])


@query("win_11_streak", f"WITH {T}, k AS (SELECT *, row_number() OVER ({W_TEAM}) AS i, coalesce(max(CASE WHEN points = 1 THEN 0 END) OVER w0, 0) AS z, sign(CASE points WHEN 3 THEN 1 WHEN 1 THEN 0 ELSE -1 END) AS s FROM team_rows WINDOW w0 AS ({W_TEAM})), c AS (SELECT *, lag(s) OVER ({W_TEAM}) AS before FROM k), g AS (SELECT *, sum(CASE WHEN s IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER ({W_TEAM}) AS island FROM c) SELECT match_id, team, CAST(s * least(10, row_number() OVER (PARTITION BY league_id, team, island ORDER BY match_date, match_id)) AS BIGINT) AS streak FROM g")
def win_11(spark, d):
    """Signed length of the current run of wins or losses, at most 10: gaps and islands."""
    s = F.when(F.col("points") == 3, 1).when(F.col("points") == 1, 0).otherwise(-1)
    k = rows_of(spark, d).withColumn("s", s).withColumn("new", (~F.col("s").eqNullSafe(F.lag("s").over(TEAM()))).cast("int"))
    k = k.withColumn("island", F.sum("new").over(TEAM()))
    return k.select("match_id", "team", (F.col("s") * F.least(F.lit(10), F.row_number().over(by("league_id", "team", "island")))).cast("long").alias("streak"))


@query("win_12_days_into_season", f"WITH {S} SELECT match_id, date_diff('day', min(match_date) OVER (PARTITION BY league_id, year(match_date) + (month(match_date) >= 7)::INT), match_date) AS days_in FROM settled")
def win_12(spark, d):
    season = F.year("match_date") + (F.month("match_date") >= 7).cast("int")
    return ops.settled(src.matches(spark, d)).select("match_id", F.datediff("match_date", F.min("match_date").over(Window.partitionBy("league_id", season))).cast("long").alias("days_in"))


@query("win_13_rolling_xg", f"WITH {T} SELECT match_id, team, row_number() OVER ({W_TEAM}) AS match_order, round(CASE WHEN count(gf) OVER w >= 2 THEN avg(gf) OVER w END, 6) AS rolling_for, round(CASE WHEN count(ga) OVER w >= 2 THEN avg(ga) OVER w END, 6) AS rolling_against FROM team_rows WINDOW w AS ({W_TEAM} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")
def win_13(spark, d):
    w = TEAM().rowsBetween(-5, -1)
    mean = lambda c: r6(F.when(F.count(c).over(w) >= 2, F.avg(c).over(w)))
    return rows_of(spark, d).select("match_id", "team", F.row_number().over(TEAM()).cast("long").alias("match_order"), mean("gf").alias("rolling_for"), mean("ga").alias("rolling_against"))


@query("win_14_form_pack", f"WITH {T} SELECT match_id, team, round(coalesce(sum(points) OVER w5 / 15.0::DOUBLE, 0.5), 6) AS form_5, round(coalesce(sum(points) OVER w10 / 30.0::DOUBLE, 0.5), 6) AS form_10, round(coalesce(sum(points) OVER w20 / 60.0::DOUBLE, 0.5), 6) AS form_20, count(*) FILTER (ga = 0) OVER w10 AS clean_sheets, round(coalesce(stddev_pop(gf) OVER w10, 1.0), 6) AS scoring_std FROM team_rows WINDOW w5 AS ({W_TEAM} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), w10 AS ({W_TEAM} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), w20 AS ({W_TEAM} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)")
def win_14(spark, d):
    w = {n: TEAM().rowsBetween(-n, -1) for n in (5, 10, 20)}
    form = lambda n: r6(F.coalesce(F.sum("points").over(w[n]) / (3.0 * n), F.lit(0.5))).alias(f"form_{n}")
    return rows_of(spark, d).select("match_id", "team", form(5), form(10), form(20), F.count_if(F.col("ga") == 0).over(w[10]).alias("clean_sheets"), r6(F.coalesce(F.stddev_pop("gf").over(w[10]), F.lit(1.0))).alias("scoring_std"))


@query("win_15_gd_trend", f"WITH {T}, k AS (SELECT *, -row_number() OVER ({W_TEAM}) AS i, gf - ga AS gd FROM team_rows) SELECT match_id, team, round(CASE WHEN count(*) OVER w >= 3 THEN regr_slope(gd, i) OVER w ELSE 0 END, 6) AS gd_trend FROM k WINDOW w AS ({W_TEAM} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)")
def win_15(spark, d):
    """The index runs from the newest match back, as in the reference, so the sign is inverted in time."""
    w = TEAM().rowsBetween(-10, -1)
    k = rows_of(spark, d).withColumns({"i": -F.row_number().over(TEAM()), "gd": F.col("gf") - F.col("ga")})
    return k.select("match_id", "team", r6(F.when(F.count("*").over(w) >= 3, F.regr_slope("gd", "i").over(w)).otherwise(0.0)).alias("gd_trend"))


@query("win_17_fatigue", f"WITH {T} SELECT match_id, team, round(greatest(0, 1 - coalesce(date_diff('day', lag(match_date) OVER w, match_date), 7) / 7.0::DOUBLE), 6) AS fatigue, round(least(1.0, (count(*) OVER (PARTITION BY league_id, team ORDER BY match_date RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)) / 5.0::DOUBLE), 6) AS congestion FROM team_rows WINDOW w AS ({W_TEAM})")
def win_17(spark, d):
    day = Window.partitionBy("league_id", "team").orderBy(F.unix_date(F.to_date("match_date"))).rangeBetween(-14, -1)
    rest = F.coalesce(F.datediff("match_date", F.lag("match_date").over(TEAM())), F.lit(7))
    return rows_of(spark, d).select("match_id", "team", r6(F.greatest(F.lit(0.0), 1 - rest / 7.0)).alias("fatigue"), r6(F.least(F.lit(1.0), F.count("*").over(day) / 5.0)).alias("congestion"))


@query("win_18_side_record", f"WITH {T} SELECT match_id, team, round(coalesce(avg((points = 3)::INT) OVER (PARTITION BY league_id, team, is_home ORDER BY match_date, match_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), CASE WHEN is_home THEN 0.5 ELSE 0.3 END), 6) AS win_rate FROM team_rows")
def win_18(spark, d):
    w = SIDE().rowsBetween(-10, -1)
    return rows_of(spark, d).select("match_id", "team", r6(F.coalesce(F.avg((F.col("points") == 3).cast("int")).over(w), F.when(F.col("is_home"), 0.5).otherwise(0.3))).alias("win_rate"))


MOMENTUM = [0.4, 0.3, 0.15, 0.1, 0.05]


def lagged(column, weights, k=""):
    """Weighted mean over the rows before, newest first, weights renormalised over those that exist."""
    terms = [(F.lag(column, i + 1).over(TEAM()), w) for i, w in enumerate(weights)]
    total = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for v, w in terms), F.lit(0.0))
    return F.when(total > 0, sum((F.coalesce(v * w, F.lit(0.0)) for v, w in terms), F.lit(0.0)) / total)


def lagged_sql(column, weights):
    total = " + ".join(f"CASE WHEN lag({column}, {i + 1}) OVER w IS NOT NULL THEN {w}::DOUBLE ELSE 0 END" for i, w in enumerate(weights))
    return "(" + " + ".join(f"coalesce(lag({column}, {i + 1}) OVER w * {w}::DOUBLE, 0)" for i, w in enumerate(weights)) + f") / nullif({total}, 0)"


@query("win_19_momentum", f"WITH {T} SELECT match_id, team, round({lagged_sql('points', MOMENTUM)}, 6) AS momentum FROM team_rows WINDOW w AS ({W_TEAM})")
def win_19(spark, d):
    return rows_of(spark, d).select("match_id", "team", r6(lagged("points", MOMENTUM)).alias("momentum"))


@query("win_20_odds_microstructure", f"WITH {src.SNAPSHOTS}, k AS (SELECT *, odds_h - lag(odds_h) OVER (PARTITION BY match_id ORDER BY captured_at, snap_no, part_no, supp_no) AS diff FROM snaps) SELECT match_id, round(stddev_pop(diff), 6) AS volatility, round(avg((abs(diff) > 0.1)::INT) FILTER (diff IS NOT NULL), 6) AS jumps, round(arg_max(odds_h, {{'t': captured_at, 'a': snap_no, 'b': part_no, 'c': supp_no}}) - arg_min(odds_h, {{'t': captured_at, 'a': snap_no, 'b': part_no, 'c': supp_no}}), 6) AS move FROM k GROUP BY 1 HAVING count(*) >= 2")
def win_20(spark, d):
    at = F.struct("captured_at", "snap_no", "part_no", "supp_no")
    k = src.snapshots(spark, d).withColumn("diff", F.col("odds_h") - F.lag("odds_h").over(Window.partitionBy("match_id").orderBy("captured_at", "snap_no", "part_no", "supp_no")))
    g = k.groupBy("match_id").agg(F.count("*").alias("n"), r6(F.stddev_pop("diff")).alias("volatility"), r6(F.avg((F.abs("diff") > 0.1).cast("int"))).alias("jumps"), r6(F.max_by("odds_h", at) - F.min_by("odds_h", at)).alias("move"))
    return g.where("n >= 2").drop("n")


ALPHA = [0.7**i for i in range(10)]


@query("win_21_ewma_form", f"WITH {T} SELECT match_id, team, round(coalesce({lagged_sql('(points = 3)::INT', ALPHA)}, 0.5), 4) AS win_rate, round(coalesce({lagged_sql('(points = 1)::INT', ALPHA)}, 0.333), 4) AS draw_rate, round(coalesce({lagged_sql('points', ALPHA)}, 1.0), 4) AS ppg FROM team_rows WINDOW w AS ({W_TEAM})")
def win_21(spark, d):
    k = rows_of(spark, d).withColumns({"won": (F.col("points") == 3).cast("int"), "drawn": (F.col("points") == 1).cast("int")})
    return k.select("match_id", "team", F.round(F.coalesce(lagged("won", ALPHA), F.lit(0.5)), 4).alias("win_rate"), F.round(F.coalesce(lagged("drawn", ALPHA), F.lit(0.333)), 4).alias("draw_rate"), F.round(F.coalesce(lagged("points", ALPHA), F.lit(1.0)), 4).alias("ppg"))


@query("win_23_last5_totals", f"WITH {T} SELECT match_id, team, " + ", ".join(f"CAST(sum({x}) OVER w AS BIGINT) AS {n}_5" for n, x in (("points", "points"), ("gf", "gf"), ("ga", "ga"), ("won", "(points = 3)::INT"), ("drawn", "(points = 1)::INT"), ("lost", "(points = 0)::INT"), ("gd", "gf - ga"))) + f", round(avg(points) OVER w, 6) AS ppg_5 FROM team_rows WINDOW w AS ({W_TEAM} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")
def win_23(spark, d):
    """The last five: points, goals, wins, draws, losses. Goals stand for expected goals, of which these tables have none by match."""
    w = TEAM().rowsBetween(-5, -1)
    is_ = lambda v: (F.col("points") == v).cast("int")
    sums = {"points": F.col("points"), "gf": F.col("gf"), "ga": F.col("ga"), "won": is_(3), "drawn": is_(1), "lost": is_(0), "gd": F.col("gf") - F.col("ga")}
    return rows_of(spark, d).select("match_id", "team", *[F.sum(x).over(w).alias(f"{n}_5") for n, x in sums.items()], r6(F.avg("points").over(w)).alias("ppg_5"))


@query("win_24_h2h_dominance", f"WITH {S}, k AS (SELECT match_id, count(*) OVER w AS n, count(*) FILTER ({LOW_WINS}) OVER w AS low, count(*) FILTER (NOT {LOW_WINS} AND home_score <> away_score) OVER w AS high, avg(home_score + away_score) OVER w AS goals FROM settled WINDOW w AS ({PAIR} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) SELECT match_id, n, low AS low_wins, high AS high_wins, n - low - high AS draws, round(goals, 6) AS avg_goals, low - high AS difference, round(coalesce((low - high) / nullif(n, 0)::DOUBLE, 0), 6) AS ratio FROM k")
def win_24(spark, d):
    """The last ten meetings of a pair, and how far its lower id leads: as a difference of wins, and a match."""
    w, low = pair_window(-10, -1), low_wins()
    high = ~low & (F.col("home_score") != F.col("away_score"))
    k = ops.settled(src.matches(spark, d)).select("match_id", F.count("*").over(w).alias("n"), F.count_if(low).over(w).alias("low_wins"), F.count_if(high).over(w).alias("high_wins"), r6(F.avg(F.col("home_score") + F.col("away_score")).over(w)).alias("avg_goals"))
    lead = F.col("low_wins") - F.col("high_wins")
    return k.withColumns({"draws": F.col("n") - F.col("low_wins") - F.col("high_wins"), "difference": lead, "ratio": r6(F.coalesce(F.try_divide(lead, F.col("n")), F.lit(0.0)))})


@query("win_27_training_rows", f"WITH {T}, h AS (SELECT match_id, team, count(*) OVER w AS n, avg(points) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS form FROM team_rows WINDOW w AS ({W_TEAM})), k AS (SELECT match_id, team, n - 1 AS seen, form FROM h) SELECT m.match_id, round(a.form, 6) AS home_form, round(b.form, 6) AS away_form FROM settled m JOIN k a ON a.match_id = m.match_id AND a.team = home_id JOIN k b ON b.match_id = m.match_id AND b.team = away_id WHERE a.seen >= 5 AND b.seen >= 5")
def win_27(spark, d):
    """Both sides' history back on one row a match: one aggregation by match, no join back."""
    k = rows_of(spark, d).withColumns({"seen": F.row_number().over(TEAM()) - 1, "form": F.avg("points").over(TEAM().rowsBetween(-5, -1))})
    g = k.groupBy("match_id").agg(F.min("seen").alias("seen"), *[r6(F.max(F.when(F.col("is_home") == home, F.col("form")))).alias(c) for home, c in ((True, "home_form"), (False, "away_form"))])
    return g.where("seen >= 5").drop("seen")


@query("win_28_ppg_verdict", f"WITH {T}, k AS (SELECT league_id, team, points, row_number() OVER (PARTITION BY league_id, team ORDER BY match_date DESC, match_id DESC) AS rn FROM team_rows), g AS (SELECT league_id, team, avg(points) FILTER (rn <= 5) AS p5, avg(points) FILTER (rn <= 10) AS p10, stddev_pop(points) FILTER (rn <= 10) AS sd FROM k GROUP BY ALL) SELECT league_id, team, round(p5, 6) AS ppg_5, round(p10, 6) AS ppg_10, CASE WHEN sd > 1.2 THEN 'VOLATILE' WHEN p5 - p10 > 0.3 THEN 'IMPROVING' WHEN p5 - p10 < -0.3 THEN 'DECLINING' ELSE 'STABLE' END AS verdict FROM g")
def win_28(spark, d):
    k = ops.latest(rows_of(spark, d), ["league_id", "team"], [F.desc("match_date"), F.desc("match_id")], 10)
    k = k.withColumn("rn", F.row_number().over(Window.partitionBy("league_id", "team").orderBy(F.desc("match_date"), F.desc("match_id"))))
    g = k.groupBy("league_id", "team").agg(F.avg(F.when(F.col("rn") <= 5, F.col("points"))).alias("p5"), F.avg("points").alias("p10"), F.stddev_pop("points").alias("sd"))
    gap = F.col("p5") - F.col("p10")
    return g.select("league_id", "team", r6("p5").alias("ppg_5"), r6("p10").alias("ppg_10"), F.when(F.col("sd") > 1.2, "VOLATILE").when(gap > 0.3, "IMPROVING").when(gap < -0.3, "DECLINING").otherwise("STABLE").alias("verdict"))


@query("win_31_gap_chains", f"WITH {SH}, k AS (SELECT *, (minute - lag(minute) OVER (PARTITION BY match_id ORDER BY minute, seq) > 5)::INT AS gap FROM shots), c AS (SELECT *, coalesce(sum(gap) OVER (PARTITION BY match_id ORDER BY minute, seq), 0) AS chain FROM k) SELECT match_id, CAST(chain AS BIGINT) AS chain, min(minute) AS opens, max(minute) AS closes, count(*) AS shots, round(sum(xg), 6) AS xg, count(*) >= 3 AS pressure, arg_min(team, {{'m': minute, 's': seq}}) AS team FROM c GROUP BY match_id, chain HAVING count(*) >= 2")
def win_31(spark, d, gap=5):
    w = Window.partitionBy("match_id").orderBy("minute", "seq")
    k = src.shots(spark, d).withColumn("gap", F.coalesce((F.col("minute") - F.lag("minute").over(w) > gap).cast("int"), F.lit(0)))
    c = k.withColumn("chain", F.sum("gap").over(w))
    g = c.groupBy("match_id", "chain").agg(F.min("minute").alias("opens"), F.max("minute").alias("closes"), F.count("*").alias("shots"), r6(F.sum("xg")).alias("xg"), (F.count("*") >= 3).alias("pressure"), F.min_by("team", F.struct("minute", "seq")).alias("team"))
    return g.where("shots >= 2")


@query("win_33_walk_forward_folds", f"WITH {S}, k AS (SELECT match_id, row_number() OVER (PARTITION BY league_id ORDER BY match_date, match_id) - 1 AS i, count(*) OVER (PARTITION BY league_id) // 6 AS size FROM settled) SELECT match_id, CAST(i // size AS BIGINT) AS fold FROM k WHERE i // size BETWEEN 1 AND 5")
def win_33(spark, d, k=5):
    """Test folds of an expanding walk-forward split, a league at a time (fold 0 only trains)."""
    w = Window.partitionBy("league_id")
    rows = ops.settled(src.matches(spark, d)).select("match_id", (F.row_number().over(w.orderBy("match_date", "match_id")) - 1).alias("i"), F.floor(F.count("*").over(w) / (k + 1)).alias("size"))
    return rows.select("match_id", F.floor(F.col("i") / F.col("size")).alias("fold")).where(F.col("fold").between(1, k))


@query("win_34_season_splits", f"WITH {S}, s AS (SELECT DISTINCT year(match_date) + (month(match_date) >= 8)::INT AS season FROM settled), k AS (SELECT season, row_number() OVER (ORDER BY season) AS i FROM s) SELECT a.season AS validate, count(*) AS train_seasons FROM k a JOIN k b ON b.season < a.season WHERE a.i >= 5 GROUP BY 1")
def win_34(spark, d):
    """The first fold validates the fifth season, as the reference's loop does."""
    s = ops.settled(src.matches(spark, d)).select((F.year("match_date") + (F.month("match_date") >= 8).cast("int")).cast("long").alias("validate")).distinct()
    return s.withColumn("train_seasons", F.row_number().over(Window.orderBy("validate")).cast("long") - 1).where("train_seasons >= 4")


@query("win_35_recency_weights", f"WITH {S} SELECT match_id, round(exp(-ln(2) / 2 * (max(year(match_date)) OVER (PARTITION BY league_id) - year(match_date))), 6) AS weight FROM settled")
def win_35(spark, d, half_life=2):
    age = F.max(F.year("match_date")).over(Window.partitionBy("league_id")) - F.year("match_date")
    return ops.settled(src.matches(spark, d)).select("match_id", r6(F.exp(-F.ln(F.lit(2.0)) / half_life * age)).alias("weight"))


@query("win_36_chronological_split", f"WITH {S} SELECT match_id, CASE WHEN row_number() OVER (PARTITION BY league_id ORDER BY match_date, match_id) <= floor(count(*) OVER (PARTITION BY league_id) * 0.8) THEN 'train' ELSE 'test' END AS part FROM settled")
def win_36(spark, d):
    w = Window.partitionBy("league_id")
    i = F.row_number().over(w.orderBy("match_date", "match_id"))
    return ops.settled(src.matches(spark, d)).select("match_id", F.when(i <= F.floor(F.count("*").over(w) * 0.8), "train").otherwise("test").alias("part"))


@query("win_37_last5_in_60_days", f"WITH {T} SELECT a.match_id, a.team, (SELECT round(avg(gf), 6) FROM (SELECT gf FROM team_rows b WHERE b.league_id = a.league_id AND b.team = a.team AND b.is_home = a.is_home AND b.match_date < a.match_date AND b.match_date >= a.match_date - INTERVAL 60 DAY ORDER BY b.match_date DESC, b.match_id DESC LIMIT 5)) AS gf_avg FROM team_rows a")
def win_37(spark, d):
    """The newest five matches of the 60 days before."""
    k = ops.newest_before(rows_of(spark, d).select("match_id", "league_id", "team", "is_home", "match_date", "gf"), ["league_id", "team", "is_home"], 60, ["gf"], "five")
    mean = F.aggregate("five", F.lit(0.0), lambda s, x: s + x["gf"]) / F.size("five")
    return k.withColumn("v", F.when(F.size("five") > 0, mean)).select("match_id", "team", r6("v").alias("gf_avg"))
