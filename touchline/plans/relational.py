"""Filters, joins, aggregations, sorts and set operations (PRJ, OPR, JON, AGG, SRT, TOP, SET)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.operators import matches as ops
from touchline.plans.registry import query
from touchline.sources import adapters as src

M, S, T, N, P, SH = src.MATCHES, src.SETTLED, src.TEAM_ROWS, src.SNAPSHOTS, src.PREDICTIONS, src.SHOTS
CUT, DAY = "1996-01-01", "CAST(match_date AS DATE)"
pred_order = lambda: [F.desc("created_at"), F.desc("snap_no"), F.desc("part_no"), F.desc("supp_no")]  # noqa: E731  made when a query is, since that needs a session
PRED_ORDER = "created_at DESC, snap_no DESC, part_no DESC, supp_no DESC"


@query("prj_01_settled", f"WITH {S} SELECT match_id, league_id, {DAY} AS match_day, home_score, away_score FROM settled")
def prj_01(spark, d):
    return ops.settled(src.matches(spark, d)).select("match_id", "league_id", F.to_date("match_date").alias("match_day"), "home_score", "away_score")


@query("prj_02_upcoming_window", f"WITH {M} SELECT match_id, league_id FROM matches WHERE status = 'scheduled' AND match_date >= TIMESTAMP '{CUT}' AND match_date <= TIMESTAMP '{CUT}' + INTERVAL 180 DAY")
def prj_02(spark, d, as_of=CUT, days=180):
    t = F.lit(as_of).cast("timestamp_ntz")
    return src.matches(spark, d).where((F.col("status") == "scheduled") & F.col("match_date").between(t, t + F.expr(f"INTERVAL {days} DAYS"))).select("match_id", "league_id")


@query("prj_03_name_search", "SELECT s_suppkey, s_name FROM supplier WHERE s_name ILIKE '%0001%' ORDER BY s_name LIMIT 20")
def prj_03(spark, d, text="0001", n=20):
    return src.table(spark, d, "supplier").where(F.col("s_name").ilike(f"%{text}%")).orderBy("s_name").limit(n).select("s_suppkey", "s_name")


@query("prj_04_prefix", "SELECT p_partkey FROM part WHERE p_name LIKE 'part 1%' OR p_name LIKE 'a%'")
def prj_04(spark, d):
    return src.table(spark, d, "part").where(F.col("p_name").like("part 1%") | F.col("p_name").like("a%")).select("p_partkey")


@query("prj_09_mean_fill", "SELECT vec_id, round(coalesce(CASE WHEN label > 2 THEN CAST(label AS DOUBLE) END, avg(CASE WHEN label > 2 THEN label END) OVER (), 0), 6) AS filled FROM embeddings")
def prj_09(spark, d):
    e = src.table(spark, d, "embeddings").select("vec_id", F.when(F.col("label") > 2, F.col("label").cast("double")).alias("v"))
    mean = e.agg(F.avg("v").alias("mean"))  # one row
    return e.join(F.broadcast(mean), F.lit(True)).select("vec_id", F.round(F.coalesce("v", "mean", F.lit(0.0)), 6).alias("filled"))


@query("prj_10_standard_scale", "WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd FROM orders) SELECT o_orderkey, round((o_totalprice - m) / sd, 4) AS z FROM orders, s")
def prj_10(spark, d):
    o = src.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    s = o.agg(F.avg("o_totalprice").alias("m"), F.stddev_pop("o_totalprice").alias("sd"))
    return o.join(F.broadcast(s), F.lit(True)).select("o_orderkey", F.round((F.col("o_totalprice") - F.col("m")) / F.col("sd"), 4).alias("z"))


@query("prj_11_one_hot_league", f"WITH {M} SELECT match_id, CAST(league_id = '1-URGENT' AS INTEGER) AS l1, CAST(league_id = '2-HIGH' AS INTEGER) AS l2, CAST(league_id = '3-MEDIUM' AS INTEGER) AS l3 FROM matches")
def prj_11(spark, d):
    return src.matches(spark, d).select("match_id", *[(F.col("league_id") == v).cast("int").alias(f"l{i}") for i, v in enumerate(("1-URGENT", "2-HIGH", "3-MEDIUM"), 1)])


@query("prj_12_month_bins", f"WITH {M} SELECT CASE WHEN month(match_date) <= 3 THEN 'q1' WHEN month(match_date) <= 6 THEN 'q2' WHEN month(match_date) <= 9 THEN 'q3' ELSE 'q4' END AS bin, count(*) AS n FROM matches GROUP BY 1")
def prj_12(spark, d):
    m = F.month("match_date")
    return src.matches(spark, d).groupBy(F.when(m <= 3, "q1").when(m <= 6, "q2").when(m <= 9, "q3").otherwise("q4").alias("bin")).agg(F.count("*").alias("n"))


@query("opr_01_unpivot", f"WITH {T} SELECT match_id, team, opponent, gf, ga, is_home, points FROM team_rows")
def opr_01(spark, d):
    return ops.team_rows(ops.settled(src.matches(spark, d))).select("match_id", "team", "opponent", "gf", "ga", "is_home", "points")


@query("opr_02_result_codes", f"WITH {S} SELECT match_id, CASE WHEN home_score > away_score THEN 'W' WHEN home_score = away_score THEN 'D' ELSE 'L' END AS result, CAST(sign(home_score - away_score) AS INTEGER) AS code, CASE WHEN home_score > away_score THEN 0 WHEN home_score = away_score THEN 1 ELSE 2 END AS outcome FROM settled")
def opr_02(spark, d):
    h, a = F.col("home_score"), F.col("away_score")
    return ops.settled(src.matches(spark, d)).select("match_id", F.when(h > a, "W").when(h == a, "D").otherwise("L").alias("result"), F.signum(h - a).cast("int").alias("code"), F.when(h > a, 0).when(h == a, 1).otherwise(2).alias("outcome"))


@query("jon_01_prediction_match", f"WITH {S}, {P} SELECT p.match_id, p.model_version, count(*) AS n FROM preds p JOIN settled m USING (match_id) GROUP BY ALL")
def jon_01(spark, d):
    return src.predictions(spark, d).join(ops.settled(src.matches(spark, d)).select("match_id"), "match_id").groupBy("match_id", "model_version").agg(F.count("*").alias("n"))


NAMES = "SELECT n_nationkey AS id, n_name AS name FROM nation"


def _named(spark, d, how):
    """Clubs of one region have no name, so the inner and the left join differ."""
    names = src.table(spark, d, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    m = src.matches(spark, d).select("match_id", "home_id", "away_id")
    side = lambda who: names.select(F.col("id").alias(f"{who}_id"), F.col("name").alias(f"{who}_name"))  # noqa: E731  25 nations: Spark broadcasts by size
    return m.join(side("home"), "home_id", how).join(side("away"), "away_id", how).select("match_id", "home_name", "away_name")


@query("jon_02_dimension_twice", f"WITH {M}, n AS ({NAMES} WHERE n_regionkey <> 2) SELECT match_id, h.name AS home_name, a.name AS away_name FROM matches JOIN n h ON h.id = home_id JOIN n a ON a.id = away_id")
def jon_02(spark, d):
    return _named(spark, d, "inner")


@query("jon_03_dimension_left", f"WITH {M}, n AS ({NAMES} WHERE n_regionkey <> 2) SELECT match_id, h.name AS home_name, a.name AS away_name FROM matches LEFT JOIN n h ON h.id = home_id LEFT JOIN n a ON a.id = away_id")
def jon_03(spark, d):
    return _named(spark, d, "left")


@query("jon_04_latest_join_back", f"WITH {P} SELECT match_id, snap_no, part_no, supp_no, round(p_h, 6) AS p_h FROM preds p JOIN (SELECT match_id, max(created_at) AS created_at FROM preds GROUP BY 1) USING (match_id, created_at)")
def jon_04(spark, d):
    return ops.latest_with_ties(src.predictions(spark, d), ["match_id"], "created_at").select("match_id", "snap_no", "part_no", "supp_no", F.round("p_h", 6).alias("p_h"))


@query("jon_05_latest_row_number", f"WITH {P} SELECT match_id, model_version, snap_no, part_no, supp_no FROM preds QUALIFY row_number() OVER (PARTITION BY match_id, model_version ORDER BY {PRED_ORDER}) = 1")
def jon_05(spark, d):
    return ops.latest(src.predictions(spark, d), ["match_id", "model_version"], pred_order()).select("match_id", "model_version", "snap_no", "part_no", "supp_no")


@query("jon_06_clv_records", f"""WITH {S}, {N}, {P},
c AS (SELECT s.* FROM snaps s JOIN settled m USING (match_id) WHERE is_closing AND captured_at < match_date
      QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY captured_at DESC, snap_no DESC, part_no DESC, supp_no DESC) = 1),
p AS (SELECT preds.*, c.captured_at, odds_h, odds_d, odds_a FROM preds JOIN c USING (match_id) WHERE created_at < captured_at
      QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY {PRED_ORDER.replace('snap_no', 'preds.snap_no').replace('part_no', 'preds.part_no').replace('supp_no', 'preds.supp_no')}) = 1)
SELECT match_id, round(p_h, 6) AS p_h, round(p_d, 6) AS p_d, round(p_a, 6) AS p_a, round((1 / odds_h) / (1 / odds_h + 1 / odds_d + 1 / odds_a), 6) AS q_h,
       round((1 / odds_d) / (1 / odds_h + 1 / odds_d + 1 / odds_a), 6) AS q_d, round((1 / odds_a) / (1 / odds_h + 1 / odds_d + 1 / odds_a), 6) AS q_a FROM p""")
def jon_06(spark, d):
    from touchline.functions import market as mk

    m, s = ops.settled(src.matches(spark, d)).select("match_id", "match_date"), src.snapshots(spark, d)
    closing = ops.latest(s.where("is_closing").join(m, "match_id").where("captured_at < match_date"), ["match_id"], [F.desc("captured_at"), F.desc("snap_no"), F.desc("part_no"), F.desc("supp_no")])
    p = src.predictions(spark, d).join(closing.select("match_id", "captured_at", "odds_h", "odds_d", "odds_a"), "match_id").where("created_at < captured_at")
    q = mk.proportional(*map(F.col, ("odds_h", "odds_d", "odds_a")))
    return ops.latest(p, ["match_id"], pred_order()).select("match_id", *[F.round(c, 6).alias(c) for c in ("p_h", "p_d", "p_a")], *[F.round(x, 6).alias(f"q_{k}") for k, x in zip("hda", q)])


@query("jon_07_asof_points", f"""WITH {T}, r AS (SELECT *, sum(points) OVER (PARTITION BY league_id, team ORDER BY match_date, match_id) AS total FROM team_rows)
SELECT a.match_id, a.team, CAST((SELECT arg_max(b.total, {{'d': b.match_date, 'm': b.match_id}}) FROM r b WHERE b.league_id = a.league_id AND b.team = a.team AND b.match_date < a.match_date) AS BIGINT) AS last_total FROM r a""")
def jon_07(spark, d):
    rows = ops.team_rows(ops.settled(src.matches(spark, d)))
    total = rows.withColumn("total", F.sum("points").over(Window.partitionBy("league_id", "team").orderBy("match_date", "match_id")))
    right = total.select("league_id", "team", "match_date", "match_id", F.col("total").alias("last_total"))
    return ops.as_of(rows.select("league_id", "team", "match_id", "match_date"), right, ["league_id", "team"], "match_date", "match_date", ["last_total"], ["match_id"]).select("match_id", "team", "last_total")


@query("jon_09_opening_line", f"WITH {N} SELECT match_id, bookmaker, round(arg_min(odds_h, {{'t': captured_at, 'a': snap_no, 'b': part_no, 'c': supp_no}}), 6) AS opening FROM snaps GROUP BY ALL")
def jon_09(spark, d):
    return src.snapshots(spark, d).groupBy("match_id", "bookmaker").agg(F.round(F.min_by("odds_h", F.struct("captured_at", "snap_no", "part_no", "supp_no")), 6).alias("opening"))


@query("jon_10_latest_pair_odds", f"WITH {M}, {N} SELECT home_id, away_id, round(arg_max(odds_h, {{'t': captured_at, 'm': match_id, 'a': snap_no, 'b': part_no, 'c': supp_no}}), 6) AS odds_h FROM matches JOIN snaps USING (match_id) GROUP BY ALL")
def jon_10(spark, d):
    j = src.matches(spark, d).select("match_id", "home_id", "away_id").join(src.snapshots(spark, d), "match_id")
    return j.groupBy("home_id", "away_id").agg(F.round(F.max_by("odds_h", F.struct("captured_at", "match_id", "snap_no", "part_no", "supp_no")), 6).alias("odds_h"))


@query("jon_11_interval_match", "SELECT a.event_id AS left_id, b.event_id AS right_id, CAST(abs(epoch(a.ts) - epoch(b.ts)) AS DOUBLE) AS gap_s FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND a.event_type = 'click' AND b.event_type = 'view' AND abs(epoch(a.ts) - epoch(b.ts)) <= 5400")
def jon_11(spark, d, minutes=90):
    """Interval join on equal keys: time buckets of the tolerance make it an equi-join (own and neighbouring buckets)."""
    e = src.table(spark, d, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    w = minutes * 60
    left = e.where("event_type = 'click'").select(F.col("event_id").alias("left_id"), "user_id", F.col("s").alias("s1"), F.explode(F.array(*[F.floor(F.col("s") / w) + k for k in (-1, 0, 1)])).alias("bucket"))
    right = e.where("event_type = 'view'").select(F.col("event_id").alias("right_id"), "user_id", F.col("s").alias("s2"), F.floor(F.col("s") / w).alias("bucket"))
    gap = F.abs(F.col("s1") - F.col("s2"))
    return left.join(right, ["user_id", "bucket"]).where((F.col("left_id") != F.col("right_id")) & (gap <= w)).select("left_id", "right_id", gap.alias("gap_s"))


@query("jon_12_unique_candidate", f"WITH {M}, c AS (SELECT a.match_id, b.match_id AS other, count(*) OVER (PARTITION BY a.match_id) AS n FROM matches a JOIN matches b ON a.league_id = b.league_id AND a.home_id = b.home_id AND a.match_id <> b.match_id AND abs(date_diff('day', a.match_date, b.match_date)) <= 7) SELECT match_id, CASE WHEN n = 1 THEN other END AS other, CASE WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS verdict FROM c QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY other) = 1")
def jon_12(spark, d, days=7):
    m = src.matches(spark, d).withColumn("day", F.unix_date(F.to_date("match_date")))
    left = m.select("league_id", "home_id", "match_id", F.col("day").alias("d1"), F.explode(F.array(*[F.floor(F.col("day") / days) + k for k in (-1, 0, 1)])).alias("bucket"))
    right = m.select("league_id", "home_id", F.col("match_id").alias("other"), F.col("day").alias("d2"), F.floor(F.col("day") / days).alias("bucket"))
    c = left.join(right, ["league_id", "home_id", "bucket"]).where((F.col("match_id") != F.col("other")) & (F.abs(F.col("d1") - F.col("d2")) <= days))
    return c.groupBy("match_id").agg(F.count("*").alias("n"), F.min("other").alias("o")).select("match_id", F.when(F.col("n") == 1, F.col("o")).alias("other"), F.when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("verdict"))


@query("jon_13_duplicate_fixture", f"WITH {M} SELECT match_id, lag(match_id) OVER w AS earlier FROM matches WINDOW w AS (PARTITION BY league_id, home_id, away_id ORDER BY match_date, match_id) QUALIFY date_diff('hour', lag(match_date) OVER w, match_date) <= 24")
def jon_13(spark, d):
    w = Window.partitionBy("league_id", "home_id", "away_id").orderBy("match_date", "match_id")
    m = src.matches(spark, d).withColumns({"earlier": F.lag("match_id").over(w), "before": F.lag("match_date").over(w)})
    return m.where(F.col("match_date") - F.col("before") <= F.expr("INTERVAL 24 HOURS")).select("match_id", "earlier")


@query("jon_14_unprocessed", f"WITH {S}, {P} SELECT match_id FROM settled WHERE NOT EXISTS (SELECT 1 FROM preds WHERE preds.match_id = settled.match_id AND model_version = 'F')")
def jon_14(spark, d):
    return ops.settled(src.matches(spark, d)).join(src.predictions(spark, d).where("model_version = 'F'"), "match_id", "left_anti").select("match_id")


@query("jon_15_orphans", "SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IS NULL")
def jon_15(spark, d):
    c, o = src.table(spark, d, "customer"), src.table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("jon_16_unreferenced", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = p_partkey) AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = p_partkey)")
def jon_16(spark, d):
    p = src.table(spark, d, "part")
    for name, key in (("lineitem", "l_partkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey")):
        p = p.join(src.table(spark, d, name).select(F.col(key).alias("p_partkey")), "p_partkey", "left_anti")
    return p.select("p_partkey")


@query("jon_17_with_history", f"WITH {T} SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT team FROM team_rows)")
def jon_17(spark, d):
    teams = ops.team_rows(ops.settled(src.matches(spark, d))).select(F.col("team").alias("c_custkey"))
    return src.table(spark, d, "customer").join(teams, "c_custkey", "left_semi").select("c_custkey")


@query("jon_18_team_match_or", f"WITH {S}, t AS (SELECT DISTINCT home_id AS team FROM matches) SELECT team, count(*) AS played FROM t JOIN settled ON home_id = team OR away_id = team GROUP BY 1")
def jon_18(spark, d):
    """The OR join as two rows a match and an equi-key."""
    return ops.team_rows(ops.settled(src.matches(spark, d))).groupBy("team").agg(F.countDistinct("match_id").alias("played"))


@query("jon_19_h2h", f"WITH {S} SELECT least(home_id, away_id) AS a, greatest(home_id, away_id) AS b, count(*) AS n, count(*) FILTER (home_score = away_score) AS draws, count(*) FILTER ((home_score > away_score) = (home_id < away_id) AND home_score <> away_score) AS a_wins, round(avg(home_score + away_score), 6) AS avg_goals FROM settled GROUP BY 1, 2")
def jon_19(spark, d):
    h, a = F.col("home_score"), F.col("away_score")
    m = ops.settled(src.matches(spark, d)).groupBy(F.least("home_id", "away_id").alias("a"), F.greatest("home_id", "away_id").alias("b"))
    return m.agg(F.count("*").alias("n"), F.count_if(h == a).alias("draws"), F.count_if(((h > a) == (F.col("home_id") < F.col("away_id"))) & (h != a)).alias("a_wins"), F.round(F.avg(h + a), 6).alias("avg_goals"))


@query("jon_20_stats_twice", f"WITH {M}, s AS (SELECT l_orderkey AS match_id, l_linenumber AS side, sum(l_quantity) AS v FROM lineitem GROUP BY ALL) SELECT match_id, round(coalesce(h.v, 0), 4) AS home_stat, round(coalesce(a.v, 0), 4) AS away_stat FROM matches LEFT JOIN s h ON h.match_id = matches.match_id AND h.side = 1 LEFT JOIN s a ON a.match_id = matches.match_id AND a.side = 2".replace("SELECT match_id, round", "SELECT matches.match_id, round"))
def jon_20(spark, d):
    """One aggregation with a column a side instead of the same table joined twice."""
    s = src.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("match_id")).agg(*[F.sum(F.when(F.col("l_linenumber") == k, F.col("l_quantity"))).alias(c) for k, c in ((1, "h"), (2, "a"))])
    return src.matches(spark, d).join(s, "match_id", "left").select("match_id", F.round(F.coalesce("h", F.lit(0.0)), 4).alias("home_stat"), F.round(F.coalesce("a", F.lit(0.0)), 4).alias("away_stat"))


@query("jon_21_lookup", f"WITH {M} SELECT match_id, CASE league_id WHEN '1-URGENT' THEN 'E0' WHEN '2-HIGH' THEN 'SP1' WHEN '3-MEDIUM' THEN 'D1' ELSE 'unknown' END AS division FROM matches")
def jon_21(spark, d):
    codes = F.create_map(*[F.lit(x) for x in ("1-URGENT", "E0", "2-HIGH", "SP1", "3-MEDIUM", "D1")])
    return src.matches(spark, d).select("match_id", F.coalesce(F.try_element_at(codes, F.col("league_id")), F.lit("unknown")).alias("division"))


@query("jon_22_pending_split", f"WITH {M}, e AS (SELECT DISTINCT l_orderkey AS match_id FROM lineitem WHERE l_returnflag = 'R') SELECT 'pending' AS kind, count(*) AS n FROM matches WHERE match_id NOT IN (SELECT match_id FROM e) UNION ALL SELECT 'existing', count(*) FROM matches WHERE match_id IN (SELECT match_id FROM e)")
def jon_22(spark, d):
    m, e = src.matches(spark, d).select("match_id"), src.snapshots(spark, d).where("is_closing").select("match_id")
    split = lambda kind, how: m.join(e, "match_id", how).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return split("pending", "left_anti").unionByName(split("existing", "left_semi"))


@query("agg_01_team_last10", f"WITH {T}, k AS (SELECT *, row_number() OVER (PARTITION BY league_id, team ORDER BY match_date DESC, match_id DESC) AS rn FROM team_rows) SELECT league_id, team, count(*) AS played, round(avg(gf), 6) AS avg_gf, round(avg(ga), 6) AS avg_ga, count(*) FILTER (points = 3) AS wins, count(*) FILTER (points = 1) AS draws, count(*) FILTER (points = 0) AS losses, round(sum(points)::DOUBLE / count(*), 6) AS form FROM k WHERE rn <= 10 GROUP BY ALL")
def agg_01(spark, d):
    last = ops.latest(ops.team_rows(ops.settled(src.matches(spark, d))), ["league_id", "team"], [F.desc("match_date"), F.desc("match_id")], 10)
    return last.groupBy("league_id", "team").agg(F.count("*").alias("played"), F.round(F.avg("gf"), 6).alias("avg_gf"), F.round(F.avg("ga"), 6).alias("avg_ga"), *[F.count_if(F.col("points") == v).alias(k) for k, v in (("wins", 3), ("draws", 1), ("losses", 0))], F.round(F.avg("points"), 6).alias("form"))


@query("agg_02_league_standings", f"WITH {T}, t AS (SELECT league_id, team, count(*) AS played, count(*) FILTER (points = 3) AS won, count(*) FILTER (points = 1) AS drawn, count(*) FILTER (points = 0) AS lost, CAST(sum(gf) AS BIGINT) AS gf, CAST(sum(ga) AS BIGINT) AS ga, CAST(sum(points) AS BIGINT) AS points FROM team_rows GROUP BY ALL) SELECT *, gf - ga AS gd, row_number() OVER (PARTITION BY league_id ORDER BY points DESC, gf - ga DESC, gf DESC, team) AS position FROM t")
def agg_02(spark, d):
    return ops.standings(src.matches(spark, d))


@query("agg_03_prediction_accuracy", f"""WITH {S}, {P} SELECT model_version, count(*) AS n, count(*) FILTER (hit) AS correct, round(count(*) FILTER (hit)::DOUBLE / count(*), 6) AS accuracy, round(avg(confidence), 6) AS avg_confidence
FROM (SELECT *, (p_h > p_d AND p_h > p_a AND home_score > away_score) OR (p_d > p_h AND p_d > p_a AND home_score = away_score) OR (p_a > p_h AND p_a > p_d AND home_score < away_score) AS hit FROM preds JOIN settled USING (match_id)) GROUP BY 1""")
def agg_03(spark, d):
    h, a = F.col("home_score"), F.col("away_score")
    best = lambda x, y, z: (F.col(x) > F.col(y)) & (F.col(x) > F.col(z))
    j = src.predictions(spark, d).join(ops.settled(src.matches(spark, d)), "match_id")
    j = j.withColumn("hit", (best("p_h", "p_d", "p_a") & (h > a)) | (best("p_d", "p_h", "p_a") & (h == a)) | (best("p_a", "p_h", "p_d") & (h < a)))
    return j.groupBy("model_version").agg(F.count("*").alias("n"), F.count_if("hit").alias("correct"), F.round(F.count_if("hit") / F.count("*"), 6).alias("accuracy"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


@query("agg_04_daily_pnl", """SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS bets, count(*) FILTER (l_returnflag = 'A') AS won, count(*) FILTER (l_returnflag <> 'A') AS lost, round(count(*) FILTER (l_returnflag = 'A')::DOUBLE / count(*), 6) AS win_rate, round(sum(l_quantity), 2) AS staked,
round(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity * 0.9 ELSE -l_quantity END), 2) AS net, round(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity * 0.9 ELSE -l_quantity END) / nullif(sum(l_quantity), 0), 6) AS roi FROM lineitem GROUP BY 1""")
def agg_04(spark, d):
    won = F.col("l_returnflag") == "A"
    net = F.sum(F.when(won, F.col("l_quantity") * 0.9).otherwise(-F.col("l_quantity")))
    return src.table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("bets"), F.count_if(won).alias("won"), F.count_if(~won).alias("lost"), F.round(F.count_if(won) / F.count("*"), 6).alias("win_rate"), F.round(F.sum("l_quantity"), 2).alias("staked"), F.round(net, 2).alias("net"), F.round(F.try_divide(net, F.sum("l_quantity")), 6).alias("roi"))


@query("agg_05_shot_summary", f"WITH {SH} SELECT match_id, team, count(xg) AS shots, round(sum(xg), 6) AS xg_sum, count(*) FILTER (event_type = 'purchase') AS goals, round(sum(xg) / nullif(count(xg), 0), 6) AS xg_per_shot FROM shots GROUP BY ALL")
def agg_05(spark, d):
    return src.shots(spark, d).groupBy("match_id", "team").agg(F.count("xg").alias("shots"), F.round(F.sum("xg"), 6).alias("xg_sum"), F.count_if(F.col("event_type") == "purchase").alias("goals"), F.round(F.try_divide(F.sum("xg"), F.count("xg")), 6).alias("xg_per_shot"))


@query("agg_06_counts", f"WITH {P} SELECT count(*) AS n, count(DISTINCT match_id) AS matches, CAST(max(created_at) AS DATE) AS last_day FROM preds")
def agg_06(spark, d):
    return src.predictions(spark, d).agg(F.count("*").alias("n"), F.countDistinct("match_id").alias("matches"), F.to_date(F.max("created_at")).alias("last_day"))


@query("agg_07_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def agg_07(spark, d):
    return src.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("agg_08_rows_and_distinct", f"WITH {N} SELECT match_id, count(*) AS n_rows, count(DISTINCT bookmaker) AS books FROM snaps GROUP BY 1")
def agg_08(spark, d):
    return src.snapshots(spark, d).groupBy("match_id").agg(F.count("*").alias("n_rows"), F.countDistinct("bookmaker").alias("books"))


@query("agg_09_league_mean_before", f"WITH {S} SELECT match_id, round(avg(home_score) OVER (PARTITION BY league_id, year(match_date) ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS mean_before FROM settled")
def agg_09(spark, d):
    w = Window.partitionBy("league_id", F.year("match_date")).orderBy("match_date", "match_id").rowsBetween(Window.unboundedPreceding, -1)
    return ops.settled(src.matches(spark, d)).select("match_id", F.round(F.avg("home_score").over(w), 6).alias("mean_before"))


@query("agg_10_provider_latest", f"WITH {N} SELECT bookmaker, count(*) AS n, CAST(max(captured_at) AS DATE) AS last_day, arg_max(match_id, {{'t': captured_at, 'm': match_id}}) AS last_match FROM snaps GROUP BY 1")
def agg_10(spark, d):
    return src.snapshots(spark, d).groupBy("bookmaker").agg(F.count("*").alias("n"), F.to_date(F.max("captured_at")).alias("last_day"), F.max_by("match_id", F.struct("captured_at", "match_id")).alias("last_match"))


FIRST_ID = "coalesce(nullif(trim(CASE WHEN event_id % 3 = 0 THEN 'c' || event_id % 50 ELSE ' ' END), ''), nullif(trim(CASE WHEN event_id % 3 = 1 THEN 'p' || event_id % 70 END), ''), nullif(trim('f' || user_id), ''))"
USABLE = {"total": "TRUE", "coherent": "value > 20", "executable": "value > 20 AND value > 50"}
STATE = "CASE WHEN total_records = 0 THEN 'EMPTY' WHEN executable_records > 0 THEN 'USABLE' ELSE 'UNUSABLE' END"


@query("agg_11_coverage", f"WITH k AS (SELECT event_type, {', '.join(f'count(*) FILTER ({x}) AS {n}_records, count(DISTINCT {FIRST_ID}) FILTER ({x}) AS {n}_events' for n, x in USABLE.items())} FROM events GROUP BY 1) SELECT *, {STATE} AS state FROM k")
def agg_11(spark, d):
    """Records and different events (first of three ids that isn't blank) in all, coherent, and executable, which are the usable ones."""
    e = src.table(spark, d, "events").select("event_type", "value", F.expr(FIRST_ID).alias("id"))
    k = e.groupBy("event_type").agg(*[x for n, on in USABLE.items() for x in (F.count_if(F.expr(on)).alias(f"{n}_records"), F.countDistinct(F.when(F.expr(on), F.col("id"))).alias(f"{n}_events"))])
    return k.withColumn("state", F.expr(STATE))


@query("agg_12_value_bet_summary", f"""WITH {M}, {N}, {src.PREDICTIONS}, j AS (SELECT league_id, p_h * odds_h - 1 AS h, p_d * odds_d - 1 AS d, p_a * odds_a - 1 AS a, confidence FROM snaps JOIN preds USING (match_id, snap_no, part_no, supp_no) JOIN matches USING (match_id)),
v AS (SELECT league_id, confidence, 'h' AS market, h AS edge FROM j UNION ALL SELECT league_id, confidence, 'd', d FROM j UNION ALL SELECT league_id, confidence, 'a', a FROM j)
SELECT league_id, market, count(*) AS bets, round(avg(edge), 6) AS avg_edge, round(avg(confidence), 6) AS avg_confidence, round(sum(edge), 4) AS total_edge FROM v WHERE edge > 0 GROUP BY GROUPING SETS ((league_id), (market), ())""")
def agg_12(spark, d):
    """Value bets (a positive edge in any market) by league, by market and in all, in one pass."""
    ids = ["match_id", "snap_no", "part_no", "supp_no"]
    j = src.snapshots(spark, d).join(src.predictions(spark, d), ids).join(src.matches(spark, d).select("match_id", "league_id"), "match_id")
    each = F.array(*[F.struct(F.lit(k).alias("market"), (F.col(f"p_{k}") * F.col(f"odds_{k}") - 1).alias("edge")) for k in "hda"])
    v = j.select("league_id", "confidence", F.explode(each).alias("s")).select("league_id", "confidence", "s.*").where("edge > 0")
    g = v.groupingSets([[F.col("league_id")], [F.col("market")], []], "league_id", "market")
    return g.agg(F.count("*").alias("bets"), F.round(F.avg("edge"), 6).alias("avg_edge"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.round(F.sum("edge"), 4).alias("total_edge"))


@query("agg_14_h2h_top5", f"WITH {T} SELECT opponent, count(*) AS played, count(*) FILTER (points = 3) AS won FROM team_rows WHERE team = 3 GROUP BY 1 ORDER BY played DESC, opponent LIMIT 5")
def agg_14(spark, d, team=3):
    rows = ops.team_rows(ops.settled(src.matches(spark, d))).where(F.col("team") == team)
    return rows.groupBy("opponent").agg(F.count("*").alias("played"), F.count_if(F.col("points") == 3).alias("won")).orderBy(F.desc("played"), "opponent").limit(5)


_AT = lambda q: f"max(value) FILTER (rn = least(n, CAST(floor(n * {q}::DOUBLE) AS BIGINT) + 1))"


@query("agg_17_exact_percentiles", f"WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, round({_AT(0.5)}, 6) AS p50, round({_AT(0.95)}, 6) AS p95, round({_AT(0.99)}, 6) AS p99, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean, count(*) AS n FROM s GROUP BY 1")
def agg_17(spark, d):
    """Exact index percentiles without sorting a key in one task: values are counted in ranges between approximate quantiles of all, the counts
    tell the range and the place in it of each wanted rank, and only those ranges are ranked."""
    e = src.table(spark, d, "events").select("event_type", "value").where("value is not null")
    cuts = sorted(set(e.approxQuantile("value", [i / 64 for i in range(1, 64)], 0.001)))
    part = F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda n, x: n + (F.col("value") > x).cast("int")) if cuts else F.lit(0)
    e = e.withColumn("part", part)
    # a row for each key and range
    n = e.groupBy("event_type", "part").agg(F.count("*").alias("rows"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))
    w = Window.partitionBy("event_type")
    n = n.withColumns({"before": F.sum("rows").over(w.orderBy("part")) - F.col("rows"), "n": F.sum("rows").over(w), "mean": F.sum("total").over(w) / F.sum("rows").over(w), "least": F.min("low").over(w), "most": F.max("high").over(w)})
    wanted = F.explode(F.array(*[F.struct(F.lit(f"p{int(q * 100)}").alias("name"), F.least(F.col("n"), F.floor(F.col("n") * q) + 1).alias("rank")) for q in (0.5, 0.95, 0.99)]))
    asked = n.select("*", wanted.alias("q")).where((F.col("q.rank") > F.col("before")) & (F.col("q.rank") <= F.col("before") + F.col("rows")))
    asked = asked.select("event_type", "part", "n", "mean", "least", "most", "q.name", (F.col("q.rank") - F.col("before")).alias("place"))
    ranked = e.join(asked.select("event_type", "part").distinct(), ["event_type", "part"]).withColumn("place", F.row_number().over(Window.partitionBy("event_type", "part").orderBy("value")).cast("long"))
    found = asked.join(ranked, ["event_type", "part", "place"])
    at = lambda q: F.round(F.max(F.when(F.col("name") == q, F.col("value"))), 6).alias(q)
    return found.groupBy("event_type").agg(at("p50"), at("p95"), at("p99"), F.round(F.min("least"), 6).alias("low"), F.round(F.max("most"), 6).alias("high"), F.round(F.max("mean"), 6).alias("mean"), F.max("n").alias("n"))


@query("agg_18_best_price", f"WITH {N} SELECT match_id, " + ", ".join(f"round(max(odds_{k}), 6) AS best_{k}, arg_max(bookmaker, {{'o': odds_{k}, 'b': -bookmaker}}) AS book_{k}" for k in "hda") + " FROM snaps GROUP BY 1")
def agg_18(spark, d):
    """The best price of each outcome and its bookmaker, the first of equal ones."""
    best = [x for k in "hda" for x in (F.round(F.max(f"odds_{k}"), 6).alias(f"best_{k}"), F.max_by("bookmaker", F.struct(f"odds_{k}", -F.col("bookmaker"))).alias(f"book_{k}"))]
    return src.snapshots(spark, d).groupBy("match_id").agg(*best)


@query("agg_19_best_vs_mean", f"WITH {N} SELECT match_id, " + ", ".join(f"round(avg(odds_{k}), 6) AS mean_{k}, round((max(odds_{k}) / avg(odds_{k}) - 1) * 100, 4) AS advantage_{k}" for k in "hda") + " FROM snaps GROUP BY 1")
def agg_19(spark, d):
    means = [x for k in "hda" for x in (F.round(F.avg(f"odds_{k}"), 6).alias(f"mean_{k}"), F.round((F.max(f"odds_{k}") / F.avg(f"odds_{k}") - 1) * 100, 4).alias(f"advantage_{k}"))]
    return src.snapshots(spark, d).groupBy("match_id").agg(*means)


@query("agg_22_high_quality_rate", f"WITH {SH} SELECT match_id, round(count(*) FILTER (xg > 0.3)::DOUBLE / count(*), 6) AS rate FROM shots GROUP BY 1")
def agg_22(spark, d):
    return src.shots(spark, d).groupBy("match_id").agg(F.round(F.count_if(F.col("xg") > 0.3) / F.count("*"), 6).alias("rate"))


@query("agg_23_possession_tempo", f"WITH {SH} SELECT match_id, round(count(*) FILTER (team = 0)::DOUBLE / count(*), 6) AS possession, round(count(*)::DOUBLE / (max(minute) + 1), 6) AS tempo, round(coalesce(sum(xg) FILTER (event_type IN ('click', 'purchase')) / nullif(count(*) FILTER (event_type IN ('click', 'purchase')), 0), 0), 6) AS xg_per_shot FROM shots GROUP BY 1")
def agg_23(spark, d):
    """Shots are the clicks and purchases among the events."""
    shot = F.col("event_type").isin("click", "purchase")
    per_shot = F.coalesce(F.try_divide(F.sum(F.when(shot, F.col("xg"))), F.count_if(shot)), F.lit(0.0))
    return src.shots(spark, d).groupBy("match_id").agg(F.round(F.count_if(F.col("team") == 0) / F.count("*"), 6).alias("possession"), F.round(F.count("*") / (F.max("minute") + 1), 6).alias("tempo"), F.round(per_shot, 6).alias("xg_per_shot"))


@query("agg_24_heat_map", f"WITH {SH}, g AS (SELECT match_id, x // 10 AS gx, y // 10 AS gy, sum(CASE WHEN event_type IN ('click', 'purchase') THEN 10 ELSE 1 END * CASE WHEN team = 0 THEN 1 ELSE -1 END) AS v FROM shots GROUP BY ALL) SELECT match_id, gx, gy, round(coalesce(v::DOUBLE / nullif(max(abs(v)) OVER (PARTITION BY match_id), 0), 0), 6) AS value FROM g")
def agg_24(spark, d):
    """Shots count 1 for the home and -1 for the away side, passes a tenth of that (in tenths, so the sums are exact)."""
    weight = F.when(F.col("event_type").isin("click", "purchase"), 10).otherwise(1) * F.when(F.col("team") == 0, 1).otherwise(-1)
    g = src.shots(spark, d).groupBy("match_id", F.floor(F.col("x") / 10).alias("gx"), F.floor(F.col("y") / 10).alias("gy")).agg(F.sum(weight).alias("v"))
    return g.select("match_id", "gx", "gy", F.round(F.coalesce(F.try_divide(F.col("v"), F.max(F.abs("v")).over(Window.partitionBy("match_id"))), F.lit(0.0)), 6).alias("value"))


@query("agg_25_danger_zones", f"WITH {SH}, z AS (SELECT x // 24 AS zx, y // 20 AS zy, count(*) AS n, round(sum(xg), 4) AS xg FROM shots GROUP BY ALL), a AS (SELECT gx AS zx, gy AS zy, coalesce(n, 0) AS n, coalesce(xg, 0) AS xg FROM range(5) AS p(gx), range(4) AS q(gy) LEFT JOIN z ON z.zx = gx AND z.zy = gy) SELECT *, row_number() OVER (ORDER BY xg DESC, zx, zy) <= 3 AS hot FROM a")
def agg_25(spark, d):
    z = src.shots(spark, d).groupBy(F.floor(F.col("x") / 24).alias("zx"), F.floor(F.col("y") / 20).alias("zy")).agg(F.count("*").alias("n"), F.round(F.sum("xg"), 4).alias("xg"))
    grid = spark.range(20).select(F.floor(F.col("id") / 4).alias("zx"), (F.col("id") % 4).alias("zy"))
    a = grid.join(z, ["zx", "zy"], "left").select("zx", "zy", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("xg", F.lit(0.0)).alias("xg"))
    return a.withColumn("hot", F.row_number().over(Window.orderBy(F.desc("xg"), "zx", "zy")) <= 3)  # 20 rows


@query("agg_26_scorelines", f"WITH {S} SELECT home_score, away_score, count(*) AS n FROM settled GROUP BY ALL ORDER BY n DESC, home_score, away_score LIMIT 5")
def agg_26(spark, d):
    return ops.settled(src.matches(spark, d)).groupBy("home_score", "away_score").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "home_score", "away_score").limit(5)


@query("agg_27_member_mean", f"WITH {P} SELECT match_id, round(avg(p_h), 6) AS p_h, round(avg(p_d), 6) AS p_d, round(avg(p_a), 6) AS p_a FROM preds WHERE abs(p_h + p_d + p_a - 1) <= 1e-6 GROUP BY 1")
def agg_27(spark, d):
    ok = F.abs(F.col("p_h") + F.col("p_d") + F.col("p_a") - 1) <= 1e-6
    return src.predictions(spark, d).where(ok).groupBy("match_id").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("p_h", "p_d", "p_a")])


CORRELATED = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "CASE WHEN l_linenumber = 1 THEN l_discount END", "tax": "l_tax", "charge": "l_extendedprice * (1 - l_discount)", "rare": "CASE WHEN l_orderkey = 1 THEN l_tax END"}
CORR_PAIRS = [(a, b) for i, a in enumerate(CORRELATED) for b in list(CORRELATED)[i + 1 :]]


@query("agg_28_correlations", "WITH f AS (SELECT " + ", ".join(f"{x} AS {n}" for n, x in CORRELATED.items()) + " FROM lineitem), p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS source, '{b}' AS target, corr({a}, {b}) AS r, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM f" for a, b in CORR_PAIRS) + ") SELECT source, target, round(abs(r), 6) AS confidence FROM p WHERE n >= 50 AND abs(r) >= 0.35")
def agg_28(spark, d, least=50, threshold=0.35):
    """Edges between columns that correlate, over the rows where both are there, if there are enough: all pairs in one scan."""
    f = src.table(spark, d, "lineitem").select(*[F.expr(x).alias(n) for n, x in CORRELATED.items()])
    one = f.agg(*[x for a, b in CORR_PAIRS for x in (F.corr(a, b).alias(f"r_{a}_{b}"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"n_{a}_{b}"))])
    e = one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), F.col(f"r_{a}_{b}").alias("r"), F.col(f"n_{a}_{b}").alias("n")) for a, b in CORR_PAIRS])).alias("e")).select("e.*")
    return e.where((F.col("n") >= least) & (F.abs("r") >= threshold)).select("source", "target", F.round(F.abs("r"), 6).alias("confidence"))


@query("agg_30_feature_evidence", " UNION ALL ".join(f"SELECT '{c}' AS feature, round(count({c})::DOUBLE / count(*), 6) AS coverage, round(stddev_pop({c}), 4) AS spread, round(min({c}), 4) AS low, round(max({c}), 4) AS high, max({c}) > min({c}) AS variable FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def agg_30(spark, d):
    li = src.table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax").unpivot([], ["l_quantity", "l_discount", "l_tax"], "feature", "v")
    return li.groupBy("feature").agg(F.round(F.count("v") / F.count("*"), 6).alias("coverage"), F.round(F.stddev_pop("v"), 4).alias("spread"), F.round(F.min("v"), 4).alias("low"), F.round(F.max("v"), 4).alias("high"), (F.max("v") > F.min("v")).alias("variable"))


@query("agg_31_upcoming_coverage", f"WITH {T}, h AS (SELECT DISTINCT team FROM team_rows WHERE team % 3 > 0), u AS (SELECT * FROM matches WHERE status = 'scheduled'), m AS (SELECT league_id, string_agg(CAST(team AS VARCHAR), ',' ORDER BY team) AS missing, count(*) AS n_missing FROM (SELECT DISTINCT league_id, unnest([home_id, away_id]) AS team FROM u) WHERE team NOT IN (SELECT team FROM h) GROUP BY 1) SELECT league_id, count(*) AS fixtures, count(*) FILTER (home_id IN (SELECT team FROM h) AND away_id IN (SELECT team FROM h)) AS covered, any_value(coalesce(n_missing, 0)) AS n_missing, any_value(coalesce(missing, '')) AS missing FROM u LEFT JOIN m USING (league_id) GROUP BY 1")
def agg_31(spark, d):
    """Scheduled fixtures whose sides both have history, and the teams of the league that have none."""
    h = ops.team_rows(ops.settled(src.matches(spark, d))).where("team % 3 > 0").select("team").distinct()
    m = src.matches(spark, d).where("status = 'scheduled'")
    for side in ("home", "away"):
        m = m.join(h.select(F.col("team").alias(f"{side}_id"), F.lit(True).alias(f"{side}_known")), f"{side}_id", "left")
    unknown = lambda side: F.when(F.col(f"{side}_known").isNull(), F.col(f"{side}_id"))
    # the teams of a league, each once in a task's partial set
    g = m.groupBy("league_id").agg(F.count("*").alias("fixtures"), F.count_if(F.coalesce(F.col("home_known") & F.col("away_known"), F.lit(False))).alias("covered"), F.array_sort(F.array_union(F.collect_set(unknown("home")), F.collect_set(unknown("away")))).alias("teams"))
    return g.select("league_id", "fixtures", "covered", F.size("teams").cast("long").alias("n_missing"), F.array_join(F.transform("teams", lambda x: x.cast("string")), ",").alias("missing"))


@query("agg_32_reference_counts", f"WITH {T} SELECT team, opponent, count(*) AS n FROM team_rows GROUP BY ALL")
def agg_32(spark, d):
    return ops.team_rows(ops.settled(src.matches(spark, d))).groupBy("team", "opponent").agg(F.count("*").alias("n"))


@query("agg_33_league_span", f"WITH {S} SELECT league_id, count(*) AS n, CAST(min(match_date) AS DATE) AS first_day, CAST(max(match_date) AS DATE) AS last_day FROM settled GROUP BY 1")
def agg_33(spark, d):
    return ops.settled(src.matches(spark, d)).groupBy("league_id").agg(F.count("*").alias("n"), F.to_date(F.min("match_date")).alias("first_day"), F.to_date(F.max("match_date")).alias("last_day"))


@query("top_01_global", f"WITH {N} SELECT match_id, snap_no, part_no, supp_no, round(odds_h, 6) AS odds_h FROM snaps ORDER BY odds_h DESC, match_id, snap_no, part_no, supp_no LIMIT 25")
def top_01(spark, d):
    return src.snapshots(spark, d).orderBy(F.desc("odds_h"), "match_id", "snap_no", "part_no", "supp_no").limit(25).select("match_id", "snap_no", "part_no", "supp_no", F.round("odds_h", 6).alias("odds_h"))


@query("top_02_last_k", f"WITH {T} SELECT league_id, team, match_id FROM team_rows QUALIFY row_number() OVER (PARTITION BY league_id, team ORDER BY match_date DESC, match_id DESC) <= 3")
def top_02(spark, d):
    return ops.latest(ops.team_rows(ops.settled(src.matches(spark, d))), ["league_id", "team"], [F.desc("match_date"), F.desc("match_id")], 3).select("league_id", "team", "match_id")


@query("top_03_team_form", f"WITH {T} SELECT match_id, opponent, gf, ga FROM team_rows WHERE team = 7 ORDER BY match_date DESC, match_id DESC LIMIT 10")
def top_03(spark, d, team=7, n=10):
    return ops.team_rows(ops.settled(src.matches(spark, d))).where(F.col("team") == team).orderBy(F.desc("match_date"), F.desc("match_id")).limit(n).select("match_id", "opponent", "gf", "ga")


@query("set_01_union_all", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def set_01(spark, d):
    return src.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).unionByName(src.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query("set_02_distinct_pairs", f"WITH {M} SELECT league_id, home_id AS team FROM matches UNION SELECT league_id, away_id FROM matches")
def set_02(spark, d):
    return ops.team_rows(src.matches(spark, d)).select("league_id", "team").distinct()


@query("set_03_difference", "SELECT o_custkey AS id FROM orders EXCEPT SELECT s_suppkey FROM supplier")
def set_03(spark, d):
    return src.table(spark, d, "orders").select(F.col("o_custkey").alias("id")).subtract(src.table(spark, d, "supplier").select("s_suppkey"))
