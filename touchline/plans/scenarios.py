"""Inventory that acts on files, scenarios, calibration by league, models' sensitivity and live refits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.functions import market as mk
from touchline.operators import calibration as cal
from touchline.operators import learning as lr
from touchline.operators import matches as ops
from touchline.operators import ratings as rt
from touchline.plans.evaluation import SCORED, scored
from touchline.plans.live import stream
from touchline.plans.market import BOTH, IDS, IDS_SQL, TOTAL, joined
from touchline.plans.registry import query
from touchline.plans.timeline import TEAM, W_TEAM, r6, rows_of
from touchline.sources import adapters as src
from touchline.sources import files
from touchline.sources.scratch import scratch
from touchline.streaming import live

M, S, T, N, P = src.MATCHES, src.SETTLED, src.TEAM_ROWS, src.SNAPSHOTS, src.PREDICTIONS
c = lambda name: F.col(name)


# --- sources: the tables go out in the format and come back through its reader


def season_files(spark, d, odds=False):
    """Settled matches as season files, a file set a league: header aliases of the provider dialect."""
    m = ops.settled(src.matches(spark, d))
    cols = [c("league_id").alias("Div"), F.date_format("match_date", "dd/MM/yyyy").alias("Date"), F.concat(F.lit("Team "), c("home_id")).alias("HomeTeam"), F.concat(F.lit('Club, "'), c("away_id"), F.lit('"')).alias("AwayTeam"), F.concat(c("home_score"), F.lit(".0")).alias("FTHG"), c("away_score").alias("FTAG")]
    if odds:
        cols += [F.round(1.5 + c("match_id") % 40 / 20.0, 2).alias("B365H"), F.lit("3.4").alias("B365D"), F.when(c("match_id") % 9 == 0, "x").otherwise("2.5").alias("B365A")]
    path = scratch(spark, "seasons")
    m.select(*cols).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


SEASON = "CAST(match_date AS DATE) AS match_day, 'Team ' || home_id AS home_team, 'Club, \"' || away_id || '\"' AS away_team"


@query("src_01_season_csv", f"WITH {S} SELECT {SEASON}, home_score::INT AS home_goals, away_score::INT AS away_goals, league_id AS division FROM settled")
def src_01(spark, d):
    return files.season_csv(spark, season_files(spark, d)).select("match_day", "home_team", "away_team", "home_goals", "away_goals", "division")


@query("src_02_training_csv", f"WITH {S} SELECT {SEASON}, home_score::INT AS home_goals, round(1.5 + match_id % 40 / 20.0::DOUBLE, 2) AS odds_h, 3.4::DOUBLE AS odds_d, CASE WHEN match_id % 9 <> 0 THEN 2.5::DOUBLE END AS odds_a FROM settled")
def src_02(spark, d):
    return files.season_csv(spark, season_files(spark, d, odds=True)).orderBy("match_day").select("match_day", "home_team", "away_team", "home_goals", "odds_h", "odds_d", "odds_a")


@query("src_03_standardised", f"WITH {S} SELECT CAST(match_date AS DATE) AS match_day, CASE WHEN home_score > away_score THEN 0 WHEN home_score = away_score THEN 1 ELSE 2 END AS result, count(*) AS n FROM settled GROUP BY ALL")
def src_03(spark, d):
    return files.derived(files.season_csv(spark, season_files(spark, d))).groupBy("match_day", "result").agg(F.count("*").alias("n"))


@query("src_04_derived_columns", f"WITH {S} SELECT match_id, (home_score + away_score)::INT AS total_goals, (home_score - away_score)::INT AS goal_diff, home_score + away_score > 2 AS over_2_5, home_score + away_score > 3 AS over_3_5, home_score > 0 AND away_score > 0 AS btts FROM settled")
def src_04(spark, d):
    m = ops.settled(src.matches(spark, d)).select("match_id", c("home_score").cast("int").alias("home_goals"), c("away_score").cast("int").alias("away_goals"))
    return files.derived(m).select("match_id", "total_goals", "goal_diff", "over_2_5", "over_3_5", "btts")


ZONES = {"1-URGENT": "Europe/London", "2-HIGH": "Europe/Madrid", "3-MEDIUM": "Europe/Rome", "4-NOT SPECIFIED": "Europe/Berlin", "5-LOW": "Europe/Paris"}


@query("src_05_zoned_csv", f"WITH {S}, z(league_id, zone) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in ZONES.items()) + ") SELECT zone, count(*) AS n, min(CAST(match_date AS DATE)) AS first_day FROM settled JOIN z USING (league_id) GROUP BY 1")
def src_05(spark, d):
    """Quoted fields, required columns checked, each league tagged with its local time zone."""
    zone = F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv])
    rows = files.season_csv(spark, season_files(spark, d)).withColumn("zone", zone[c("division")])
    return rows.groupBy("zone").agg(F.count("*").alias("n"), F.min("match_day").alias("first_day"))


@query("src_06_tree_union", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS price, o_orderstatus AS status FROM orders")
def src_06(spark, d):
    """Files of two generations, one without the column: united by name."""
    o, path = src.table(spark, d, "orders").select(c("o_orderkey").alias("id"), c("o_totalprice").alias("price"), c("o_orderstatus").alias("status")), scratch(spark, "tree")
    o.where("id % 2 = 0").write.parquet(f"{path}/new")
    o.where("id % 2 <> 0").drop("price").write.parquet(f"{path}/old")
    return files.tree(spark, [f"{path}/new", f"{path}/old"])


@query("src_07_json_history", f"WITH {S} SELECT match_id, home_score, away_score FROM settled WHERE contains(lower('Team ' || home_id), 'team 1') AND contains(lower('Team ' || away_id), '2')")
def src_07(spark, d):
    m, path = ops.settled(src.matches(spark, d)), scratch(spark, "history")
    row = F.struct(c("match_id").alias("id"), F.concat(F.lit("Team "), c("home_id")).alias("team1"), F.concat(F.lit("Team "), c("away_id")).alias("team2"), F.struct(F.array("home_score", "away_score").alias("ft")).alias("score"))
    m.select(F.array(row).alias("matches")).write.json(path)
    return files.history_json(spark, path, "team 1", "2").select(c("id").alias("match_id"), "home_score", "away_score")


@query("src_08_event_json", f"WITH {src.SHOTS} SELECT seq, xg, x::DOUBLE AS x, event_type = 'purchase' AS is_goal FROM shots WHERE event_type IN ('purchase', 'click')")
def src_08(spark, d):
    e, path = src.shots(spark, d), scratch(spark, "events")
    kind = F.when(c("event_type").isin("purchase", "click"), "Shot").otherwise("Pass")
    e.select(c("seq").cast("string").alias("id"), c("minute").cast("int"), F.struct(kind.alias("name")).alias("type"), F.struct(c("team").cast("string").alias("name")).alias("team"), F.array(c("x").cast("double"), c("y").cast("double")).alias("location"), F.struct(c("xg").alias("statsbomb_xg"), F.struct(F.when(c("event_type") == "purchase", "Goal").otherwise("Saved").alias("name")).alias("outcome")).alias("shot")).write.json(path)
    return files.event_json(spark, path, multi_line=False).select(c("id").cast("long").alias("seq"), "xg", "x", "is_goal")


@query("src_09_named_columns", "SELECT o_orderkey AS id, o_totalprice AS xg_h, CAST(o_orderdate AS DATE) AS match_day FROM orders")
def src_09(spark, d):
    o = src.table(spark, d, "orders").select(c("o_orderkey").alias("ID"), c("o_totalprice").alias("Home_XG"), F.to_date("o_orderdate").alias("DateTime"))
    return files.by_candidates(o, {"id": ("id", "game_id"), "xg_h": ("home_xg", "xg_home"), "match_day": ("date", "datetime")})


@query("src_10_ledger_backfill", "SELECT o_orderkey AS match_id, o_totalprice AS rating, NULL::DOUBLE AS trend FROM orders")
def src_10(spark, d):
    path = scratch(spark, "ledger")
    src.table(spark, d, "orders").select(c("o_orderkey").alias("match_id"), c("o_totalprice").alias("rating")).write.parquet(path)
    return files.read_or(spark, path, "match_id long, rating double, trend double")


@query("src_14_manifest")
def src_14(spark, d):
    """Files named by a manifest, each verified by its SHA-256; one entry names a wrong digest."""
    path = scratch(spark, "payload")
    src.table(spark, d, "nation").repartition(3).write.json(path)
    have = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))
    bad = spark.createDataFrame([("missing.json", "0")], "name string, sha256 string")
    return files.verified_files(spark, path, have.unionByName(bad)).groupBy("ok").agg(F.count("*").alias("n"))


# --- latest rows, collector windows, exposure


@query("win_01_latest_event", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def win_01(spark, d):
    return ops.latest(src.table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("win_29_collector_form", f"WITH {T} SELECT match_id, team, count(*) OVER w AS played, sum(points) OVER w AS points, sum(gf) OVER w - sum(ga) OVER w AS goal_diff FROM team_rows WINDOW w AS ({W_TEAM} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def win_29(spark, d, last=10):
    """The collector's table after each match: the last ten with it."""
    w = TEAM().rowsBetween(1 - last, 0)
    return rows_of(spark, d).select("match_id", "team", F.count("*").over(w).alias("played"), F.sum("points").over(w).alias("points"), (F.sum("gf").over(w) - F.sum("ga").over(w)).alias("goal_diff"))


@query("win_32_running_exposure", f"WITH {M}, {BOTH}, b AS (SELECT match_id, CAST(match_date AS DATE) AS day, max(p_h - 1 / odds_h) AS edge, max(least(0.05, greatest(0, ((odds_h - 1) * p_h - (1 - p_h)) / (odds_h - 1)) / 4)) AS stake FROM j JOIN matches USING (match_id) GROUP BY ALL) SELECT match_id, round(sum(stake) OVER w, 6) AS running, sum(stake) OVER w <= 0.15 AS inside FROM b WHERE stake > 0 WINDOW w AS (PARTITION BY day ORDER BY edge DESC, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def win_32(spark, d, cap=0.15):
    j = joined(spark, d).join(src.matches(spark, d).select("match_id", F.to_date("match_date").alias("day")), "match_id")
    b = j.groupBy("match_id", "day").agg(F.max(c("p_h") - 1 / c("odds_h")).alias("edge"), F.max(mk.kelly(c("p_h"), c("odds_h"), 0.25, 0.05)).alias("stake")).where("stake > 0")
    run = F.sum("stake").over(Window.partitionBy("day").orderBy(F.desc("edge"), "match_id").rowsBetween(Window.unboundedPreceding, 0))
    return b.select("match_id", r6(run).alias("running"), (run <= cap).alias("inside"))


# --- decisions: the core variant scores all three outcomes and names the best


def _ev(k):
    return f"p_{k} * odds_{k} - 1"


@query("mkt_32_core_decision", f"""WITH {M}, {BOTH}, f AS (SELECT j.*, row_number() OVER () AS rid, greatest(0, 1 - (p_h * (1 - p_h) + p_d * (1 - p_d) + p_a * (1 - p_a)) / 21.0::DOUBLE) AS sure, CASE WHEN captured_at >= match_date THEN 0.0 WHEN captured_at >= match_date - INTERVAL 7 DAY THEN 1.0 ELSE 0.6 END::DOUBLE AS fresh FROM j JOIN matches USING (match_id)),
o AS (SELECT rid, {IDS_SQL}, unnest([{", ".join(f"{{'market': '{k}', 'ev': {_ev(k)}, 'edge': p_{k} - 1 / odds_{k} / {TOTAL}, 'score': greatest({_ev(k)}, 0) * sure * fresh}}" for k in "hda")}]) AS x FROM f),
b AS (SELECT {IDS_SQL}, x.market AS market, x.ev AS ev, x.edge AS edge, x.score AS score, row_number() OVER (PARTITION BY rid ORDER BY round(x.score, 9) DESC, round(x.ev, 9) DESC, round(x.edge, 9) DESC, x.market) AS r FROM o)
SELECT {IDS_SQL}, market, round(score + 1e-9, 6) AS score, edge >= 0.02 AND score > 0 AS actionable FROM b WHERE r = 1""")
def mkt_32(spark, d, least=0.02):
    """Expected value times what the uncertainty and the age of the price leave of it; the best outcome by
    score, value, edge and name. The three outcomes are compared inside the row, without a shuffle beyond the joins."""
    j = joined(spark, d).join(src.matches(spark, d).select("match_id", "match_date"), "match_id")
    sure = F.greatest(F.lit(0.0), 1 - sum((c(f"p_{k}") * (1 - c(f"p_{k}")) for k in "hda"), F.lit(0.0)) / 21.0)
    fresh = F.when(c("captured_at") >= c("match_date"), 0.0).when(c("captured_at") >= c("match_date") - F.expr("INTERVAL 7 DAYS"), 1.0).otherwise(0.6)
    fair = dict(zip("hda", mk.proportional(*[c(f"odds_{k}") for k in "hda"]), strict=True))
    ev = lambda k: mk.ev(c(f"p_{k}"), c(f"odds_{k}"))
    # the least struct is the best: scores negated, then the name
    each = [F.struct((-F.round(F.greatest(ev(k), F.lit(0.0)) * c("sure") * c("fresh"), 9)).alias("s"), (-F.round(ev(k), 9)).alias("v"), (-F.round(c(f"p_{k}") - fair[k], 9)).alias("e"), F.lit(k).alias("market"), (c(f"p_{k}") - fair[k]).alias("edge"), (F.greatest(ev(k), F.lit(0.0)) * c("sure") * c("fresh")).alias("score")) for k in "hda"]
    best = j.withColumns({"sure": sure, "fresh": fresh}).withColumn("best", F.least(*each))
    return best.select(*IDS, c("best.market").alias("market"), r6(c("best.score") + 1e-9).alias("score"), ((c("best.edge") >= least) & (c("best.score") > 0)).alias("actionable"))


@query("ent_08_team_reconcile", "WITH s AS (SELECT n_nationkey AS id, n_regionkey AS block, lower(n_name) AS name, lower(substr(n_name, 1, length(n_name) - n_nationkey % 3)) AS given FROM nation), p AS (SELECT a.id, b.id AS other, round(1 - levenshtein(a.given, b.name) / greatest(length(a.given), length(b.name))::DOUBLE, 4) AS score FROM s a JOIN s b ON a.block = b.block), k AS (SELECT *, lead(score) OVER w AS next, row_number() OVER w AS r FROM p WINDOW w AS (PARTITION BY id ORDER BY score DESC, other)) SELECT id, CASE WHEN score - next < 0.03 THEN 'CONFLICTING' WHEN score >= 0.94 THEN 'VERIFIED' WHEN score >= 0.68 THEN 'REQUIRES_REVIEW' ELSE 'UNKNOWN' END AS status, CASE WHEN score - next >= 0.03 AND score >= 0.94 THEN other END AS team, score FROM k WHERE r = 1")
def ent_08(spark, d):
    """A provider's name against the candidates of its block: accepted, for review, ambiguous or unknown."""
    n = src.table(spark, d, "nation").select(c("n_nationkey").alias("id"), c("n_regionkey").alias("block"), F.lower("n_name").alias("name"), F.expr("lower(substr(n_name, 1, length(n_name) - n_nationkey % 3))").alias("given"))
    a, b = n.select("id", "block", "given"), n.select(c("id").alias("other"), "block", "name")
    score = F.round(1 - F.levenshtein("given", "name") / F.greatest(F.length("given"), F.length("name")), 4)
    w = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    k = a.join(b, "block").select("id", "other", score.alias("score")).withColumns({"next": F.lead("score").over(w), "r": F.row_number().over(w)}).where("r = 1")
    close = c("score") - c("next") < 0.03
    status = F.when(close, "CONFLICTING").when(c("score") >= 0.94, "VERIFIED").when(c("score") >= 0.68, "REQUIRES_REVIEW").otherwise("UNKNOWN")
    return k.withColumn("status", status).select("id", "status", F.when(c("status") == "VERIFIED", c("other")).alias("team"), "score")


# --- replays over repaired identities


@query("seq_06_rebuild_plan", f"WITH {S}, r AS (SELECT league_id, match_id, match_date, home_id, CASE WHEN away_id % 7 = 0 THEN (away_id + 1) % 20 ELSE away_id END AS away_id FROM settled), k AS (SELECT *, row_number() OVER (PARTITION BY league_id ORDER BY match_date, match_id) AS i FROM r WHERE home_id <> away_id) SELECT league_id, count(*) AS n, CAST(sum(('0x' || substr(md5(i || ':' || match_id || ':' || home_id || ':' || away_id), 1, 8))::BIGINT) AS BIGINT) AS sequence_hash FROM k GROUP BY 1")
def seq_06(spark, d):
    """What a rebuild over corrected identities replays, and a hash that any change of a row or of the order
    changes: a sum over (place, row) digests, so no league is gathered in one place to be hashed."""
    w = Window.partitionBy("league_id").orderBy("match_date", "match_id")
    k = repaired(spark, d).where("home_id <> away_id").withColumn("i", F.row_number().over(w))
    part = F.conv(F.substring(F.md5(F.concat_ws(":", "i", "match_id", "home_id", "away_id")), 1, 8), 16, 10).cast("long")
    return k.groupBy("league_id").agg(F.count("*").alias("n"), F.sum(part).alias("sequence_hash"))


def repaired(spark, d):
    away = F.when(c("away_id") % 7 == 0, (c("away_id") + 1) % 20).otherwise(c("away_id"))
    return ops.settled(src.matches(spark, d)).withColumn("away_id", away)


@query("seq_06_rebuilt_elo")
def seq_06_elo(spark, d):
    return rt.elo(repaired(spark, d))


# --- calibration by league


CLASSES = {"h": ("p_h", "y_h"), "d": ("p_d", "y_d"), "a": ("p_a", "y_a")}


@query("cal_03_league_report")
def cal_03(spark, d):
    """Fitted on the earlier matches of each league, judged on the later ones."""
    long = cal.long_form(scored(spark, d), "league_id", CLASSES)
    maps = cal.fitted(long.where("match_date < '1997-01-01'"))
    return cal.report(cal.applied(long.where("match_date >= '1997-01-01'"), maps, IDS), IDS)


@query("cal_06_live_refit")
def cal_06(spark, d):
    """A stream of predictions of settled matches, counted by bin; each batch refits the calibration on all counts."""
    h, a = c("home_score"), c("away_score")
    won = ops.settled(src.matches(spark, d)).select("match_id", (h > a).cast("double").alias("y"))
    s = stream(spark, d, "lineitem")
    p = s.select(c("l_orderkey").alias("match_id"), ((c("l_partkey") % 7 + 1) / (c("l_partkey") % 7 + c("l_suppkey") % 5 + c("l_linenumber") % 6 + 3)).alias("p"))
    counted = p.join(won, "match_id").groupBy(cal.bin_of(c("p")).alias("bin")).agg(F.sum("y").alias("y"), F.sum("p").alias("p"), F.count("*").alias("n"))

    return live.run_once(counted, "complete", "refit", cal.refitted)


# --- uncertainty, sensitivity, weights: a small linear softmax over the three probabilities


@query("unc_03_dropout")
def unc_03(spark, d, passes=50, keep=0.8):
    key = F.xxhash64(F.lit(17), *IDS)
    out = lr.dropout_passes(key, *[F.ln(f"p_{k}") * 1.2 for k in "hda"], passes=passes, keep=keep)
    return src.predictions(spark, d).select(*IDS, out.alias("u")).select(*IDS, "u.*")


STEP = 0.1


def _softmax_sql(changed=""):
    e = {k: f"exp({1.2}::DOUBLE * (ln(p_{k}){' + 0.1::DOUBLE' if k == changed else ''}))" for k in "hda"}
    return f"{e['h']} / ({e['h']} + {e['d']} + {e['a']})"


@query("udf_07_sensitivity", f"WITH {P} " + " UNION ALL ".join(f"SELECT 'p_{k}' AS feature, round(avg(abs({_softmax_sql(k)} - {_softmax_sql()})), 6) AS sensitivity FROM preds" for k in "hda"))
def udf_07(spark, d):
    """Mean change of the model's home probability when one input moves: perturb and recompute, one pass for all inputs."""
    e = lambda k, moved: F.exp(1.2 * (F.ln(f"p_{k}") + (STEP if k == moved else 0.0)))
    home = lambda moved=None: e("h", moved) / (e("h", moved) + e("d", moved) + e("a", moved))
    means = src.predictions(spark, d).agg(*[F.avg(F.abs(home(k) - home())).alias(f"p_{k}") for k in "hda"])
    return means.select(F.explode(F.array(*[F.struct(F.lit(f"p_{k}").alias("feature"), r6(c(f"p_{k}")).alias("sensitivity")) for k in "hda"])).alias("x")).select("x.*")


@query("udf_08_weight_search", f"WITH {SCORED}, z AS (SELECT p_h, p_d, p_a, y_h, y_d, y_a, count(*) AS n FROM e GROUP BY ALL), g AS (SELECT i / 20.0::DOUBLE AS w FROM range(0, 21) AS r(i)), b AS (SELECT w, sum(n * (pow(w * p_h + (1 - w) * 0.45::DOUBLE - y_h, 2) + pow(w * p_d + (1 - w) * 0.25::DOUBLE - y_d, 2) + pow(w * p_a + (1 - w) * 0.3::DOUBLE - y_a, 2))) / sum(n) AS brier FROM z, g GROUP BY 1) SELECT w, round(brier, 6) AS brier FROM b ORDER BY round(brier, 9), w LIMIT 1")
def udf_08(spark, d):
    """The weight between a model and the base rates with the least Brier score: rows are counted before the grid of 21 is laid over them."""
    names = ["p_h", "p_d", "p_a", "y_h", "y_d", "y_a"]
    z = scored(spark, d).groupBy(*names).agg(F.count("*").alias("n")).withColumn("w", F.explode(F.array(*[F.lit(i / 20.0) for i in range(21)])))
    off = lambda k, base: F.pow(c("w") * c(f"p_{k}") + (1 - c("w")) * base - c(f"y_{k}"), 2)
    b = z.groupBy("w").agg((F.sum(c("n") * (off("h", 0.45) + off("d", 0.25) + off("a", 0.3))) / F.sum("n")).alias("brier"))
    return b.orderBy(F.round("brier", 9), "w").limit(1).select("w", r6("brier").alias("brier"))


@query("udf_02_team_form_function", f"WITH {T}, k AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY match_date DESC, match_id DESC) AS r FROM team_rows) SELECT team, count(*) AS played, sum(points) AS points, string_agg(CASE points WHEN 3 THEN 'W' WHEN 1 THEN 'D' ELSE 'L' END, '' ORDER BY r) AS form FROM k WHERE r <= 5 GROUP BY 1")
def udf_02(spark, d, last=5):
    """The table function of a team's form, for every team at once."""
    k = rows_of(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("team").orderBy(F.desc("match_date"), F.desc("match_id")))).where(c("r") <= last)
    sign = F.when(c("points") == 3, "W").when(c("points") == 1, "D").otherwise("L")
    g = k.groupBy("team").agg(F.count("*").alias("played"), F.sum("points").alias("points"), F.array_sort(F.collect_list(F.struct("r", sign.alias("s")))).alias("x"))  # at most five a team
    return g.select("team", "played", "points", F.array_join(F.transform("x", lambda x: x["s"]), "").alias("form"))


@query("udf_06_batch_inference", f"WITH {P}, k AS (SELECT {IDS_SQL}, pow(p_h, 1 / 1.3::DOUBLE) AS a, pow(p_d, 1 / 1.3::DOUBLE) * 1.1::DOUBLE AS b, pow(p_a, 1 / 1.3::DOUBLE) AS g FROM preds) SELECT {IDS_SQL}, round(a / (a + b + g), 6) AS p_h, round(b / (a + b + g), 6) AS p_d, CASE WHEN a >= b AND a >= g THEN 'h' WHEN b >= g THEN 'd' ELSE 'a' END AS pick FROM k")
def udf_06(spark, d, temperature=1.3, draw=1.1):
    """Calibrator (temperature), then overlay (draw inflation), renormalised: one projection."""
    a, b, g = F.pow("p_h", 1 / temperature), F.pow("p_d", 1 / temperature) * draw, F.pow("p_a", 1 / temperature)
    k = src.predictions(spark, d).select(*IDS, a.alias("a"), b.alias("b"), g.alias("g"))
    total = c("a") + c("b") + c("g")
    return k.select(*IDS, r6(c("a") / total).alias("p_h"), r6(c("b") / total).alias("p_d"), F.when((c("a") >= c("b")) & (c("a") >= c("g")), "h").when(c("b") >= c("g"), "d").otherwise("a").alias("pick"))


# --- augmentation


def feature_rows(spark, d):
    m = ops.settled(src.matches(spark, d))
    h, a = c("home_score").cast("double"), c("away_score").cast("double")
    return m.select("match_id", (1.0 + h / 5).alias("home_attack"), (1.0 + a / 5).alias("away_attack"), (2.0 - a / 5).alias("home_defense"), (2.0 - h / 5).alias("away_defense"), (0.9 * h + 0.2).alias("home_xg"), (0.9 * a + 0.2).alias("away_xg"), (h > a).cast("double").alias("y"))


@query("aug_02_injuries")
def aug_02(spark, d):
    return lr.injured(feature_rows(spark, d), "match_id", "y")


@query("aug_05_weather_referee")
def aug_05(spark, d):
    return lr.refereed(lr.weathered(feature_rows(spark, d), "match_id", "y"), "match_id")


@query("aug_06_augmented")
def aug_06(spark, d):
    rows = feature_rows(spark, d)
    return lr.augmented(rows, "match_id", "y")


# --- streams


@query("str_01_closing_loop", f"WITH {M} SELECT l_orderkey AS match_id, count(*) AS captures, round(max(l_extendedprice), 4) AS top FROM lineitem JOIN matches ON match_id = l_orderkey WHERE l_shipdate < match_date + INTERVAL 30 DAY AND l_shipdate >= match_date - INTERVAL 30 DAY GROUP BY 1")
def str_01(spark, d, days=30):
    """The closing loop: captures near their match's start, one micro-batch a poll (here in days, as the tables are)."""
    kick = src.matches(spark, d).select("match_id", "match_date")
    s = stream(spark, d, "lineitem").select(c("l_orderkey").alias("match_id"), "l_shipdate", "l_extendedprice")
    near = s.join(kick, "match_id").where((c("l_shipdate") < c("match_date") + F.expr(f"INTERVAL {days} DAYS")) & (c("l_shipdate") >= c("match_date") - F.expr(f"INTERVAL {days} DAYS")))
    out = live.run_once(near.groupBy("match_id").agg(F.count("*").alias("captures"), F.max("l_extendedprice").alias("top")), "complete", "closing")
    return out.select("match_id", "captures", F.round("top", 4).alias("top"))


@query("str_04_xg_state", f"WITH {src.SHOTS} SELECT match_id, team, count(*) AS shots, round(sum(xg), 4) AS xg FROM shots GROUP BY ALL")
def str_04(spark, d):
    """The running expected goals of each side; state is a row a side."""
    e = stream(spark, d)
    s = e.select((c("event_id") % 97).alias("match_id"), (c("user_id") % 2).alias("team"), (c("event_id") % 50 / 100.0).alias("xg"))
    out = live.run_once(s.groupBy("match_id", "team").agg(F.count("*").alias("shots"), F.sum("xg").alias("xg")), "complete", "xg")
    return out.select("match_id", "team", "shots", F.round("xg", 4).alias("xg"))


@query("str_11_scheduled_pass", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def str_11(spark, d):
    """A scheduled pass: what is there is drained (``availableNow``), file by file, then the job ends."""
    s = live.event_stream(spark, f"{d}/events.parquet", files_per_batch=1)
    return live.run_once(s.groupBy("event_type").agg(F.count("*").alias("n")), "complete", "pass").select("event_type", "n")
