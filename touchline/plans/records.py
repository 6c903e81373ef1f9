"""Stored records: sinks and read-through that write and read back, settlement, ownership, evidence, as-of features with gates, splits and windows in days (SNK, SRC, AUD, AGG, JON, WIN, FN)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.operators import matches as ops
from touchline.operators import similarity as sim
from touchline.plans.registry import query
from touchline.plans.timeline import TEAM, W_TEAM, rows_of
from touchline.sources import adapters as src
from touchline.sources import files
from touchline.sources.scratch import scratch

M, S, T = src.MATCHES, src.SETTLED, src.TEAM_ROWS
c = lambda name: F.col(name)


def up(x, places=6):
    return F.round(x + 1e-9, places)


def up_sql(x, places=6):
    return f"round({x} + 1e-9, {places})"


# ---- sinks and read-through ----

@query("snk_03_append_new", "SELECT o_orderkey AS id, o_totalprice AS price, CASE WHEN o_orderstatus = 'F' THEN 'first' ELSE 'second' END AS run FROM orders")
def snk_03_append(spark, d):
    """A backfill run twice over a growing input: the finished orders first, then all of them, then all again. Only ids that aren't stored are appended."""
    path = scratch(spark, "backfill")
    o = src.table(spark, d, "orders").select(c("o_orderkey").alias("id"), c("o_totalprice").alias("price"), "o_orderstatus")
    runs = [o.where("o_orderstatus = 'F'").withColumn("run", F.lit("first")), o.withColumn("run", F.lit("second")), o.withColumn("run", F.lit("third"))]
    for r in runs:
        files.append_new(r.drop("o_orderstatus"), path, "id")
    return files.read_or(spark, path, "id long, price double, run string", runs[0].drop("o_orderstatus").limit(0))


@query("src_13_saved_read_through", "WITH r AS (SELECT l_orderkey AS id, max(l_quantity)::DOUBLE AS q FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) SELECT o_orderkey AS id, coalesce(r.q, o_totalprice) AS v, CASE WHEN r.q IS NULL THEN 'remote' ELSE 'local' END AS origin FROM orders LEFT JOIN r ON r.id = o_orderkey")
def src_13_saved(spark, d):
    """Read-through: what the store has wins; what it lacks is taken from the other source and saved; then everything is read from the store."""
    path = scratch(spark, "store")
    local = src.table(spark, d, "lineitem").where("l_linestatus = 'F'").groupBy(c("l_orderkey").alias("id")).agg(F.max("l_quantity").cast("double").alias("v"))
    remote = src.table(spark, d, "orders").select(c("o_orderkey").alias("id"), c("o_totalprice").cast("double").alias("v"))
    files.append_new(local.join(remote.select("id"), "id", "left_semi").withColumn("origin", F.lit("local")), path, "id")
    return read_through(spark, path, "id long, v double, origin string", remote.withColumn("origin", F.lit("remote")), "id")


def read_through(spark, path, schema, remote, key):
    """All keys of the store at ``path`` after the rows of ``remote`` that it lacked were saved there. Where ``remote`` fails, what the store has is returned."""
    from pyspark.errors import PySparkException

    try:
        files.append_new(remote, path, key)
    except PySparkException:
        return spark.read.schema(schema).parquet(path)
    return files.read_or(spark, path, schema, remote.limit(0))


# ---- settlement, ownership, evidence ----

#: States of a match that has a result.
ENDED = ("finished", "ft", "completed")


def settled_by(stored, results):
    """``stored`` (match_id, status, scores) after ``results`` (match_id, home_score, away_score) came in, and what became of each result. A match that has ended is
    never written again, none is made; results that lack an id or a score are left out, of several for one match the largest counts."""
    r = results.where("match_id IS NOT NULL AND home_score IS NOT NULL AND away_score IS NOT NULL").groupBy("match_id").agg(F.max(F.struct("home_score", "away_score")).alias("r"))
    j = stored.join(r, "match_id", "full_outer").withColumn("known", c("status").isNotNull())
    ended = F.coalesce(F.lower("status").isin(*ENDED), F.lit(False))
    fate = F.when(c("r").isNull(), "untouched").when(~c("known"), "unmatched").when(ended, "already_settled").otherwise("updated")
    j = j.withColumn("fate", fate)
    new = c("fate") == "updated"
    return j.select("match_id", F.when(new, "finished").otherwise(c("status")).alias("status"), *[F.when(new, c(f"r.{x}")).otherwise(c(x)).alias(x) for x in ("home_score", "away_score")], "fate")


@query("aud_13_settled_rows", f"""WITH {M}, r0 AS (SELECT l_orderkey + CASE WHEN l_partkey % 50 = 0 THEN 1000000000 ELSE 0 END AS match_id, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_partkey % 5 END AS hs, l_suppkey % 4 AS aw FROM lineitem WHERE l_linestatus = 'F'),
r AS (SELECT match_id, max({{'h': hs, 'a': aw}}) AS r FROM r0 WHERE hs IS NOT NULL GROUP BY 1), j AS (SELECT coalesce(m.match_id, r.match_id) AS match_id, status, home_score, away_score, r.r AS r, CASE WHEN r.r IS NULL THEN 'untouched' WHEN status IS NULL THEN 'unmatched' WHEN status = 'finished' THEN 'already_settled' ELSE 'updated' END AS fate FROM matches m FULL JOIN r ON r.match_id = m.match_id)
SELECT match_id, CASE WHEN fate = 'updated' THEN 'finished' ELSE status END AS status, CASE WHEN fate = 'updated' THEN r.h ELSE home_score END AS home_score, CASE WHEN fate = 'updated' THEN r.a ELSE away_score END AS away_score, fate FROM j""")
def aud_13_rows(spark, d):
    li = src.table(spark, d, "lineitem").where("l_linestatus = 'F'")
    results = li.select((c("l_orderkey") + F.when(c("l_partkey") % 50 == 0, 1_000_000_000).otherwise(0)).alias("match_id"), F.when(c("l_partkey") % 11 != 0, c("l_partkey") % 5).alias("home_score"), (c("l_suppkey") % 4).alias("away_score"))
    return settled_by(src.matches(spark, d).select("match_id", "status", "home_score", "away_score"), results)


_OWNER = "o AS (SELECT team, CASE WHEN team % 7 = 3 THEN NULL ELSE arg_max(league_id, {'n': n, 'l': league_id}) END AS league FROM (SELECT team, league_id, count(*) AS n FROM both_sides GROUP BY ALL) GROUP BY 1)"


@query("aud_02_league_ownership", f"""WITH {T}, {_OWNER}, k AS (SELECT h.league IS NULL OR h.league <> m.league_id AS hb, a.league IS NULL OR a.league <> m.league_id AS ab FROM settled m LEFT JOIN o h ON h.team = home_id LEFT JOIN o a ON a.team = away_id), r AS (SELECT count(*) FILTER (league IS NULL OR league <> league_id) AS n FROM both_sides LEFT JOIN o USING (team))
SELECT count(*) FILTER (hb) AS home_mismatch, count(*) FILTER (ab) AS away_mismatch, count(*) FILTER (hb OR ab) AS match_mismatch, (SELECT n FROM r) AS snapshot_mismatch, CASE WHEN count(*) FILTER (hb OR ab) + (SELECT n FROM r) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM k""")
def aud_02_ownership(spark, d):
    """Four counters against the league that owns a team (where it played most; some teams have no owner): home side, away side, matches, rating rows."""
    m = ops.settled(src.matches(spark, d))
    rows = ops.team_rows(m)
    own = rows.groupBy("team", "league_id").agg(F.count("*").alias("n")).groupBy("team").agg(F.max_by("league_id", F.struct("n", "league_id")).alias("league"))
    return ownership(m, rows, own.select("team", F.when(c("team") % 7 != 3, c("league")).alias("league")))


def ownership(m, rows, own):
    """Counters of matches ``m`` and rating ``rows`` whose team has no league in ``own`` (team, league), or another."""
    wrong = lambda owner: owner.isNull() | (owner != c("league_id"))
    side = lambda k: own.select(c("team").alias(f"{k}_id"), c("league").alias(f"{k}_own"))
    h, a = wrong(c("home_own")), wrong(c("away_own"))
    of_matches = m.join(side("home"), "home_id", "left").join(side("away"), "away_id", "left").agg(F.count_if(h).alias("home_mismatch"), F.count_if(a).alias("away_mismatch"), F.count_if(h | a).alias("match_mismatch"))
    of_rows = rows.join(own, "team", "left").agg(F.count_if(wrong(c("league"))).alias("snapshot_mismatch"))
    passed = c("home_mismatch") + c("away_mismatch") + c("snapshot_mismatch") == 0
    return of_matches.join(of_rows, F.lit(True)).withColumn("status", F.when(passed, "PASS").otherwise("FAIL"))


#: What marks a gap as critical.
CRITICAL = ("purchase", "missing")


def deduped(gaps):
    """Gaps with blanks run together, empty ones and later repeats (whatever their case) removed, in order."""
    clean = F.filter(F.transform(gaps, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return F.filter(clean, lambda x, i: F.array_position(F.transform(clean, F.lower), F.lower(x)) == i + 1)


def evidence(df, column):
    """``df`` with critical, advisory and conflicts, the gaps of ``column`` by kind, and all of them: conflicts are named so, critical ones hold a marker, others advise."""
    low = F.lower
    conflict = lambda x: low(x).startswith("conflicting") | low(x).contains(" conflict")
    marked = lambda x: F.coalesce(*[F.when(low(x).contains(m), True) for m in CRITICAL], F.lit(False))
    out = df.withColumn("_gaps", deduped(F.coalesce(F.array_compact(column), F.array().cast("array<string>"))))
    kinds = {"critical": lambda x: ~conflict(x) & marked(x), "advisory": lambda x: ~conflict(x) & ~marked(x), "conflicts": conflict}
    out = out.withColumns({k: F.filter("_gaps", f) for k, f in kinds.items()})
    return out.withColumn("gaps", F.concat(*kinds)).drop("_gaps")


_GAP = "CASE event_id % 4 WHEN 0 THEN '  ' || event_type || ' ' WHEN 1 THEN upper(event_type) || ' price  feed' WHEN 2 THEN 'Conflicting ' || event_type ELSE '' END"


@query("aud_11_gaps", f"""WITH g AS (SELECT user_id, trim(regexp_replace({_GAP}, '\\s+', ' ', 'g')) AS gap, event_id FROM events), f AS (SELECT user_id, lower(gap) AS k, arg_min(gap, event_id) AS gap, min(event_id) AS pos FROM g WHERE gap <> '' GROUP BY 1, 2),
k AS (SELECT *, CASE WHEN k LIKE 'conflicting%' OR k LIKE '% conflict%' THEN 'x' WHEN k LIKE '%purchase%' OR k LIKE '%missing%' THEN 'c' ELSE 'a' END AS kind FROM f), u AS (SELECT DISTINCT user_id FROM events),
s AS (SELECT user_id, {", ".join(f"coalesce(string_agg(gap, '|' ORDER BY pos) FILTER (kind = '{k}'), '') AS {n}" for k, n in (("c", "critical"), ("a", "advisory"), ("x", "conflicts")))}, count(gap) AS gaps FROM u LEFT JOIN k USING (user_id) GROUP BY 1) SELECT * FROM s""")
def aud_11_gaps(spark, d):
    """Each user's gaps in order of events. Of each spelling only the first is kept before the list is made, so a list is as long as the spellings are many."""
    gap = F.expr("CASE event_id % 4 WHEN 0 THEN '  ' || event_type || ' ' WHEN 1 THEN upper(event_type) || ' price  feed' WHEN 2 THEN 'Conflicting ' || event_type ELSE '' END")
    g = src.table(spark, d, "events").select("user_id", gap.alias("gap"), "event_id").groupBy("user_id", "gap").agg(F.min("event_id").alias("at"))
    lists = g.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("at", "gap"))).alias("l"))
    e = evidence(lists, F.transform("l", lambda x: x["gap"]))
    return e.select("user_id", *[F.array_join(k, "|").alias(k) for k in ("critical", "advisory", "conflicts")], F.size("gaps").cast("long").alias("gaps"))


#: Features judged, with the value that stands where nothing is known, and the least coverage of the gate.
JUDGED, LEAST_COVERAGE = {"l_quantity": 0.0, "l_discount": 0.0, "l_tax": 0.0, "l_linenumber": 1.0}, 0.8
_EV = "count(*) AS n, count({f}) FILTER ({f} <> {v}) AS known, stddev_pop({f}) AS sd, min({f}) AS low, max({f}) AS high"


@query("agg_30_promotion_gate", f"""WITH u AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, {_EV.format(f=f + '::DOUBLE', v=v)} FROM lineitem" for f, v in JUDGED.items())}), k AS (SELECT *, known::DOUBLE / n AS coverage, high - low > 1e-12 AS variable, known = 0 AS default_only FROM u), g AS (SELECT count(*) FILTER (NOT variable OR default_only OR coverage < {LEAST_COVERAGE}) AS bad FROM k)
SELECT feature, n AS rows, round(coverage, 6) AS coverage, round(1 - coverage, 6) AS missingness, round(sd, 4) AS spread, round(low, 4) AS low, round(high, 4) AS high, variable, default_only, CASE WHEN bad = 0 AND n > 0 THEN 'PASS' ELSE 'FAIL' END AS gate FROM k, g""")
def agg_30_gate(spark, d):
    """Per feature: known values (neither null nor the default), spread, range, whether it varies or holds the default only; the gate passes if all are sound."""
    one = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), c(f).cast("double").alias("v"), F.lit(v).alias("usual")) for f, v in JUDGED.items()]))
    k = src.table(spark, d, "lineitem").select(one.alias("f")).select("f.*").groupBy("feature").agg(F.count("*").alias("rows"), F.count_if(c("v") != c("usual")).alias("known"), F.stddev_pop("v").alias("sd"), F.min("v").alias("low"), F.max("v").alias("high"))
    k = k.withColumns({"coverage": c("known") / c("rows"), "variable": c("high") - c("low") > 1e-12, "default_only": c("known") == 0})
    bad = F.count_if(~c("variable") | c("default_only") | (c("coverage") < LEAST_COVERAGE)).over(Window.partitionBy(F.lit(0)))  # over one row a feature
    r = lambda x, p: F.round(x, p).alias(x)
    return k.select("feature", "rows", r("coverage", 6), F.round(1 - c("coverage"), 6).alias("missingness"), F.round("sd", 4).alias("spread"), r("low", 4), r("high", 4), "variable", "default_only", F.when(bad == 0, "PASS").otherwise("FAIL").alias("gate"))


# ---- as-of features and windows ----

#: Days after which a key's newest row before an event is too old, and the columns that are averaged.
STALE_DAYS = 2


@query("jon_08_gated_features", f"""WITH k AS (SELECT event_id, user_id, ts, event_type, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events), w AS (SELECT *, avg(value) OVER b AS m_value, avg(k) OVER b AS m_k, max(ts) OVER b AS newest, count(*) OVER b AS n FROM k WINDOW b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, n > 0 AND epoch(ts) - epoch(newest) <= {STALE_DAYS * 86400} AS fresh FROM w WHERE event_type = 'purchase')
SELECT event_id, {up_sql('CASE WHEN fresh THEN coalesce(m_value, 0) ELSE 0 END')} AS value_mean, {up_sql('CASE WHEN fresh THEN coalesce(m_k, 0) ELSE 0 END')} AS k_mean, n AS rows, CASE WHEN NOT fresh THEN 'value,k' ELSE concat_ws(',', CASE WHEN m_value IS NULL THEN 'value' END, CASE WHEN m_k IS NULL THEN 'k' END) END AS gaps FROM g""")
def jon_08_gated(spark, d):
    """Means of the last five rows before each event for every column; where there is none, or the newest is too old, all columns are gaps with the value 0."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-5, -1)
    e = src.table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    e = e.select("event_id", "ts", "event_type", F.avg("value").over(w).alias("value"), F.avg("k").over(w).alias("k"), F.max("ts").over(w).alias("newest"), F.count("*").over(w).alias("rows")).where("event_type = 'purchase'")
    fresh = F.coalesce(F.timestamp_diff("MICROSECOND", c("newest"), c("ts")) <= STALE_DAYS * 86_400_000_000, F.lit(False))
    shown = lambda x: up(F.when(fresh, F.coalesce(x, F.lit(0.0))).otherwise(0.0))
    gap = lambda x: F.when(~fresh | c(x).isNull(), x)
    return e.select("event_id", shown("value").alias("value_mean"), shown("k").alias("k_mean"), "rows", F.concat_ws(",", gap("value"), gap("k")).alias("gaps"))


@query("win_36_season_holdout", f"""WITH {S}, k AS (SELECT match_id, league_id, year(match_date) AS season, max(year(match_date)) OVER (PARTITION BY league_id) AS last FROM settled), p AS (SELECT *, CASE WHEN season = last THEN 'holdout' WHEN season = last - 1 THEN 'calibration' ELSE 'train' END AS part FROM k),
n AS (SELECT league_id, count(*) FILTER (part = 'holdout') >= 50 AND count(*) FILTER (part = 'calibration') >= 200 AND count(*) FILTER (part = 'train') >= 300 AS ok FROM p GROUP BY 1) SELECT match_id, part, ok AS usable FROM p JOIN n USING (league_id)""")
def win_36_holdout(spark, d, least=(50, 200, 300)):
    """The last season is held out, the one before calibrates, all earlier train; a league with too few rows in a part isn't usable. The seasons and
    counts of a league come from an aggregation, not a window over its rows."""
    m = ops.settled(src.matches(spark, d)).select("match_id", "league_id", F.year("match_date").alias("season"))
    per = m.groupBy("league_id", "season").agg(F.count("*").alias("n"))
    last = F.max("season").over(Window.partitionBy("league_id"))
    per = per.withColumn("part", F.when(c("season") == last, "holdout").when(c("season") == last - 1, "calibration").otherwise("train"))
    held = lambda part: F.coalesce(F.sum(F.when(c("part") == part, c("n"))).over(Window.partitionBy("league_id")), F.lit(0))
    ok = (held("holdout") >= least[0]) & (held("calibration") >= least[1]) & (held("train") >= least[2])
    return m.join(per.select("league_id", "season", "part", ok.alias("usable")), ["league_id", "season"]).select("match_id", "part", "usable")


_LAST5 = "SELECT {cols} FROM (SELECT * FROM team_rows b WHERE b.league_id = a.league_id AND b.team = a.team AND b.is_home = a.is_home AND b.match_date < a.match_date AND b.match_date >= a.match_date - INTERVAL 60 DAY ORDER BY b.match_date DESC, b.match_id DESC LIMIT 5)"
_MET = "SELECT {cols} FROM (SELECT * FROM team_rows b WHERE b.league_id = a.league_id AND b.team = a.team AND b.opponent = a.opponent AND b.match_date < a.match_date AND b.match_date >= a.match_date - INTERVAL 730 DAY ORDER BY b.match_date DESC, b.match_id DESC LIMIT 5)"


@query("win_37_recent_and_met", f"""WITH {T}, k AS (SELECT a.match_id, a.team, ({_LAST5.format(cols="{'gf': coalesce(sum(gf), 0), 'ga': coalesce(sum(ga), 0), 'p': coalesce(sum(points), 0), 'c': count(*) FILTER (ga = 0), 'n': count(*)}")}) AS r, ({_MET.format(cols="{'w': count(*) FILTER (is_home AND gf > ga), 'g': coalesce(sum(gf + ga), 0) / greatest(count(*), 1)::DOUBLE, 'n': count(*)}")}) AS h FROM team_rows a)
SELECT match_id, team, CAST(r.gf AS BIGINT) AS scored, CAST(r.ga AS BIGINT) AS conceded, CAST(r.p AS BIGINT) AS points, r.c AS clean_sheets, r.n AS matches, h.w AS h2h_home_wins, {up_sql('h.g')} AS h2h_goals, h.n AS h2h_matches FROM k""")
def win_37_both(spark, d):
    """The newest five matches at the same venue within 60 days, and the newest five meetings within 730."""
    k = ops.newest_before(rows_of(spark, d), ["league_id", "team", "is_home"], 60, ["gf", "ga", "points"], "r")
    k = ops.newest_before(k, ["league_id", "team", "opponent"], 730, ["gf", "ga", "is_home"], "h")
    total = lambda xs, f: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + f(x).cast("long"))
    of = lambda name: total("r", lambda x: x[name])
    return k.select("match_id", "team", of("gf").alias("scored"), of("ga").alias("conceded"), of("points").alias("points"), total("r", lambda x: x["ga"] == 0).alias("clean_sheets"), F.size("r").cast("long").alias("matches"),
        total("h", lambda x: x["is_home"] & (x["gf"] > x["ga"])).alias("h2h_home_wins"), up(total("h", lambda x: x["gf"] + x["ga"]) / F.greatest(F.size("h"), F.lit(1))).alias("h2h_goals"), F.size("h").cast("long").alias("h2h_matches"))


_XG = "x AS (SELECT match_id, sum(xg) FILTER (team = 0) AS xh, sum(xg) FILTER (team = 1) AS xa FROM shots GROUP BY 1)"


@query("agg_20_expected_goals", f"""WITH {T}, {src.SHOTS}, {_XG}, k AS (SELECT r.match_id, r.league_id, r.team, match_date, gf, ga, coalesce(CASE WHEN is_home THEN xh ELSE xa END, 0) AS xf, coalesce(CASE WHEN is_home THEN xa ELSE xh END, 0) AS xc FROM team_rows r LEFT JOIN x ON x.match_id = r.match_id % 97)
SELECT match_id, team, {", ".join(f"{up_sql(f'coalesce(avg({x}) OVER w, 0)')} AS {n}" for n, x in (("xg_for", "xf"), ("xg_against", "xc"), ("attack_over", "gf - xf"), ("defence_over", "xc - ga")))} FROM k WINDOW w AS ({W_TEAM} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""")
def agg_20_xg(spark, d):
    """Expected goals for and against over the ten matches before, and goals over and conceded under expectation. The shots are summed to a row a match before they are joined."""
    x = src.shots(spark, d).groupBy("match_id").agg(F.sum(F.when(c("team") == 0, c("xg"))).alias("xh"), F.sum(F.when(c("team") == 1, c("xg"))).alias("xa")).withColumnRenamed("match_id", "shot_match")
    k = rows_of(spark, d).withColumn("shot_match", c("match_id") % 97).join(x, "shot_match", "left")
    side = lambda a, b: F.coalesce(F.when(c("is_home"), c(a)).otherwise(c(b)), F.lit(0.0))
    k = k.withColumns({"xf": side("xh", "xa"), "xc": side("xa", "xh")})
    mean = lambda v, n: up(F.coalesce(F.avg(v).over(TEAM().rowsBetween(-10, -1)), F.lit(0.0))).alias(n)
    return k.select("match_id", "team", mean(c("xf"), "xg_for"), mean(c("xc"), "xg_against"), mean(c("gf") - c("xf"), "attack_over"), mean(c("xc") - c("ga"), "defence_over"))


@query("siml_03_novel", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id AS query_id, q.label, count(e.vec_id) AS n, min(list_distance(q.v, e.v)) AS nearest, avg(list_distance(q.v, e.v)) AS mean, stddev_pop(list_distance(q.v, e.v)) AS sd FROM q LEFT JOIN e ON e.vec_id <> q.vec_id AND e.label = q.label GROUP BY ALL) SELECT query_id, n, round(nearest, 5) AS nearest, n < 10 OR coalesce((nearest - mean) / nullif(sd, 0), 0) > 2 AS novel FROM s")
def siml_03_novel(spark, d):
    """Queries against the rows of their own label: fewer than ten make everything novel; else the nearest is compared with the mean distance in deviations."""
    e = src.table(spark, d, "embeddings").select("vec_id", c("embedding").cast("array<double>").alias("e"), "label")
    queries = e.where("vec_id % 100 = 0")
    s = sim.gathered(sim.scored(e, queries, "vec_id", "e", sim.distances, sim.spread_alike, sim.SPREAD, "label"))
    s = queries.select(c("vec_id").alias("query_id")).join(s, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    z = F.coalesce(F.try_divide(c("nearest") - c("mean"), c("sd")), F.lit(0.0))
    return s.select("query_id", "n", F.round("nearest", 5).alias("nearest"), ((c("n") < 10) | (z > 2)).alias("novel"))


@query("fn_07_json_merge", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS kind, 'post_kickoff' AS reason FROM events""")
def fn_07_merge(spark, d):
    """Keys merged into and removed from JSON objects: ``kind`` and ``reason`` come in, a temporary one goes, the others stay. Read back by path."""
    e = src.table(spark, d, "events").withColumn("m", F.from_json("props", "map<string, string>"))
    e = e.withColumn("m", merged(c("m"), F.create_map(F.lit("kind"), c("event_type"), F.lit("reason"), F.lit("draft"), F.lit("temporary"), F.lit("1"))))
    text = F.to_json(without(merged(c("m"), F.create_map(F.lit("reason"), F.lit("post_kickoff"))), "temporary"))
    part = lambda k: F.get_json_object("text", f"$.{k}")
    return e.select("event_id", text.alias("text")).where(part("temporary").isNull()).select("event_id", part("k").cast("long").alias("k"), part("kind").alias("kind"), part("reason").alias("reason"))


def merged(old, new):
    """Map ``old`` with the keys of ``new``, which win."""
    old = F.coalesce(old, F.create_map().cast("map<string, string>"))
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def without(m, *keys):
    return F.map_filter(m, lambda k, v: ~k.isin(*keys))
