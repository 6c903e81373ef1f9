"""Audits, repairs and sinks (AUD, SNK)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.operators import matches as ops
from touchline.plans.registry import query
from touchline.sources import adapters as src

M, S, T, N, P = src.MATCHES, src.SETTLED, src.TEAM_ROWS, src.SNAPSHOTS, src.PREDICTIONS


LEAGUES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
LEDGER = f"SELECT CASE WHEN l_partkey % 50 = 0 THEN -l_orderkey ELSE l_orderkey END AS match_id, l_suppkey % 22 AS team, l_shipdate AS day, CASE l_suppkey % 5 {' '.join(f'WHEN {i} THEN {n!r}' for i, n in enumerate(LEAGUES))} END AS league FROM lineitem"
COUNTERS = ("not_two_rows", "partial", "duplicate_pair", "orphan_match", "orphan_team", "team_not_in_match", "date_mismatch", "league_mismatch", "self_play")


@query("aud_01_structural", f"""WITH {S}, n AS ({LEDGER}), c AS (SELECT match_id, count(*) AS n, count(DISTINCT team) AS d FROM n GROUP BY 1), j AS (SELECT * FROM n JOIN matches USING (match_id)),
v AS (SELECT 'not_two_rows' AS counter, (SELECT count(*) FROM settled JOIN c USING (match_id) WHERE n <> 2 OR d <> 2) AS value UNION ALL SELECT 'partial', (SELECT count(*) FROM c WHERE n = 1)
 UNION ALL SELECT 'duplicate_pair', (SELECT count(*) FROM (SELECT match_id, team FROM n GROUP BY ALL HAVING count(*) > 1)) UNION ALL SELECT 'orphan_match', (SELECT count(*) FROM n WHERE match_id NOT IN (SELECT match_id FROM matches))
 UNION ALL SELECT 'orphan_team', (SELECT count(*) FROM n WHERE team NOT IN (SELECT home_id FROM matches)) UNION ALL SELECT 'team_not_in_match', (SELECT count(*) FROM j WHERE team <> home_id AND team <> away_id)
 UNION ALL SELECT 'date_mismatch', (SELECT count(*) FROM j WHERE day <> match_date) UNION ALL SELECT 'league_mismatch', (SELECT count(*) FROM j WHERE league <> league_id) UNION ALL SELECT 'self_play', (SELECT count(*) FROM matches WHERE home_id = away_id))
SELECT counter, value, CASE WHEN value = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM v UNION ALL SELECT 'all', CAST(sum(value) AS BIGINT), CASE WHEN sum(value) = 0 THEN 'PASS' ELSE 'FAIL' END FROM v""")
def aud_01(spark, d):
    """Nine counters of a ledger of team rows against matches and teams, and their total. The ledger meets matches once, for what is counted by row, without groups;
    pairs are counted from ids alone and then meet the settled matches. Tasks grow in number with the ledger, not in memory."""
    src.table(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    n = spark.sql(LEDGER)
    m = src.matches(spark, d)
    tasks = ops.tasks(n)
    dealt = lambda df: df.repartition(tasks, "match_id")
    known = m.select(F.col("home_id").alias("team"), F.lit(True).alias("known")).distinct()
    j = dealt(n).join(dealt(m.select("match_id", "home_id", "away_id", "match_date", "league_id")), "match_id", "left").join(known, "team", "left")
    flags = {"orphan_match": F.col("home_id").isNull(), "orphan_team": F.col("known").isNull(), "team_not_in_match": (F.col("team") != F.col("home_id")) & (F.col("team") != F.col("away_id")), "date_mismatch": F.col("day") != F.col("match_date"), "league_mismatch": F.col("league") != F.col("league_id")}
    by_row = j.agg(*[F.count_if(x).alias(k) for k, x in flags.items()])
    pairs = dealt(n.select("match_id", "team")).groupBy("match_id", "team").agg(F.count("*").alias("n"))
    each = pairs.groupBy("match_id").agg(F.sum("n").alias("n"), F.count("*").alias("d"), F.count_if(F.col("n") > 1).alias("pairs"))
    counted = each.agg(F.count_if(F.col("n") == 1).alias("partial"), F.sum("pairs").alias("duplicate_pair"))
    odd = each.where("n <> 2 or d <> 2").join(ops.settled(m).select("match_id"), "match_id").agg(F.count("*").alias("not_two_rows"))
    self_play = m.agg(F.count_if(F.col("home_id") == F.col("away_id")).alias("self_play"))
    both = by_row
    for one in (counted, odd, self_play):
        both = both.join(F.broadcast(one), F.lit(True))
    both = both.select(*[F.coalesce(k, F.lit(0)).alias(k) for k in COUNTERS])
    both = both.withColumn("all", sum((F.col(k) for k in COUNTERS), F.lit(0)))
    rows = both.select(F.explode(F.array(*[F.struct(F.lit(k).alias("counter"), F.col(k).cast("long").alias("value")) for k in (*COUNTERS, "all")])).alias("s")).select("s.*")
    return rows.withColumn("status", F.when(F.col("value") == 0, "PASS").otherwise("FAIL"))


@query("aud_02_ownership", f"WITH {T}, h AS (SELECT team, count(DISTINCT league_id) AS leagues FROM team_rows GROUP BY 1) SELECT count(*) AS teams, count(*) FILTER (leagues > 1) AS several, CAST(max(leagues) AS BIGINT) AS most FROM h")
def aud_02(spark, d):
    h = ops.team_rows(ops.settled(src.matches(spark, d))).groupBy("team").agg(F.countDistinct("league_id").alias("leagues"))
    return h.agg(F.count("*").alias("teams"), F.count_if(F.col("leagues") > 1).alias("several"), F.max("leagues").alias("most"))


@query("aud_03_conflicting_ids", "SELECT l_orderkey, l_linenumber, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_partkey) > 1")
def aud_03(spark, d):
    return src.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.countDistinct("l_partkey").alias("parts")).where("parts > 1")


@query("aud_04_identity_audit", f"WITH {T} SELECT c_custkey AS team, count(match_id) AS matches, CAST(min(match_date) AS DATE) AS first_day, CAST(max(match_date) AS DATE) AS last_day FROM customer LEFT JOIN team_rows ON team = c_custkey GROUP BY 1")
def aud_04(spark, d):
    t = ops.team_rows(ops.settled(src.matches(spark, d))).groupBy("team").agg(F.count("*").alias("matches"), F.to_date(F.min("match_date")).alias("first_day"), F.to_date(F.max("match_date")).alias("last_day"))
    c = src.table(spark, d, "customer").select(F.col("c_custkey").alias("team"))
    return c.join(t, "team", "left").select("team", F.coalesce("matches", F.lit(0)).alias("matches"), "first_day", "last_day")


@query("aud_06_self_play_repair", f"WITH {M} SELECT match_id, CASE WHEN away_id = home_id OR away_id % 7 = 0 THEN (home_id + 1) % 20 ELSE away_id END AS away_id FROM matches")
def aud_06(spark, d):
    m = src.matches(spark, d)
    bad = (F.col("away_id") == F.col("home_id")) | (F.col("away_id") % 7 == 0)
    return m.select("match_id", F.when(bad, (F.col("home_id") + 1) % 20).otherwise(F.col("away_id")).alias("away_id"))


@query("aud_08_quarantine", f"WITH {M}, {N} SELECT match_id, snap_no, part_no, supp_no, is_closing AND captured_at >= match_date AS quarantined, CASE WHEN is_closing AND captured_at >= match_date THEN FALSE ELSE is_closing END AS is_closing FROM snaps JOIN matches USING (match_id)")
def aud_08(spark, d):
    j = src.snapshots(spark, d).join(src.matches(spark, d).select("match_id", "match_date"), "match_id")
    late = F.col("is_closing") & (F.col("captured_at") >= F.col("match_date"))
    return j.select("match_id", "snap_no", "part_no", "supp_no", late.alias("quarantined"), (F.col("is_closing") & ~late).alias("is_closing"))


@query("aud_09_keep_last", f"WITH {M} SELECT match_id, league_id, home_id, away_id FROM matches QUALIFY row_number() OVER (PARTITION BY league_id, home_id, away_id ORDER BY match_id DESC) = 1")
def aud_09(spark, d):
    return ops.latest(src.matches(spark, d), ["league_id", "home_id", "away_id"], [F.desc("match_id")]).select("match_id", "league_id", "home_id", "away_id")


@query("aud_11_evidence", "SELECT user_id, len(list_distinct(list(event_type))) AS kinds, round(least(1, count(*) / 100.0::DOUBLE), 6) AS quality FROM events GROUP BY 1")
def aud_11(spark, d):
    return src.table(spark, d, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("kinds"), F.round(F.least(F.lit(1.0), F.count("*") / 100.0), 6).alias("quality"))


@query("aud_12_completeness", "SELECT doc_id, round(((lang IS NOT NULL)::INT + (source IS NOT NULL)::INT + (n_chars > 500)::INT) / 3.0::DOUBLE, 6) AS completeness FROM documents")
def aud_12(spark, d):
    signals = F.array_compact(F.array(F.col("lang"), F.col("source"), F.when(F.col("n_chars") > 500, "long")))
    return src.table(spark, d, "documents").select("doc_id", F.round(F.size(signals) / 3.0, 6).alias("completeness"))


@query("aud_13_settle", f"WITH {M}, u AS (SELECT DISTINCT l_orderkey AS match_id FROM lineitem WHERE l_linestatus = 'F') SELECT count(*) FILTER (m.match_id IS NULL) AS unmatched, count(*) FILTER (status = 'finished') AS already, count(*) FILTER (status <> 'finished') AS updated FROM u LEFT JOIN matches m ON m.match_id = u.match_id")
def aud_13(spark, d):
    u = src.predictions(spark, d).where("model_version = 'F'").select("match_id").distinct()
    j = u.join(src.matches(spark, d).select("match_id", "status"), "match_id", "left")
    return j.agg(F.count_if(F.col("status").isNull()).alias("unmatched"), F.count_if(F.col("status") == "finished").alias("already"), F.count_if(F.col("status") != "finished").alias("updated"))


@query("snk_04_upsert", "WITH a AS (SELECT o_orderkey AS id, o_totalprice AS v, 1 AS version FROM orders UNION ALL SELECT o_orderkey, o_totalprice * 2, 2 FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT c_custkey + 100000000, c_acctbal, 2 FROM customer) SELECT id, round(arg_max(v, version), 4) AS v FROM a GROUP BY 1")
def snk_04(spark, d):
    from touchline.sources.files import upserted

    o = src.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"), F.lit(1).alias("version"))
    new = o.where("id % 5 = 0").select("id", (F.col("v") * 2).alias("v"), F.lit(2).alias("version"))
    fresh = src.table(spark, d, "customer").select((F.col("c_custkey") + 100_000_000).alias("id"), F.col("c_acctbal").alias("v"), F.lit(2).alias("version"))
    return upserted(o, new.unionByName(fresh), "id", "version").select("id", F.round("v", 4).alias("v"))


@query("snk_05_retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15' - INTERVAL 7 DAY")
def snk_05(spark, d):
    from touchline.sources.files import retained

    return retained(src.table(spark, d, "events"), "ts", "2024-01-15", 7).select("event_id")


@query("snk_06_input_hash", f"WITH {P} SELECT match_id, snap_no, part_no, supp_no, sha256('{{\"created\":\"' || strftime(created_at, '%Y-%m-%d') || '\",\"match\":' || match_id || ',\"version\":\"' || model_version || '\"}}') AS input_hash FROM preds WHERE abs(p_h + p_d + p_a - 1) <= 1e-6")
def snk_06(spark, d):
    p = src.predictions(spark, d).where(F.abs(F.col("p_h") + F.col("p_d") + F.col("p_a") - 1) <= 1e-6)
    stable = F.to_json(F.struct(F.date_format("created_at", "yyyy-MM-dd").alias("created"), F.col("match_id").alias("match"), F.col("model_version").alias("version")))
    return p.select("match_id", "snap_no", "part_no", "supp_no", F.sha2(stable, 256).alias("input_hash"))
