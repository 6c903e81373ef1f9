"""Inventory that writes, and reads back what it wrote: manifests, baselines, registries, replays from a ledger, bounded buffers."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.operators import matches as ops
from touchline.operators.registry import Registry
from touchline.plans.evaluation import SCORED, scored
from touchline.plans.registry import query
from touchline.sources import adapters as src
from touchline.sources import manifest, published
from touchline.sources.scratch import scratch
from touchline.streaming import buffers

c = lambda name: F.col(name)


# --- SRC-15: orders as fixtures of seven competitions, with the faults that a provider's file has

CODES = list(manifest.COMPETITIONS)
ZONES = dict(zip(CODES, ("Europe/London", "Europe/London", "Europe/Madrid", "Europe/Rome", "Europe/Berlin", "Europe/Paris", "Europe/Amsterdam")))
FILE_KEYS = 20_000
RUNS = {"1": "1997-01-01T00:00:00Z", "2": "1999-01-01T00:00:00Z"}


def fixture_rows(spark, d, run):
    """Run 1 has the even ids. Run 2 has all, with kickoffs and teams that moved under ids of the provider."""
    k, hour = c("o_orderkey"), c("o_orderkey") + (F.when(c("o_orderkey") % 50 == 0, 1).otherwise(0) if run == "2" else 0)
    league = F.when(k % 97 == 0, "UNKNOWN").otherwise(F.element_at(F.array(*map(F.lit, CODES)), (k % 7 + 1).cast("int")))
    zone = F.when(k % 101 == 0, "Mars/Olympus").otherwise(F.element_at(F.array(*map(F.lit, ZONES.values())), (k % 7 + 1).cast("int")))
    day = F.when(k % 103 == 0, "soon").when(k % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k % 3 == 1, F.date_format("o_orderdate", "dd/MM/yy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    home = c("o_custkey") % 20
    away = F.when(k % 89 == 0, home).otherwise((home + 1 + k % 19) % 20)
    away = F.when((k % 70 == 0) & F.lit(run == "2"), away + 100).otherwise(away)
    goals = lambda n: F.when(c("o_orderstatus") == "F", k % n)
    odds = F.struct(F.when(k % 65 == 0, 0.9).otherwise(1.2 + k % 40 / 10.0).alias("home"), F.lit(3.2).alias("draw"), F.lit(2.5).alias("away"))
    probs = F.struct(F.lit(0.5).alias("home"), F.lit(0.3).alias("draw"), F.when(k % 85 == 0, 0.3).otherwise(0.2).alias("away"))
    market = F.when(k % 5 == 0, F.struct(F.lit("bet365").alias("bookmaker"), (k % 55 != 0).alias("coherent"), odds.alias("raw_odds"), probs.alias("devigged_probabilities")))
    o = src.table(spark, d, "orders")
    o = (o if run == "2" else o.where("o_orderkey % 2 = 0")).select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", F.floor(k / FILE_KEYS).alias("fixtures-part"))
    # the few columns that are read are dealt out and put in order, not the texts; a part is one task's
    w = Window.partitionBy("fixtures-part").orderBy("o_orderkey")
    o = o.withColumns({"opens": F.lag(k).over(w).isNull(), "ends": F.lead(k).over(w).isNull()})
    return o.select(
        "fixtures-part", "opens", "ends", k.alias("source_row_index"), F.when(k % 10 == 0, F.concat(F.lit("n-"), k)).alias("source_native_id"), league.alias("league"), day.alias("match_date"), F.concat_ws(":", *[F.lpad(x.cast("string"), 2, "0") for x in (hour % 24, k % 4 * 15)]).alias("match_time"),
        zone.alias("source_timezone"), F.concat(F.lit("Team "), home).alias("home_team"), F.concat(F.lit("team "), away).alias("away_team"), goals(5).alias("home_goals"), goals(4).alias("away_goals"), market.alias("market"),
    )


def provider_run(spark, d, run):
    """Write the payloads, arrays of at most ``FILE_KEYS`` rows a file, row by row, and their manifest: (manifest, data root)."""
    root = scratch(spark, f"provider-{run}")
    rows = fixture_rows(spark, d, run)
    line = F.concat(F.when(c("opens"), "[").otherwise(","), F.to_json(F.struct(*[x for x in rows.columns if x not in ("fixtures-part", "opens", "ends")])), F.when(c("ends"), "]").otherwise(""))
    rows.select("fixtures-part", line.alias("value")).write.partitionBy("fixtures-part").text(f"{root}/processed")
    files = [(r["path"], r["sha"]) for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(f"{root}/processed").select("path", F.sha2("content", 256).alias("sha")).collect()]
    body = {
        "manifest_version": "2.0", "run_id": f"run-{run}", "source_id": "provider", "adapter_version": "2.0.0", "schema_version": "2.0.0", "registry_version": "2.0.0", "started_at": RUNS[run], "completed_at": RUNS[run], "status": "SUCCESS",
        "record_count": len(files), "raw_files": [], "processed_files": [{"file": p, "object_key": p.rsplit("/", 1)[-1], "hash": h} for p, h in files], "payload_hashes": dict(files), "freshness": "FRESH", "errors": [], "licence": {}, "attribution": "provider",
    }
    spark.createDataFrame([(json.dumps(body),)], "value string").coalesce(1).write.text(f"{root}/manifest")
    return f"{root}/manifest", f"{root}/processed"


def _src_15_sql() -> str:
    codes, zones = ", ".join(f"'{x}'" for x in CODES), ", ".join(f"'{x}'" for x in ZONES.values())
    one = lambda run: f"""
rows{run} AS (
    SELECT k, CASE WHEN k % 97 = 0 THEN NULL ELSE [{codes}][k % 7 + 1] END AS league, CASE WHEN k % 101 = 0 THEN NULL ELSE [{zones}][k % 7 + 1] END AS zone,
        CASE k % 3 WHEN 0 THEN 'y' WHEN 1 THEN 's' ELSE 'i' END || strftime(o_orderdate, '%Y-%m-%d') AS day, (k + {'(k % 50 = 0)::INT' if run == 2 else 0}) % 24 AS hour, o_custkey % 20 AS home,
        CASE WHEN k % 89 = 0 THEN o_custkey % 20 ELSE (o_custkey % 20 + 1 + k % 19) % 20 END + {'(k % 70 = 0)::INT * 100' if run == 2 else 0} AS away, o_orderstatus = 'F' AS finished, CAST(strftime(o_orderdate, '%Y-%m-%d') AS TIMESTAMP) AS midnight
    FROM (SELECT *, o_orderkey AS k FROM orders) {'' if run == 2 else 'WHERE k % 2 = 0'}),
timed{run} AS (SELECT *, midnight + to_hours(hour) + to_minutes(k % 4 * 15) AS local, timezone('UTC', timezone(coalesce(zone, 'UTC'), midnight + to_hours(hour) + to_minutes(k % 4 * 15))) AS last FROM rows{run}),
placed{run} AS (
    SELECT *, CASE WHEN timezone(coalesce(zone, 'UTC'), timezone('UTC', last - INTERVAL 1 HOUR)) = local THEN last - INTERVAL 1 HOUR ELSE last END AS kickoff,
        CASE WHEN timezone(coalesce(zone, 'UTC'), timezone('UTC', last - INTERVAL 1 HOUR)) = local THEN 'fold' WHEN timezone(coalesce(zone, 'UTC'), timezone('UTC', last)) <> local THEN 'gap' ELSE 'plain' END AS clock FROM timed{run}),
judged{run} AS (
    SELECT *, CASE WHEN league IS NULL THEN 'unknown_competition' WHEN home = away THEN 'teams_missing_or_ambiguous' WHEN k % 103 = 0 THEN 'time_invalid' WHEN zone IS NULL THEN 'zone_unknown'
        WHEN finished AND kickoff > TIMESTAMP '{RUNS[str(run)][:10]}' THEN 'finished_in_future' WHEN k % 55 = 0 THEN 'market_not_coherent' WHEN k % 65 = 0 THEN 'odds_malformed' WHEN k % 85 = 0 THEN 'probabilities_not_one' END AS fault,
        CASE WHEN k % 10 = 0 THEN 'n-' || k ELSE concat_ws('|', league, day, hour, k % 4, home, away) END AS id FROM placed{run})"""  # noqa: E731
    told = lambda run: f"""
    SELECT '{run}' AS run, 'fixtures' AS counter, 'seen' AS name, count(*) AS n FROM out{run}
    UNION ALL SELECT '{run}', 'fixtures', x, count(outcome) FROM (VALUES ('inserted'), ('existing'), ('conflict'), ('rejected')) v(x) LEFT JOIN out{run} ON outcome = x GROUP BY x
    UNION ALL SELECT '{run}', 'fault', fault, count(*) FROM out{run} WHERE fault IS NOT NULL GROUP BY fault
    UNION ALL SELECT '{run}', 'conflict', differs, count(*) FROM out{run} WHERE outcome = 'conflict' GROUP BY differs
    UNION ALL SELECT '{run}', 'snapshots', 'inserted', count(DISTINCT id) FROM good{run} WHERE k % 5 = 0
    UNION ALL SELECT '{run}', 'snapshots', 'existing', count(*) - count(DISTINCT id) FROM good{run} WHERE k % 5 = 0
    UNION ALL SELECT '{run}', 'features', 'eligible', count(*) FROM good{run} WHERE finished
    UNION ALL SELECT '{run}', 'features', 'not_eligible', count(*) FROM good{run} WHERE NOT finished
    UNION ALL SELECT '{run}', 'competition', league, count(*) FROM good{run} GROUP BY league
    UNION ALL SELECT '{run}', 'clock', clock, count(*) FROM good{run} GROUP BY clock"""  # noqa: E731
    good = "good{0} AS (SELECT * FROM out{0} WHERE outcome IN ('inserted', 'existing'))"
    return f"""WITH {one(1)},
out1 AS (SELECT *, '' AS differs, CASE WHEN fault IS NOT NULL THEN 'rejected' WHEN row_number() OVER (PARTITION BY id, fault IS NULL ORDER BY k) = 1 THEN 'inserted' ELSE 'existing' END AS outcome FROM judged1), {good.format(1)},
{one(2)},
met2 AS (SELECT j.*, o.id IS NOT NULL AS known, concat_ws('+', CASE WHEN o.away <> j.away THEN 'away' END, CASE WHEN o.kickoff <> j.kickoff THEN 'kickoff' END) AS differs FROM judged2 j LEFT JOIN (SELECT * FROM out1 WHERE outcome = 'inserted') o ON o.id = j.id),
out2 AS (SELECT *, CASE WHEN fault IS NOT NULL THEN 'rejected' WHEN differs <> '' THEN 'conflict' WHEN NOT known AND row_number() OVER (PARTITION BY id, fault IS NULL ORDER BY k) = 1 THEN 'inserted' ELSE 'existing' END AS outcome FROM met2), {good.format(2)}
{told(1)} UNION ALL {told(2)}
UNION ALL SELECT 'store', t, 'rows', n FROM (
    SELECT 'matches' AS t, count(*) AS n FROM (SELECT id FROM out1 WHERE outcome = 'inserted' UNION ALL SELECT id FROM out2 WHERE outcome = 'inserted')
    UNION ALL SELECT 'leagues', count(DISTINCT league) FROM (SELECT league, home, away FROM good1 UNION ALL SELECT league, home, away FROM good2)
    UNION ALL SELECT 'teams', count(DISTINCT (league, t)) FROM (SELECT league, unnest([home, away]) AS t FROM (SELECT league, home, away FROM good1 UNION ALL SELECT league, home, away FROM good2))
    UNION ALL SELECT 'snapshots', (SELECT count(DISTINCT id) FROM good1 WHERE k % 5 = 0) + (SELECT count(DISTINCT id) FROM good2 WHERE k % 5 = 0))"""


@query("src_15_manifest_ingest", _src_15_sql())
def src_15(spark, d):
    """Two provider runs into one store: the second repeats what the first stored, with kickoffs and teams moved. What was seen, inserted, existing, in conflict
    and rejected in each, and the rows stored in the end."""
    store = scratch(spark, "store")
    reports = []
    for run in RUNS:
        path, root = provider_run(spark, d, run)
        reports.append(manifest.ingest(spark, path, root, store, strict=False).withColumn("run", F.lit(run)))
    rows = [manifest.stored(spark, store, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("counter"), F.lit("rows").alias("name"), "n", F.lit("store").alias("run")) for t in manifest.TABLES]
    for r in rows:
        reports.append(r)
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out.select("run", "counter", "name", "n")


# --- SNK-02: a baseline of features, published by its manifest

FEATURES = ("goals", "gap", "pace")


@query("snk_02_baseline_manifest", f"""WITH {src.SETTLED}, f AS (SELECT league_id, match_date, (home_score + away_score)::DOUBLE AS goals, (home_score - away_score)::DOUBLE AS gap, CASE WHEN match_id % 41 = 0 THEN NULL ELSE match_id % 17 / 4.0::DOUBLE END AS pace FROM settled),
k AS (SELECT * FROM f WHERE pace IS NOT NULL), t AS (SELECT count(*) AS rows, (SELECT count(*) FROM f) - count(*) AS skipped, count(DISTINCT league_id) AS leagues, strftime(min(match_date), '%Y-%m-%d') AS first, strftime(max(match_date), '%Y-%m-%d') AS last FROM k)
SELECT feature, round(total, 6) AS total, rows, skipped, leagues, first, last, 1::BIGINT AS generation, sha256('[{{"dtype":"double","name":"goals"}},{{"dtype":"double","name":"gap"}},{{"dtype":"double","name":"pace"}}]') AS schema_sha256
FROM (SELECT 'goals' AS feature, sum(goals) AS total FROM k UNION ALL SELECT 'gap', sum(gap) FROM k UNION ALL SELECT 'pace', sum(pace) FROM k), t""")  # fmt: skip
def snk_02(spark, d):
    """The reference frame of the drift monitor, read back through its manifest. A later write that ended before its manifest stays invisible."""
    m = ops.settled(src.matches(spark, d))
    k = c("match_id")
    pace = F.when(k % 41 == 0, F.when(k % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(k % 17 / 4.0)
    f = m.select("league_id", "match_date", (c("home_score") + c("away_score")).cast("double").alias("goals"), (c("home_score") - c("away_score")).cast("double").alias("gap"), pace.alias("pace"))
    path = scratch(spark, "baseline")
    generation = published.baseline(f, path, list(FEATURES), "league_id", "match_date", minimum=1)
    published.stage(f.select(*FEATURES).limit(3), path)  # ended before its manifest
    body = published.manifest(spark, path)
    about = body["about"]
    sums = published.published(spark, path).agg(*[F.sum(x).alias(x) for x in FEATURES])
    told = [F.lit(v).cast(t).alias(n) for n, v, t in (("rows", body["rows"], "long"), ("skipped", about["skipped"], "long"), ("leagues", len(about["leagues"]), "long"), ("first", (about["start"] or "")[:10], "string"), ("last", (about["end"] or "")[:10], "string"), ("generation", generation, "long"), ("schema_sha256", body["schema_sha256"], "string"))]
    return sums.select(F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), F.round(x, 6).alias("total")) for x in FEATURES])).alias("x"), *told).select("x.*", *[n for n in ("rows", "skipped", "leagues", "first", "last", "generation", "schema_sha256")])


# --- UDF-09: versions of each league, registered with their scores; the best is promoted from the state that was seen


@query("udf_09_model_registry", f"WITH {SCORED}, r AS (SELECT league_id, model_version, count(*) AS n, avg(pow(p_h - y_h, 2) + pow(p_d - y_d, 2) + pow(p_a - y_a, 2)) AS brier FROM e GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY league_id ORDER BY round(brier, 9), model_version) AS place, count(*) OVER (PARTITION BY league_id) AS many FROM r) SELECT league_id, model_version, n, round(brier, 6) AS brier, CASE WHEN place = 1 THEN 'production' ELSE 'archived' END AS stage, CASE WHEN place = 1 AND many > 1 THEN 3 ELSE 2 + (many > 1)::INT END::BIGINT AS entry FROM k")
def udf_09(spark, d):
    """First the worst of each league goes live, then the best replaces it; a promotion from the state before that is refused."""
    brier = sum((F.pow(c(f"p_{k}") - c(f"y_{k}"), 2) for k in "hda"), F.lit(0.0))
    # a row for each league and version
    scores = scored(spark, d).groupBy("league_id", "model_version").agg(F.count("*").alias("n"), F.avg(brier).alias("b")).collect()
    registry = Registry(spark, scratch(spark, "registry"))
    registry.register([{"model_id": f"{r['league_id']}/{r['model_version']}", "scope": r["league_id"], "metrics": {"brier": round(r["b"], 9), "n": r["n"]}} for r in scores])
    leagues = sorted({r["league_id"] for r in scores})
    stale = registry.state()
    ranks = {x: registry.compared("brier", x) for x in leagues}
    registry.promote([ranks[x][-1] for x in leagues], stale)
    better = [ranks[x][0] for x in leagues if len(ranks[x]) > 1]
    if better:
        registry.promote(better, registry.state())
    try:
        registry.promote([ranks[x][-1] for x in leagues], stale)
        raise AssertionError("a promotion from an old state went through")
    except published.Conflict:
        pass
    k = registry.catalogue()
    return k.select(c("scope").alias("league_id"), F.substring_index("model_id", "/", -1).alias("model_version"), c("metrics")["n"].cast("long").alias("n"), F.round(c("metrics")["brier"], 6).alias("brier"), c("status").alias("stage"), "entry")


# --- STR-08: bounded buffers over the event stream


def _buffer_sql(size: int) -> str:
    quantiles = ", ".join(f"round(list_sort(list(value))[least(count(*), CAST(floor(count(*) * {q}::DOUBLE) AS BIGINT) + 1)], 6) AS p{int(q * 100)}" for q in buffers.QUANTILES)
    return f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most, {quantiles} FROM k WHERE r <= {size} GROUP BY 1"""


@query("str_08_sliding_buffers", _buffer_sql(buffers.SCRAPER_SAMPLES))
def str_08(spark, d, size=buffers.SCRAPER_SAMPLES, files=2):
    """The newest 500 samples of each kind of event. Half of the files are drained in a micro-batch each, the query ends, and one that starts from its checkpoint
    drains the rest; rows are dealt to the files regardless of time, so most are late."""
    folder, out, state = scratch(spark, "ticks"), scratch(spark, "buffers"), scratch(spark, "buffers-state")
    e = src.table(spark, d, "events").select("event_id", "event_type", "ts", "value")
    half = F.pmod(F.xxhash64("event_id"), F.lit(2)) == 0
    for part in (half, ~half):
        e.where(part).repartition(files).write.mode("append").parquet(folder)
        ticks = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        buffers.drain(buffers.buffered(ticks, ["event_type"], "value", "ts", "event_id", size), out, state)
    stats = buffers.latest(spark, out, ["event_type"])
    return stats.select("event_type", "n", *[F.round(n, 6).alias(n) for n, _ in buffers.STATS if n != "n"])
