"""Provider manifests into leagues, teams, matches and market snapshots.

A manifest is a JSON document that names its payload files with their SHA-256. It is checked first (fields, versions, status), then
every file against its digest. Payloads whose path holds ``fixtures-`` are JSON arrays of fixtures; they are read, taken apart and judged
in one pass over the files whose digest was checked: each fixture gets ids, a UTC kickoff, a season and the first fault that applies, in the
order of ``FAULTS``. By default one fault rejects the whole manifest; ``strict=False`` sets the faulty rows aside and
counts them.

Local times: a time that the clocks skip counts with the offset before the change, one that they
repeat is the first of the two; ``clock`` says gap, fold or plain.

Rows are inserted if their id is absent. A match that is stored already, or came earlier in the manifest, with other teams or another kickoff is a conflict named by what
differs; equal ones are counted as existing. Leagues and teams go first, then matches, then snapshots, so that a
run that ends early is completed by the same manifest again.
"""

from __future__ import annotations

import json
from collections import Counter
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.sources.scratch import scratch

#: Competitions by code, as (name, country).
COMPETITIONS = {
    "EPL": ("Premier League", "England"), "CHAMPIONSHIP": ("Championship", "England"), "LA_LIGA": ("La Liga", "Spain"), "SERIE_A": ("Serie A", "Italy"),
    "BUNDESLIGA": ("Bundesliga", "Germany"), "LIGUE_1": ("Ligue 1", "France"), "EREDIVISIE": ("Eredivisie", "Netherlands"),
}
#: What a manifest must have, and what it may say.
REQUIRED = ("manifest_version", "run_id", "source_id", "adapter_version", "schema_version", "started_at", "completed_at", "status", "record_count", "raw_files", "processed_files", "payload_hashes", "freshness", "errors", "licence")
VERSIONS, ADAPTERS, STATUSES = ("1.0", "2.0"), ("1.0.0", "2.0.0"), ("SUCCESS", "PARTIAL")
#: Id formats.
ROW_PREFIX, ROW_DIGITS, TEAM_PREFIX, TEAM_DIGITS = "fdco-", 24, "fdco-team-", 20

ROW = """league string, match_date string, match_time string, source_timezone string, home_team string, away_team string, home_goals double, away_goals double, source_native_id string,
market string"""
MARKET = "bookmaker string, coherent boolean, raw_odds struct<home:double,draw:double,away:double>, devigged_probabilities struct<home:double,draw:double,away:double>"
FAULTS = (
    "not_an_object", "unknown_competition", "teams_missing_or_ambiguous", "time_missing", "time_invalid", "zone_unknown", "finished_in_future",
    "market_not_coherent", "market_incomplete", "odds_malformed", "probabilities_malformed", "probabilities_not_one",
)
TABLES = {
    "leagues": "id string, name string, country string", "teams": "id string, name string, league_id string",
    "matches": "id string, league_id string, home_team_id string, away_team_id string, match_date timestamp, season string, status string, home_score int, away_score int",
    "snapshots": "match_id string, provider string, bookmaker string, captured_at timestamp, home_odds double, draw_odds double, away_odds double, p_home double, p_draw double, p_away double, run_id string",
}


class ManifestError(ValueError):
    """The manifest, a payload or a row of it can't be trusted."""


def checked_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest without its file lists, after the checks that need no payload."""
    try:
        body = json.loads(spark.read.text(path, wholetext=True).first()[0])
    except (AnalysisException, ValueError, TypeError) as e:
        raise ManifestError(f"{path} is no JSON document") from e
    if missing := [k for k in REQUIRED if k not in body]:
        raise ManifestError(f"manifest lacks {', '.join(sorted(missing))}")
    if body["manifest_version"] not in VERSIONS or body["adapter_version"] not in ADAPTERS:
        raise ManifestError("unsupported manifest_version or adapter_version")
    if body["manifest_version"] == "2.0" and not all(isinstance(body.get(k), str) and body[k].strip() for k in ("registry_version", "attribution")):
        raise ManifestError("version 2.0 requires registry_version and attribution")
    if body["status"] not in STATUSES:
        raise ManifestError(f"status {body['status']} can't be ingested")
    if not isinstance(body["payload_hashes"], dict) or not all(isinstance(body[k], list) for k in ("raw_files", "processed_files")):
        raise ManifestError("payload_hashes must be an object, raw_files and processed_files lists")
    for entry in [*body["raw_files"], *body["processed_files"]]:
        named = isinstance(entry, str) and entry or isinstance(entry, dict) and all(isinstance(entry.get(k), str) and entry[k] for k in ("file", "object_key", "hash"))
        if not named or isinstance(entry, dict) and (entry["object_key"].startswith("/") or ".." in entry["object_key"].split("/")):
            raise ManifestError("a file entry is incomplete or has an unsafe object_key")
    return body


def payload_files(spark: SparkSession, body: dict, root: str) -> DataFrame:
    """path, payload (its number in order of paths), content of the payloads; ``ManifestError`` if one is outside ``root``, missing or other than its digest.
    The manifest's list goes to the files, so that no content is shuffled."""
    entries = [(e, body["payload_hashes"].get(e)) if isinstance(e, str) else (e["file"], body["payload_hashes"].get(e["file"], e["hash"])) for e in [*body["raw_files"], *body["processed_files"]]]
    bare = lambda p: p.removeprefix("file:").replace("///", "/")
    root = bare(root).rstrip("/") + "/"
    if any(not bare(p).startswith(root) or "/../" in p or p.endswith(".tmp") for p, _ in entries):
        raise ManifestError("a payload is outside the data root or unfinished")
    if not entries:
        raise ManifestError("the manifest names no payload")
    number = {p: n for n, p in enumerate(sorted({bare(p) for p, _ in entries}))}
    named = spark.createDataFrame([(bare(p), h, number[bare(p)]) for p, h in entries], "path string, expected string, payload int").distinct()
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace(F.regexp_replace("path", "^file:", ""), "^/+", "/").alias("path"), "content")
    found = there.join(F.broadcast(named), "path")
    digests = found.select("path", F.sha2("content", 256).eqNullSafe(F.col("expected")).alias("same"))
    wrong = named.join(digests, "path", "left").where(~F.coalesce("same", F.lit(False))).select("path").limit(3).collect()
    if wrong:
        raise ManifestError(f"missing or altered: {', '.join(r['path'] for r in wrong)}")
    return found.select("path", "payload", "content")


def clock_parts(day: Column, time: Column) -> tuple[Column, Column]:
    """Local date and time as a text that Spark reads, null if no format fits; dd/MM/yyyy, dd/MM/yy and yyyy-MM-dd with H:mm."""
    two = lambda x: F.lpad(x, 2, "0")
    parts = lambda text, sep: (F.substring_index(text, sep, 1), F.substring_index(F.substring_index(text, sep, 2), sep, -1), F.substring_index(text, sep, -1))
    # a pattern's $ lets a line's end follow
    day, time = (F.rtrim(x, F.lit("\n\r\u0085\u2028\u2029")) for x in (day, time))
    (d, m, y), (year, month, date) = parts(day, "/"), parts(day, "-")
    y = F.when(F.length(y) == 2, F.concat(F.when(y < "69", "20").otherwise("19"), y)).otherwise(y)
    local = F.when(day.rlike(r"^\d{1,2}/\d{1,2}/(\d{4}|\d{2})$"), F.concat_ws("-", y, two(m), two(d))).when(day.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.concat_ws("-", year, two(month), two(date)))
    return local, F.when(time.rlike(r"^\d{1,2}:\d{1,2}$"), F.concat_ws(":", two(F.substring_index(time, ":", 1)), two(F.substring_index(time, ":", -1))))


def to_utc(local: Column, zone: Column) -> tuple[Column, Column]:
    """(UTC time, clock) of a local time; null if the zone is unknown. Skipped times count with the earlier offset, repeated ones are the first."""
    zone = known_zone(zone)
    utc = F.to_utc_timestamp(local, zone)
    return utc, clock_at(local, utc, zone)


def known_zone(zone: Column) -> Column:
    return F.when(zone.isin(*sorted(_zones())), zone)


def clock_at(local: Column, utc: Column, zone: Column) -> Column:
    back = lambda t: F.from_utc_timestamp(t, zone)
    later = lambda t, n: t + F.expr(f"INTERVAL {n} MINUTES")
    again = reduce(lambda a, b: a | b, [back(later(utc, n)) == local for n in (30, 60, 120)])
    # no zone's clocks change twice within two hours, so few rows need the third test
    return F.when(utc.isNotNull(), F.when(back(utc) != local, "gap").when(back(later(utc, 120)) == later(local, 120), "plain").when(again, "fold").otherwise("plain"))


def _zones() -> set[str]:
    from zoneinfo import available_timezones

    return {z for z in available_timezones() if "/" in z or z in ("UTC", "GMT")} - {"localtime"}


def fixtures(files: DataFrame, body: dict) -> DataFrame:
    """Every row of the fixture payloads, judged: ``fault`` is null where it may be stored."""
    acquired = F.lit(body["completed_at"]).cast("timestamp")
    rows = files.where(F.contains("path", F.lit("fixtures-"))).select("payload", F.from_json(F.decode("content", "UTF-8"), "array<string>").alias("rows"))
    rows = rows.select("payload", F.posexplode_outer("rows").alias("place", "raw")).where("raw is not null")
    r = rows.withColumn("r", F.when(F.ltrim("raw").startswith("{"), F.from_json("raw", ROW, {"mode": "PERMISSIVE"}))).select("payload", "place", "r.*", F.col("r").isNotNull().alias("is_object")).withColumnRenamed("market", "market_text")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    home, away = F.col("home"), F.col("away")
    # each step a column that the next ones read, so that no expression is laid out again in each of its uses
    r = r.withColumns({"home": blank("home_team"), "away": blank("away_team"), "zone": known_zone(blank("source_timezone")), **dict(zip(("day", "hour"), clock_parts(blank("match_date"), blank("match_time"))))})
    r = r.withColumns({"market": F.from_json("market_text", MARKET), "local": F.concat("day", F.lit(" "), "hour").try_cast("timestamp"), "home_low": F.lower(home), "away_low": F.lower(away)})
    r = r.withColumns({"kickoff": F.to_utc_timestamp("local", F.col("zone")), "finished": F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull()})
    r = r.withColumn("clock", clock_at(F.col("local"), F.col("kickoff"), F.col("zone")))
    odds, probs = [F.col(f"market.raw_odds.{k}") for k in ("home", "draw", "away")], [F.col(f"market.devigged_probabilities.{k}") for k in ("home", "draw", "away")]
    has_market = F.col("market_text").isNotNull()
    all_of = lambda cs, ok: reduce(lambda a, b: a & b, [F.coalesce(ok(x), F.lit(False)) for x in cs])
    rules = dict(
        zip(
            FAULTS,
            (
                ~F.col("is_object"), ~F.coalesce(F.col("league").isin(*COMPETITIONS), F.lit(False)), (home == "") | (away == "") | (F.col("home_low") == F.col("away_low")),
                (blank("match_date") == "") | (blank("match_time") == "") | (blank("source_timezone") == ""), F.col("local").isNull(), F.col("kickoff").isNull(), F.col("finished") & (F.col("kickoff") > acquired),
                has_market & ~F.coalesce(F.col("market.coherent"), F.lit(False)), has_market & (F.col("market.raw_odds").isNull() | F.col("market.devigged_probabilities").isNull()),
                has_market & ~all_of(odds, lambda x: (x > 1) & ~F.isnan(x)), has_market & ~all_of(probs, lambda x: (x >= 0) & (x <= 1)), has_market & (F.abs(sum(probs[1:], probs[0]) - 1.0) > 1e-6),
            ),
        )
    )
    fault = reduce(lambda rest, k: F.when(rules[k], F.lit(k)).otherwise(rest), reversed(FAULTS), F.lit(None).cast("string"))
    key = F.concat_ws("|", *[F.coalesce(F.col(k), F.lit("")) for k in ("league", "match_date", "match_time", "home_team", "away_team")])
    native = blank("source_native_id")
    team = lambda name: F.concat(F.lit(TEAM_PREFIX), F.substring(F.sha2(F.concat_ws("|", "league", f"{name}_low"), 256), 1, TEAM_DIGITS))
    year = F.year("kickoff") - F.when(F.month("kickoff") >= 7, 0).otherwise(1)
    return r.select(
        "payload", "place", "league", "home", "away", "kickoff", "clock", "finished", "market", has_market.alias("has_market"), fault.alias("fault"), F.when(native != "", native).otherwise(F.concat(F.lit(ROW_PREFIX), F.substring(F.sha2(key, 256), 1, ROW_DIGITS))).alias("id"),
        team("home").alias("home_id"), team("away").alias("away_id"), F.concat_ws("/", year.cast("string"), (year + 1).cast("string")).alias("season"), F.col("home_goals").cast("int").alias("home_score"), F.col("away_goals").cast("int").alias("away_score"),
    )


def stored(spark: SparkSession, store: str, name: str) -> DataFrame:
    """A table of the store; empty before the first insert."""
    try:
        return spark.read.schema(TABLES[name]).parquet(f"{store.rstrip('/')}/{name}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], TABLES[name])


def compared(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """``rows`` with ``outcome``: rejected, inserted, existing, or conflict with ``differs``. Rows with an id meet in order of
    payload and place: the first is stored unless the id is, and the others are judged against what is stored."""
    identity = F.struct(F.col("home_id").alias("home"), F.col("away_id").alias("away"), F.col("kickoff").alias("kickoff"))
    before = matches.select("id", F.struct(F.col("home_team_id").alias("home"), F.col("away_team_id").alias("away"), F.col("match_date").alias("kickoff")).alias("known"))
    good = rows.where("fault is null").withColumn("identity", identity).join(before, "id", "left")
    w = Window.partitionBy("id").orderBy("payload", "place")
    good = good.withColumns({"first": F.first("identity").over(w), "nth": F.row_number().over(w)}).withColumn("against", F.coalesce("known", "first"))
    names = F.array_compact(F.array(*[F.when(F.col(f"identity.{k}") != F.col(f"against.{k}"), F.lit(k)) for k in ("home", "away", "kickoff")]))
    good = good.withColumn("differs", F.array_join(names, "+"))
    outcome = F.when(F.col("known").isNull() & (F.col("nth") == 1), "inserted").when(F.col("differs") != "", "conflict").otherwise("existing")
    good = good.withColumn("outcome", outcome).drop("identity", "known", "first", "nth", "against")
    bad = rows.where("fault is not null").withColumns({"differs": F.lit(""), "outcome": F.lit("rejected")})
    return good.unionByName(bad)


def _insert(new: DataFrame, old: DataFrame, keys: list[str], path: str) -> None:
    new.dropDuplicates(keys).join(old, keys, "left_anti").write.mode("append").parquet(path)


def _aside(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession, "fixtures")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ingest(spark: SparkSession, path: str, root: str, store: str, commit: bool = True, strict: bool = True) -> DataFrame:
    """(counter, name, n): fixtures by outcome, faults and conflicts by name, snapshots inserted and existing, rows that features may use or not, rows by
    competition. Without ``commit`` nothing is stored."""
    body = checked_manifest(spark, path)
    rows = _aside(fixtures(payload_files(spark, body, root), body))  # taken apart once
    judged = _aside(compared(rows, stored(spark, store, "matches")))  # against the store as it was
    captured = F.lit(body["completed_at"]).cast("timestamp")
    # one pass for all counters; only rows that are stored have a league, one of a fixed list, and a clock
    kept = F.col("outcome").isin("inserted", "existing")
    marks = {k: F.when(kept, v) for k, v in {"league": F.col("league"), "clock": F.col("clock"), "quoted": F.col("has_market"), "eligible": F.col("finished") & (F.col("kickoff") <= captured)}.items()}
    told = judged.groupBy("outcome", "fault", "differs", *[v.alias(k) for k, v in marks.items()]).count().collect()
    counts = Counter()
    for r in told:
        counts[r["outcome"], r["fault"], r["differs"]] += r["count"]
    if not counts:
        raise ManifestError("the manifest has no fixture rows")
    if strict and (wrong := {k: n for k, n in counts.items() if k[0] in ("rejected", "conflict")}):
        raise ManifestError("; ".join(f"{o} {f or d}: {n}" for (o, f, d), n in sorted(wrong.items(), key=str)))
    good = judged.where(kept)
    names = F.create_map(*[F.lit(x) for k, v in COMPETITIONS.items() for x in (k, v[0])]), F.create_map(*[F.lit(x) for k, v in COMPETITIONS.items() for x in (k, v[1])])
    odds = [F.col(f"market.raw_odds.{k}").alias(f"{k}_odds") for k in ("home", "draw", "away")]
    probs = [F.col(f"market.devigged_probabilities.{k}").alias(f"p_{k}") for k in ("home", "draw", "away")]
    snaps = good.where("has_market").select(F.col("id").alias("match_id"), F.lit(body["source_id"]).alias("provider"), F.coalesce("market.bookmaker", F.lit("")).alias("bookmaker"), captured.alias("captured_at"), *odds, *probs, F.lit(body["run_id"]).alias("run_id"))
    snap_key = ["match_id", "provider", "bookmaker", "captured_at"]
    old_snaps = stored(spark, store, "snapshots").select(snap_key)
    new_snaps = snaps.dropDuplicates(snap_key).join(old_snaps, snap_key, "left_anti").count()
    stored_told = [r for r in told if r["outcome"] in ("inserted", "existing")]
    all_snaps, eligible = (sum(r["count"] for r in stored_told if r[k]) for k in ("quoted", "eligible"))
    by = lambda k: {x: sum(r["count"] for r in stored_told if r[k] == x) for x in {r[k] for r in stored_told}}
    if commit:
        at = store.rstrip("/")
        teams = good.select(F.explode(F.array(*[F.struct(F.col(f"{s}_id").alias("id"), F.col(s).alias("name"), F.col("league").alias("league_id")) for s in ("home", "away")])).alias("t")).select("t.*")
        # of the spellings of a name the first
        teams = teams.groupBy("id").agg(F.min("name").alias("name"), F.min("league_id").alias("league_id"))
        _insert(good.select(F.col("league").alias("id"), names[0][F.col("league")].alias("name"), names[1][F.col("league")].alias("country")), stored(spark, store, "leagues").select("id"), ["id"], f"{at}/leagues")
        _insert(teams, stored(spark, store, "teams").select("id"), ["id"], f"{at}/teams")
        score = lambda s: F.when(F.col("finished"), F.col(f"{s}_score")).alias(f"{s}_score")
        fresh = good.where("outcome = 'inserted'").select("id", F.col("league").alias("league_id"), F.col("home_id").alias("home_team_id"), F.col("away_id").alias("away_team_id"), F.col("kickoff").alias("match_date"), "season", F.when(F.col("finished"), "finished").otherwise("scheduled").alias("status"), score("home"), score("away"))
        _insert(fresh, stored(spark, store, "matches").select("id"), ["id"], f"{at}/matches")
        _insert(snaps, old_snaps, snap_key, f"{at}/snapshots")
    total = lambda outcome: sum(n for k, n in counts.items() if k[0] == outcome)
    out = [("fixtures", "seen", sum(counts.values())), *[("fixtures", o, total(o)) for o in ("inserted", "existing", "conflict", "rejected")]]
    out += [("fault", f, n) for (o, f, _), n in counts.items() if o == "rejected"] + [("conflict", d, n) for (o, _, d), n in counts.items() if o == "conflict"]
    stored_rows = total("inserted") + total("existing")
    out += [("snapshots", "inserted", new_snaps), ("snapshots", "existing", all_snaps - new_snaps), ("features", "eligible", eligible), ("features", "not_eligible", stored_rows - eligible)]
    out += [(name, x, n) for name, k in (("competition", "league"), ("clock", "clock")) for x, n in by(k).items()]
    return spark.createDataFrame([(a, b, int(n)) for a, b, n in out], "counter string, name string, n long")
