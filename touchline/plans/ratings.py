"""Rating replays and what is read from their ledgers (SEQ)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.operators import matches as ops
from touchline.operators import ratings as rt
from touchline.plans.registry import query
from touchline.sources import adapters as src
from touchline.sources.scratch import scratch

# DuckDB replays a league as a recursive query whose state is a list of ratings
SEQUENCE = f"""WITH RECURSIVE {src.SETTLED},
k AS (SELECT *, row_number() OVER (PARTITION BY league_id ORDER BY match_date, match_id) AS i, CASE WHEN home_score > away_score THEN 1.0 WHEN home_score = away_score THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM settled)"""


@query("seq_04_berrar", SEQUENCE + """,
r(league_id, i, state, match_id, h, a) AS (
  SELECT league_id, 0::BIGINT, list_transform(range(20), lambda x: 1500.0::DOUBLE), NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE FROM (SELECT DISTINCT league_id FROM k)
  UNION ALL SELECT r.league_id, k.i, list_transform(range(20), lambda x: r.state[x + 1] + CASE WHEN x = k.home_id THEN 1 WHEN x = k.away_id THEN -1 ELSE 0 END * 31.36::DOUBLE * (k.score - 1 / (1 + pow(10, (r.state[k.away_id + 1] - r.state[k.home_id + 1]) / 400)))), k.match_id, r.state[k.home_id + 1], r.state[k.away_id + 1]
  FROM r JOIN k ON k.league_id = r.league_id AND k.i = r.i + 1)
SELECT match_id, round(h, 4) AS berrar_home, round(a, 4) AS berrar_away FROM r WHERE match_id IS NOT NULL""")
def seq_04(spark, d):
    return rt.pi_berrar(ops.settled(src.matches(spark, d))).select("match_id", F.round("berrar_home", 4).alias("berrar_home"), F.round("berrar_away", 4).alias("berrar_away"))


@query("seq_03_pi", SEQUENCE + """,
r(league_id, i, att, def, match_id, ad, dd) AS (
  SELECT league_id, 0::BIGINT, list_transform(range(20), lambda x: 0.0::DOUBLE), list_transform(range(20), lambda x: 0.0::DOUBLE), NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE FROM (SELECT DISTINCT league_id FROM k)
  UNION ALL SELECT league_id, i, list_transform(range(20), lambda x: att[x + 1] + CASE WHEN goals = 0 THEN 0 WHEN x = home_id THEN 0.03::DOUBLE * (home_score / goals - eh) WHEN x = away_id THEN 0.03::DOUBLE * (away_score / goals - ea) ELSE 0 END),
    list_transform(range(20), lambda x: def[x + 1] - CASE WHEN goals = 0 THEN 0 WHEN x = home_id THEN 0.03::DOUBLE * (home_score / goals - eh) WHEN x = away_id THEN 0.03::DOUBLE * (away_score / goals - ea) ELSE 0 END), match_id, att[home_id + 1] - att[away_id + 1], def[away_id + 1] - def[home_id + 1]
  FROM (SELECT r.league_id, k.i, r.att, r.def, k.match_id, home_id, away_id, home_score, away_score, (home_score + away_score)::DOUBLE AS goals, 1 / (1 + exp(-(r.att[home_id + 1] - r.def[away_id + 1]))) AS eh, 1 / (1 + exp(-(r.att[away_id + 1] - r.def[home_id + 1]))) AS ea
        FROM r JOIN k ON k.league_id = r.league_id AND k.i = r.i + 1))
SELECT match_id, round(ad, 3) AS attack_diff, round(dd, 3) AS defence_diff FROM r WHERE match_id IS NOT NULL""".replace("round(ad, 3)", "round(round(ad, 4), 3)").replace("round(dd, 3)", "round(round(dd, 4), 3)"))
def seq_03(spark, d):
    return rt.pi_berrar(ops.settled(src.matches(spark, d))).select("match_id", F.round("attack_diff", 3).alias("attack_diff"), F.round("defence_diff", 3).alias("defence_diff"))


#: Elo with carry-over. State by team: rating after its last match, rating before that match's date, the date, the season; by league: date, season, sum and number of the
#: season's ratings before the date and on it.
ELO = SEQUENCE + """,
q AS (SELECT *, year(match_date) - (month(match_date) < 7)::INT AS season, 20.0::DOUBLE * CASE league_id WHEN '1-URGENT' THEN 1.2 WHEN '2-HIGH' THEN 1.0 WHEN '3-MEDIUM' THEN 1.0 ELSE 0.9 END AS kf FROM k),
r(league_id, i, post, pre, day, seas, d, s, fs, fn, ps, pn, match_id, h, a, h2, a2) AS (
  SELECT league_id, 0::BIGINT, list_transform(range(20), lambda x: 1500.0::DOUBLE), list_transform(range(20), lambda x: 1500.0::DOUBLE), list_transform(range(20), lambda x: NULL::TIMESTAMP), list_transform(range(20), lambda x: NULL::BIGINT),
    NULL::TIMESTAMP, NULL::BIGINT, 0::DOUBLE, 0::BIGINT, 0::DOUBLE, 0::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM (SELECT DISTINCT league_id FROM q)
  UNION ALL SELECT league_id, i, list_transform(range(20), lambda x: CASE x WHEN home_id THEN h + delta WHEN away_id THEN a - delta ELSE post[x + 1] END),
    list_transform(range(20), lambda x: CASE WHEN x = home_id AND day[x + 1] IS DISTINCT FROM moment THEN h WHEN x = away_id AND day[x + 1] IS DISTINCT FROM moment THEN a ELSE pre[x + 1] END),
    list_transform(range(20), lambda x: CASE WHEN x IN (home_id, away_id) THEN moment ELSE day[x + 1] END), list_transform(range(20), lambda x: CASE WHEN x IN (home_id, away_id) THEN season ELSE seas[x + 1] END),
    moment, season, fs, fn, ps + h + a, pn + 2, match_id, h, a, h + delta, a - delta
  FROM (SELECT *, kf * (score - 1 / (1 + pow(10, (a - h - 100) / 400))) AS delta
    FROM (SELECT *, CASE WHEN seas[home_id + 1] IS NULL THEN 1500 WHEN seas[home_id + 1] <> season AND day[home_id + 1] <> moment THEN mean + 0.5::DOUBLE * (bh - mean) ELSE bh END AS h,
        CASE WHEN seas[away_id + 1] IS NULL THEN 1500 WHEN seas[away_id + 1] <> season AND day[away_id + 1] <> moment THEN mean + 0.5::DOUBLE * (ba - mean) ELSE ba END AS a
      FROM (SELECT *, CASE WHEN fn = 0 THEN 1500.0::DOUBLE ELSE fs / fn END AS mean
        FROM (SELECT r.league_id, q.i, post, pre, day, seas, q.match_date AS moment, q.season, home_id, away_id, score, kf, q.match_id,
            CASE WHEN q.season IS DISTINCT FROM r.s THEN 0 WHEN q.match_date <> r.d THEN fs + ps ELSE fs END AS fs, CASE WHEN q.season IS DISTINCT FROM r.s THEN 0 WHEN q.match_date <> r.d THEN fn + pn ELSE fn END AS fn,
            CASE WHEN q.match_date IS DISTINCT FROM r.d THEN 0 ELSE ps END AS ps, CASE WHEN q.match_date IS DISTINCT FROM r.d THEN 0 ELSE pn END AS pn,
            CASE WHEN day[home_id + 1] = q.match_date THEN pre[home_id + 1] ELSE post[home_id + 1] END AS bh, CASE WHEN day[away_id + 1] = q.match_date THEN pre[away_id + 1] ELSE post[away_id + 1] END AS ba
          FROM r JOIN q ON q.league_id = r.league_id AND q.i = r.i + 1)))))"""
RATINGS = ["home_pre", "away_pre", "home_post", "away_post"]
RATINGS_SQL = "round(h, 4) AS home_pre, round(a, 4) AS away_pre, round(h2, 4) AS home_post, round(a2, 4) AS away_post"


@query("seq_01_elo", ELO + f" SELECT league_id, match_id, {RATINGS_SQL} FROM r WHERE match_id IS NOT NULL")
def seq_01(spark, d):
    r = rt.elo(ops.settled(src.matches(spark, d)))
    return r.select("league_id", "match_id", *[F.round(c, 4).alias(c) for c in RATINGS])


@query("seq_02_elo_context")
def seq_02(spark, d):
    """Ratings, difference and five-match trend as of each match, strictly before its date."""
    m = ops.settled(src.matches(spark, d))
    led = rt.ledger(rt.elo(m), m).withColumn("move", F.col("post") - F.col("pre"))
    w = Window.partitionBy("league_id", "team").orderBy("match_date", "match_id").rowsBetween(-4, 0)
    led = led.withColumn("trend", F.avg("move").over(w)).select("league_id", "team", "match_date", "match_id", "post", "trend")
    rows = ops.team_rows(m).select("league_id", "team", "match_id", "match_date")
    seen = ops.as_of(rows, led, ["league_id", "team"], "match_date", "match_date", ["post", "trend"], ["match_id"])
    return seen.select("match_id", "team", F.round(F.coalesce("post", F.lit(rt.ELO_BASE)), 4).alias("rating"), F.round(F.coalesce("trend", F.lit(0.0)), 4).alias("trend"), F.col("post").isNotNull().alias("resolved"))


WEIGHTS = [0.7**i for i in range(10)]


def _form_sql(value: str, none: float) -> str:
    """The weighted mean of a team's last ten values before the row."""
    top = " + ".join(f"coalesce({w!r}::DOUBLE * lag({value}, {i + 1}) OVER f, 0)" for i, w in enumerate(WEIGHTS))
    under = " + ".join(f"CASE WHEN lag({value}, {i + 1}) OVER f IS NULL THEN 0 ELSE {w!r}::DOUBLE END" for i, w in enumerate(WEIGHTS))
    return f"round(coalesce(({top}) / nullif({under}, 0), {none}), 4)"


@query("seq_05_phase8", SEQUENCE + f""",
r(league_id, i, att, def, ber, match_id, home_id, away_id, ah, dh, aa, da, bh, ba) AS (
  SELECT league_id, 0::BIGINT, list_transform(range(20), lambda x: 0.0::DOUBLE), list_transform(range(20), lambda x: 0.0::DOUBLE), list_transform(range(20), lambda x: 1500.0::DOUBLE), NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM (SELECT DISTINCT league_id FROM k)
  UNION ALL SELECT league_id, i, list_transform(range(20), lambda x: att[x + 1] + CASE WHEN goals = 0 THEN 0 WHEN x = home_id THEN 0.03::DOUBLE * (home_score / goals - eh) WHEN x = away_id THEN 0.03::DOUBLE * (away_score / goals - ea) ELSE 0 END),
    list_transform(range(20), lambda x: def[x + 1] - CASE WHEN goals = 0 THEN 0 WHEN x = home_id THEN 0.03::DOUBLE * (home_score / goals - eh) WHEN x = away_id THEN 0.03::DOUBLE * (away_score / goals - ea) ELSE 0 END),
    list_transform(range(20), lambda x: ber[x + 1] + CASE x WHEN home_id THEN 1 WHEN away_id THEN -1 ELSE 0 END * 31.36::DOUBLE * (score - 1 / (1 + pow(10, (ba - bh) / 400)))),
    match_id, home_id, away_id, att[home_id + 1], def[home_id + 1], att[away_id + 1], def[away_id + 1], bh, ba
  FROM (SELECT r.league_id, k.i, r.att, r.def, r.ber, k.match_id, k.home_id, k.away_id, score, home_score, away_score, (home_score + away_score)::DOUBLE AS goals, ber[k.home_id + 1] AS bh, ber[k.away_id + 1] AS ba, 1 / (1 + exp(-(r.att[k.home_id + 1] - r.def[k.away_id + 1]))) AS eh, 1 / (1 + exp(-(r.att[k.away_id + 1] - r.def[k.home_id + 1]))) AS ea
        FROM r JOIN k ON k.league_id = r.league_id AND k.i = r.i + 1)),
sides AS (SELECT league_id, match_id, match_date, home_id AS team, score FROM k UNION ALL SELECT league_id, match_id, match_date, away_id, 1 - score FROM k),
forms AS (SELECT league_id, match_id, team, {_form_sql('(score = 1)::INT', 0.5)} AS win, {_form_sql('(score = 0.5)::INT', 0.333)} AS draw, {_form_sql('CASE score WHEN 1 THEN 3 WHEN 0.5 THEN 1 ELSE 0 END', 1.0)} AS ppg FROM sides WINDOW f AS (PARTITION BY league_id, team ORDER BY match_date, match_id))
SELECT r.league_id, r.match_id, round(ah, 4) AS home_pi_attack, round(dh, 4) AS home_pi_defense, round(aa, 4) AS away_pi_attack, round(da, 4) AS away_pi_defense, round(ah - aa, 4) AS pi_attack_diff, round(da - dh, 4) AS pi_defense_diff,
  round(bh, 2) AS home_berrar_rating, round(ba, 2) AS away_berrar_rating, round(bh - ba, 2) AS berrar_rating_diff, h.win AS home_weighted_win_rate, h.draw AS home_weighted_draw_rate, h.ppg AS home_weighted_ppg, g.win AS away_weighted_win_rate, g.draw AS away_weighted_draw_rate, g.ppg AS away_weighted_ppg
FROM r JOIN forms h ON h.league_id = r.league_id AND h.match_id = r.match_id AND h.team = home_id JOIN forms g ON g.league_id = r.league_id AND g.match_id = r.match_id AND g.team = away_id""")
def seq_05(spark, d):
    """Pi, Berrar and weighted form of both sides before each match, from one replay."""
    return rt.phase8_columns(ops.settled(src.matches(spark, d)))


CUT = "1995-06-01"


def half_ledger(spark, d):
    """The settled matches and the ledger of those before ``CUT``, written and read back."""
    m, path = ops.settled(src.matches(spark, d)), scratch(spark, "elo")
    rt.elo_ledger(m.where(F.col("match_date") < CUT)).write.parquet(path)
    return m, path


@query("seq_07_resumed_replay", ELO + f" SELECT r.league_id, r.match_id, r.i AS seq, {RATINGS_SQL} FROM r WHERE match_id IS NOT NULL")
def seq_07_resumed(spark, d, limit=500):
    """A ledger that holds the first half, continued by a run over the oldest 500 pending matches and one over the rest, is the whole replay's."""
    m, path = half_ledger(spark, d)
    for most in (limit, None):
        now = spark.read.parquet(path)
        rt.resumed(m, now, most).where("status = 'replayed'").drop("status").write.mode("append").parquet(path)
        spark.catalog.refreshByPath(path)
    return spark.read.parquet(path).select("league_id", "match_id", "seq", *[F.round(c, 4).alias(c) for c in RATINGS])


@query("seq_06_refused_leagues", f"WITH {src.SETTLED}, f AS (SELECT league_id, min({{'t': match_date, 'id': match_id}}) AS first FROM settled WHERE match_date < '{CUT}' GROUP BY 1) SELECT league_id, CASE WHEN league_id IN ('2-HIGH', '3-MEDIUM') THEN 'refused' ELSE 'replayed' END AS status, CASE WHEN league_id IN ('2-HIGH', '3-MEDIUM') THEN 1 ELSE count(*) END AS n FROM settled JOIN f USING (league_id) WHERE match_date >= '{CUT}' GROUP BY 1")
def seq_06_refused(spark, d):
    """A score that changed and a match that came late, each in one league: both are refused, the others go on."""
    m, path = half_ledger(spark, d)
    first = m.where(F.col("match_date") < CUT).groupBy("league_id").agg(F.min(F.struct("match_date", "match_id")).alias("f")).select("league_id", F.col("f.match_id").alias("match_id"), F.lit(True).alias("is_first"))
    changed = m.join(first, ["league_id", "match_id"], "left").withColumn("home_score", F.col("home_score") + F.when(F.col("is_first") & (F.col("league_id") == "2-HIGH"), 1).otherwise(0))
    late = changed.where("is_first and league_id = '3-MEDIUM'").withColumn("match_id", -F.col("match_id") - 1)
    return rt.resumed(changed.unionByName(late), spark.read.parquet(path)).groupBy("league_id", "status").agg(F.count("*").alias("n"))


@query("seq_07_incremental_pending", f"WITH {src.SETTLED} SELECT match_id FROM settled WHERE match_id % 3 <> 0 ORDER BY match_date, match_id LIMIT 500")
def seq_07(spark, d, limit=500):
    """Matches without a ledger row, oldest first, at most one batch."""
    m = ops.settled(src.matches(spark, d))
    done = m.where("match_id % 3 = 0").select("match_id")
    return m.join(done, "match_id", "left_anti").orderBy("match_date", "match_id").limit(limit).select("match_id")
