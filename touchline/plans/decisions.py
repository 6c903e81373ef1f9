"""Betting decisions over whole markets: efficiency reports, exchange prices, board captures, quality scores, the verdict gate and its ranking (MKT)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.functions import market as mk
from touchline.operators import matches as ops
from touchline.plans.market import BOTH, EVENT, IDS, IDS_SQL, TOTAL, joined, outcomes, outcomes_sql
from touchline.plans.registry import ORACLE_SQL, query
from touchline.sources import adapters as src

S, M, N = src.SETTLED, src.MATCHES, src.SNAPSHOTS
c = lambda name: F.col(name)


def up(x, places=6):
    """Rounded; 1e-9 decides halves, which the engines round differently."""
    return F.round(x + 1e-9, places)


def up_sql(x, places=6):
    return f"round({x} + 1e-9, {places})"


def picked(cond: dict, otherwise):
    """The first value whose condition holds."""
    out = None
    for value, when in cond.items():
        out = F.when(when, value) if out is None else out.when(when, value)
    return out.otherwise(otherwise)


# ---- MKT-07: a report a market ----

KELLY = "greatest(0, (j.p_{k} * j.odds_{k} - 1) / (j.odds_{k} - 1))"
_BETS = ", ".join(f"{{'kelly': round({KELLY.format(k=k)}, 9), 'rank': {i}, 'ev': j.p_{k} * j.odds_{k} - 1, 'p': j.p_{k}, 'fair': 1 / j.odds_{k} / {TOTAL.replace('odds', 'j.odds')}, 'sharp': s.p_{k}}}" for k, i in zip("hda", (0, -1, -2)))


@query("mkt_07_report", f"""WITH {BOTH}, s AS ({ORACLE_SQL['mkt_05_power_devig']}), b AS (SELECT j.*, list_filter([{_BETS}], lambda x: x.ev > 0) AS bets FROM j JOIN s ON s.odds_h = j.odds_h AND s.odds_d = j.odds_d AND s.odds_a = j.odds_a),
k AS (SELECT *, list_sort(bets, 'DESC') AS ranked FROM b)
SELECT {IDS_SQL}, round({TOTAL} - 1, 6) AS margin, CASE WHEN {TOTAL} - 1 < 0.04 THEN 'sharp' ELSE 'standard' END AS sharpness, len(bets) AS n_value, array_to_string(list_transform(ranked, lambda x: substr('hda', 1 - x.rank, 1)), ',') AS ranking,
 {up_sql('ranked[1].kelly')} AS kelly, {up_sql('ranked[1].ev')} AS ev, {up_sql('ranked[1].p - ranked[1].fair')} AS edge, {up_sql('ranked[1].sharp', 4)} AS sharp_p FROM k""")
def mkt_07_report(spark, d):
    """Margin, sharpness and all bets of positive value of a market, strongest stake first (ties: home, draw, away), with the power-method probability of
    the first. Each different price triple is de-vigged once, and joined back on the triple."""
    odds = ["odds_h", "odds_d", "odds_a"]
    j = joined(spark, d)
    triples = mk.power(j.select(*odds).distinct(), odds, [f"s_{k}" for k in "hda"])
    j = j.join(triples, odds)
    fair = mk.proportional(*map(c, odds))
    bet = lambda k, i: F.struct(F.round(mk.kelly(c(f"p_{k}"), c(f"odds_{k}")), 9).alias("kelly"), F.lit(-i).alias("rank"), mk.ev(c(f"p_{k}"), c(f"odds_{k}")).alias("ev"), c(f"p_{k}").alias("p"), fair[i].alias("fair"), F.round(f"s_{k}", 5).alias("sharp"))
    bets = F.sort_array(F.filter(F.array(*[bet(k, i) for i, k in enumerate("hda")]), lambda x: x["ev"] > 0), asc=False)
    j = j.withColumns({"margin": mk.margin(*map(c, odds)), "bets": bets}).withColumn("best", F.get("bets", F.lit(0)))
    names = F.array_join(F.transform("bets", lambda x: F.substring(F.lit("hda"), 1 - x["rank"], F.lit(1))), ",")
    return j.select(*IDS, F.round("margin", 6).alias("margin"), F.when(c("margin") < 0.04, "sharp").otherwise("standard").alias("sharpness"), F.size("bets").cast("long").alias("n_value"), names.alias("ranking"),
                    up(c("best.kelly")).alias("kelly"), up(c("best.ev")).alias("ev"), up(c("best.p") - c("best.fair")).alias("edge"), up(c("best.sharp"), 4).alias("sharp_p"))


# ---- MKT-21: both quality scorers ----

SCORE = "least(100::DOUBLE, greatest(0::DOUBLE, ((p * odds - 1) * 100 + confidence * 50 + (part_no % 10) / 10.0::DOUBLE * 25) / 1.75::DOUBLE))"
SCORED_BETS = f"""o AS ({outcomes_sql('j', 'p', 'odds')}), q AS (SELECT *, round({SCORE}, 9) AS score, round((p - 1 / odds) * (odds - 1), 4) AS edge FROM o),
t AS (SELECT *, CASE WHEN score >= 80 THEN 'Excellent' WHEN score >= 60 THEN 'Good' WHEN score >= 40 THEN 'Fair' ELSE 'Poor' END AS tier, CASE WHEN edge > 0.08 AND confidence > 0.75 THEN 'PREMIUM' WHEN edge > 0.05 AND confidence > 0.65 THEN 'VALUE' WHEN edge > 0.02 AND confidence > 0.55 THEN 'MARGINAL' ELSE 'AVOID' END AS label FROM q)"""


@query("mkt_21_quality_scores", f"WITH {BOTH}, {SCORED_BETS} SELECT outcome, tier, label, count(*) AS n, round(avg(score), 4) AS score, round(avg(edge), 6) AS edge FROM t GROUP BY ALL")
def mkt_21_scores(spark, d):
    """The score of value, confidence and liquidity (0 to 100, four tiers) beside the label by edge and confidence, for all three outcomes."""
    o = outcomes(joined(spark, d), "p", "odds")
    raw = (mk.ev(c("p"), c("odds")) * 100 + c("confidence") * 50 + c("part_no") % 10 / 10.0 * 25) / 1.75
    q = o.withColumns({"score": F.round(mk.clamp(raw, 0, 100), 9), "edge": F.round((c("p") - 1 / c("odds")) * (c("odds") - 1), 4)})
    sure = lambda edge, conf: (c("edge") > edge) & (c("confidence") > conf)
    tier = picked({"Excellent": c("score") >= 80, "Good": c("score") >= 60, "Fair": c("score") >= 40}, "Poor")
    label = picked({"PREMIUM": sure(0.08, 0.75), "VALUE": sure(0.05, 0.65), "MARGINAL": sure(0.02, 0.55)}, "AVOID")
    return q.groupBy("outcome", tier.alias("tier"), label.alias("label")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("score"), F.round(F.avg("edge"), 6).alias("edge"))


# ---- MKT-24: back and lay ----

@query("mkt_24_exchange", f"""WITH {BOTH}, o AS ({outcomes_sql('j', 'p', 'odds')}), x AS (SELECT *, odds AS back, max(odds) OVER (PARTITION BY match_id, outcome) AS lay, part_no % 1000 AS liquidity, sum(part_no % 1000) OVER (PARTITION BY match_id, outcome) AS total_liquidity FROM o),
k AS (SELECT *, p - 1 / back AS b, 1 / lay - p AS l FROM x)
SELECT {IDS_SQL}, outcome, round(back, 6) AS back, round(lay, 6) AS lay, {up_sql('lay - back', 4)} AS spread, {up_sql('b * 100', 4)} AS back_edge, {up_sql('l * 100', 4)} AS lay_edge, {up_sql('(p * (back - 1) - (1 - p)) * 100', 4)} AS back_ev, {up_sql('((1 - p) - p * (lay - 1)) * 100', 4)} AS lay_ev,
 CASE WHEN round(b, 9) > round(l, 9) THEN 'back' WHEN round(l, 9) > 0.02 THEN 'lay' ELSE 'pass' END AS recommended, CAST(liquidity AS BIGINT) AS liquidity, CAST(total_liquidity AS BIGINT) AS total_liquidity, {up_sql(f'({TOTAL} - 1) * 100', 4)} AS margin_pct FROM k""")
def mkt_24_exchange(spark, d):
    """Every quote as a back price against the longest price of its match and outcome as the lay price: edges, values, spread, liquidity of the quote and of the outcome."""
    j = joined(spark, d).withColumn("margin", mk.margin(c("odds_h"), c("odds_d"), c("odds_a")))
    w = Window.partitionBy("match_id", "outcome")
    x = outcomes(j, "p", "odds").withColumn("liquidity", c("part_no") % 1000).withColumns({"lay": F.max("odds").over(w), "total_liquidity": F.sum("liquidity").over(w)})
    p, back, lay = c("p"), c("odds"), c("lay")
    x = x.withColumns({"b": p - 1 / back, "l": 1 / lay - p})
    call = picked({"back": F.round("b", 9) > F.round("l", 9), "lay": F.round("l", 9) > 0.02}, "pass")
    out = {"spread": lay - back, "back_edge": c("b") * 100, "lay_edge": c("l") * 100, "back_ev": (p * (back - 1) - (1 - p)) * 100, "lay_ev": ((1 - p) - p * (lay - 1)) * 100, "margin_pct": c("margin") * 100}
    return x.select(*IDS, "outcome", F.round(back, 6).alias("back"), F.round(lay, 6).alias("lay"), *[up(v, 4).alias(n) for n, v in out.items()], call.alias("recommended"), "liquidity", "total_liquidity")


# ---- MKT-28: boards ----

#: Prices that round to the same multiple of this are the same quote.
TICK = 1.0
_SAME = "coalesce(" + " AND ".join(f"q_{k} = lag(q_{k}) OVER w" for k in "hda") + ", FALSE)"


@query("mkt_28_board_observations", f"""WITH {M}, {N}, g AS (SELECT {EVENT} AS event, captured_at, min({{'b': bookmaker, 'a': match_id, 'n': snap_no, 'p': part_no, 's': supp_no, 'h': round(odds_h), 'd': round(odds_d), 'x': round(odds_a), 'c': is_closing}}) FILTER (isfinite({TOTAL}) AND round({TOTAL}, 9) BETWEEN 0.7 AND 1.25) AS o, count(*) AS offers FROM snaps GROUP BY 1, 2),
k AS (SELECT event, captured_at, o.b AS bookmaker, offers, o.h AS q_h, o.d AS q_d, o.x AS q_a, o.c AS closing, captured_at < match_date AS pre FROM g JOIN matches ON match_id = o.a),
l AS (SELECT *, row_number() OVER w = 1 AS first, {_SAME} AS same FROM k WINDOW w AS (PARTITION BY event, pre ORDER BY captured_at))
SELECT event, captured_at, bookmaker, offers, CASE WHEN NOT pre THEN 'rejected' WHEN closing THEN 'closing' WHEN same THEN 'deduped' WHEN first THEN 'opening' ELSE 'intermediate' END AS class FROM l""")
def mkt_28_observations(spark, d, tick=TICK):
    """One observation of each board (an event's quotes of one time): the coherent quote of the first bookmaker. At or after kickoff it is rejected; a
    closing one always stays; any other whose prices repeat the observation before is dropped. A dropped one repeats the last one kept, so the
    one before tells both."""
    s = src.snapshots(spark, d).withColumn("total", F.round(1 + mk.margin(c("odds_h"), c("odds_d"), c("odds_a")), 9))
    quote = [F.round(c(f"odds_{k}") / tick).alias(f"q_{k}") for k in "hda"]
    least = F.min(F.when(c("total").between(0.7, 1.25), F.struct("bookmaker", "match_id", "snap_no", "part_no", "supp_no", *quote, "is_closing"))).alias("o")
    g = s.groupBy(F.floor(c("match_id") / 32).alias("event"), "captured_at").agg(least, F.count("*").alias("offers")).where("o IS NOT NULL")
    k = g.select("event", "captured_at", "offers", "o.*").join(src.matches(spark, d).select("match_id", "match_date"), "match_id").withColumn("pre", c("captured_at") < c("match_date"))
    w = Window.partitionBy("event", "pre").orderBy("captured_at")
    same = F.coalesce((F.lag("q_h").over(w) == c("q_h")) & (F.lag("q_d").over(w) == c("q_d")) & (F.lag("q_a").over(w) == c("q_a")), F.lit(False))
    k = k.withColumns({"same": same, "first": F.row_number().over(w) == 1})
    return k.select("event", "captured_at", "bookmaker", "offers", picked({"rejected": ~c("pre"), "closing": c("is_closing"), "deduped": c("same"), "opening": c("first")}, "intermediate").alias("class"))


# ---- MKT-30, -31, -33: scores, verdicts, ranking ----

#: The edges of the gate, the market's total, the stake's share and cap, the doubt that forbids high conviction, bookmakers that it needs.
MIN_EDGE, HIGH_EDGE, TOTALS, SHARE, CAP, DOUBT, OWNERS = 0.042, 0.062, (0.90, 1.20), 0.25, 0.05, 0.05, 4
#: Days from a capture to kickoff: fresh up to the first, recent up to the second (the tables have days where live prices have minutes).
FRESH_DAYS, RECENT_DAYS, LINEUP_DAYS = 20, 60, 2
#: The range of the sharp signal, and the league that is never above ACTIONABLE.
SIGNAL, CUP = 0.02, "1-URGENT"

_EACH = ", ".join(f"{{'cav': round(CASE WHEN ev_{k} > 0 AND e_{k} > 0 THEN ev_{k} * (1 - doubt) ELSE 0 END, 9), 'rank': {i}, 'outcome': '{k}', 'p': p_{k}, 'odds': odds_{k}, 'ev': ev_{k}, 'edge': e_{k}, 'drift': ln(odds_{k} / open_{k})}}" for k, i in zip("hda", (0, -1, -2)))
_OPEN = ", ".join(f"first_value(odds_{k}) OVER (PARTITION BY match_id ORDER BY captured_at, snap_no, part_no, supp_no) AS open_{k}" for k in "hda")
GATED = f"""{M}, {BOTH}, w AS (SELECT j.*, league_id, match_date, {_OPEN}, (1 - confidence) / 10 AS doubt FROM j JOIN matches USING (match_id)), n AS (SELECT match_id, count(DISTINCT bookmaker) AS owners FROM j GROUP BY 1),
v0 AS (SELECT w.*, owners, round({TOTAL}, 9) AS total, date_diff('day', CAST(captured_at AS DATE), CAST(match_date AS DATE)) AS days, {", ".join(f"p_{k} * odds_{k} - 1 AS ev_{k}, p_{k} - 1 / odds_{k} / {TOTAL} AS e_{k}" for k in "hda")} FROM w JOIN n USING (match_id)),
v1 AS (SELECT *, list_max([{_EACH}]) AS best FROM v0),
v2 AS (SELECT *, round(best.ev, 9) AS ev, round(best.edge, 9) AS edge, CASE WHEN best.ev > 0 AND best.edge > 0 THEN least({CAP}::DOUBLE, best.ev / (best.odds - 1) * {SHARE}::DOUBLE) ELSE 0 END AS stake, confidence < 0.4 OR model_version <> 'F' OR days > {RECENT_DAYS} OR (days <= {LINEUP_DAYS} AND NOT is_closing) AS blocked, round(best.drift, 9) > {SIGNAL} AS against FROM v1),
gated AS (SELECT *, CASE WHEN days < 0 OR total NOT BETWEEN {TOTALS[0]} AND {TOTALS[1]} OR owners = 0 THEN 'PARTIAL' WHEN ev <= 0 OR edge <= 0 OR stake <= 0 THEN 'NO_BET' WHEN owners = 1 OR blocked OR (against AND edge < {MIN_EDGE}) THEN 'HOLD' WHEN edge < {MIN_EDGE} THEN 'SPECULATIVE'
 WHEN days > {FRESH_DAYS} OR league_id = '{CUP}' OR owners < {OWNERS} THEN 'ACTIONABLE' WHEN edge >= {HIGH_EDGE} AND round(doubt, 9) <= {DOUBT} AND is_closing AND NOT against THEN 'HIGH_CONVICTION' ELSE 'ACTIONABLE' END AS verdict FROM v2)"""


def gated(spark, d):
    """Each quote's best outcome (most value after doubt; ties home, draw, away) and the first verdict that fits: PARTIAL without a sound market before
    kickoff, NO_BET without value, HOLD for one bookmaker, little confidence, an unvalidated model, an old price or an open line-up, SPECULATIVE under
    the least edge, and HIGH_CONVICTION only for fresh closing prices of at least four bookmakers outside the cup. One shuffle, by match."""
    odds = [c(f"odds_{k}") for k in "hda"]
    fair = mk.proportional(*odds)
    doubt = (1 - c("confidence")) / 10

    def each(k, i):
        ev, edge = mk.ev(c(f"p_{k}"), odds[i]), c(f"p_{k}") - fair[i]
        cav = F.round(F.when((ev > 0) & (edge > 0), ev * (1 - doubt)).otherwise(0.0), 9)
        return F.struct(cav.alias("cav"), F.lit(-i).alias("rank"), F.lit(k).alias("outcome"), c(f"p_{k}").alias("p"), odds[i].alias("odds"), ev.alias("ev"), edge.alias("edge"))

    # the best outcome is known before the window, which keeps the expressions on either side of it small enough to be compiled
    j = joined(spark, d).withColumns({"best": F.array_max(F.array(*[each(k, i) for i, k in enumerate("hda")])), "doubt": doubt, "total": F.round(1 + mk.margin(*odds), 9)})
    j = j.join(src.matches(spark, d).select("match_id", "league_id", "match_date"), "match_id").withColumn("days", F.datediff(F.to_date("match_date"), F.to_date("captured_at")))
    seen = Window.partitionBy("match_id")
    first = F.first(F.struct(*[f"odds_{k}" for k in "hda"])).over(seen.orderBy("captured_at", "snap_no", "part_no", "supp_no"))
    j = j.withColumns({"open": first, "owners": F.size(F.collect_set("bookmaker").over(seen)).cast("long")})
    opened = F.when(c("best.outcome") == "h", c("open.odds_h")).when(c("best.outcome") == "d", c("open.odds_d")).otherwise(c("open.odds_a"))
    j = j.withColumn("drift", F.ln(c("best.odds") / opened))
    j = j.withColumns({"ev": F.round("best.ev", 9), "edge": F.round("best.edge", 9), "against": F.round("drift", 9) > SIGNAL})
    stake = F.when((c("best.ev") > 0) & (c("best.edge") > 0), mk.kelly(c("best.p"), c("best.odds"), SHARE, CAP)).otherwise(0.0)
    blocked = (c("confidence") < 0.4) | (c("model_version") != "F") | (c("days") > RECENT_DAYS) | ((c("days") <= LINEUP_DAYS) & ~c("is_closing"))
    j = j.withColumns({"stake": stake, "blocked": blocked})
    verdict = {
        "PARTIAL": (c("days") < 0) | ~c("total").between(*TOTALS) | (c("owners") == 0),
        "NO_BET": (c("ev") <= 0) | (c("edge") <= 0) | (c("stake") <= 0),
        "HOLD": (c("owners") == 1) | c("blocked") | (c("against") & (c("edge") < MIN_EDGE)),
        "SPECULATIVE": c("edge") < MIN_EDGE,
    }
    high = (c("days") <= FRESH_DAYS) & (c("league_id") != CUP) & (c("owners") >= OWNERS) & (c("edge") >= HIGH_EDGE) & (F.round("doubt", 9) <= DOUBT) & c("is_closing") & ~c("against")
    return j.withColumn("verdict", picked(verdict | {"HIGH_CONVICTION": high}, "ACTIONABLE"))


@query("mkt_31_outcome_gate", f"WITH {GATED} SELECT {IDS_SQL}, best.outcome AS outcome, {up_sql('best.ev')} AS ev, {up_sql('best.edge')} AS edge, {up_sql('stake')} AS stake, {up_sql('best.cav')} AS value, owners, verdict FROM gated")
def mkt_31_gate(spark, d):
    return gated(spark, d).select(*IDS, c("best.outcome").alias("outcome"), up(c("best.ev")).alias("ev"), up(c("best.edge")).alias("edge"), up(c("stake")).alias("stake"), up(c("best.cav")).alias("value"), "owners", "verdict")


_ORDER = f"best.cav DESC, ev DESC, days, {IDS_SQL}"


@query("mkt_33_watchlist", f"""WITH {GATED}, t AS (SELECT {IDS_SQL}, 'top' AS list, row_number() OVER (ORDER BY {_ORDER}) AS place, {up_sql('best.cav')} AS value, {up_sql('ev')} AS ev FROM gated WHERE verdict IN ('ACTIONABLE', 'HIGH_CONVICTION') AND best.cav > 0)
SELECT * FROM t WHERE place <= 3 UNION ALL SELECT {IDS_SQL}, 'watch', NULL, {up_sql('best.cav')}, {up_sql('ev')} FROM gated WHERE verdict = 'SPECULATIVE' AND best.cav > 0""")
def mkt_33_watch(spark, d, top=3):
    """The three first by value after doubt, value, age and ids; beside them the whole watchlist of speculative quotes, with the columns that order it."""
    g = gated(spark, d).where("best.cav > 0").select(*IDS, "days", "ev", c("best.cav").alias("cav"), "verdict")
    best = g.where(c("verdict").isin("ACTIONABLE", "HIGH_CONVICTION")).orderBy(F.desc("cav"), F.desc("ev"), "days", *IDS).limit(top)
    place = F.row_number().over(Window.orderBy(F.desc("cav"), F.desc("ev"), "days", *IDS)).cast("long")
    shown = lambda df, name, at: df.select(*IDS, F.lit(name).alias("list"), at.alias("place"), up(c("cav")).alias("value"), up(c("ev")).alias("ev"))
    return shown(best, "top", place).unionByName(shown(g.where("verdict = 'SPECULATIVE'"), "watch", F.lit(None).cast("long")))


#: Inputs of the quality scores that can be missing: the prices of three outcomes outside the usable range.
USABLE = (1.5, 4.0)
_GAPS = " + ".join(f"(odds_{k} NOT BETWEEN {USABLE[0]} AND {USABLE[1]})::INT" for k in "hda")
_CLIP = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, {}))".format


@query("mkt_30_quality_scores", f"""WITH {GATED}, k AS (SELECT *, 1 - ({_GAPS}) / 3.0::DOUBLE AS whole, CASE WHEN best.p = greatest(p_h, p_d, p_a) AND odds_h BETWEEN {USABLE[0]} AND {USABLE[1]} THEN -best.drift ELSE 0 END AS toward FROM gated)
SELECT {IDS_SQL}, {up_sql(_CLIP(f"0.4::DOUBLE * {_CLIP('(confidence - 0.333::DOUBLE) / 0.5')} + 0.3::DOUBLE * {_CLIP('edge / 0.15::DOUBLE')} + 0.2::DOUBLE * {_CLIP('toward / 0.05::DOUBLE')} + 0.1::DOUBLE * whole"), 4)} AS full_score,
 {up_sql(_CLIP(f"0.4::DOUBLE * confidence + 0.3::DOUBLE * least(1, edge * 10) + 0.2::DOUBLE * CASE WHEN days >= 0 THEN greatest(0.0::DOUBLE, 1 - days / {RECENT_DAYS}.0::DOUBLE) ELSE 0 END + 0.1::DOUBLE * whole"), 3)} AS board_score FROM k""")
def mkt_30_scores(spark, d):
    """Both scores: confidence over chance, edge, drift towards the called outcome and completeness; and the board's, with freshness for drift. What isn't known adds nothing."""
    odds = [c(f"odds_{k}").between(*USABLE) for k in "hda"]
    whole = 1 - sum(((~o).cast("int") for o in odds), F.lit(0)) / 3.0
    toward = F.when((c("best.p") == F.greatest("p_h", "p_d", "p_a")) & odds[0], -c("drift")).otherwise(0.0)
    unit = lambda x: mk.clamp(x, 0, 1)
    full = 0.4 * unit((c("confidence") - 0.333) / 0.5) + 0.3 * unit(c("edge") / 0.15) + 0.2 * unit(toward / 0.05) + 0.1 * whole
    fresh = F.when(c("days") >= 0, F.greatest(F.lit(0.0), 1 - c("days") / float(RECENT_DAYS))).otherwise(0.0)
    board = 0.4 * c("confidence") + 0.3 * F.least(F.lit(1.0), c("edge") * 10) + 0.2 * fresh + 0.1 * whole
    return gated(spark, d).select(*IDS, up(unit(full), 4).alias("full_score"), up(unit(board), 3).alias("board_score"))


# ---- MKT-34: abstaining stakes with rewards ----

#: The doubt over which nothing is staked, the cap of a stake, the reward of abstaining.
ABSTAIN, STAKE_CAP, PRIZE = 0.55, 0.05, 0.05


@query("mkt_34_rewards", f"""WITH {BOTH}, k AS (SELECT *, CASE WHEN p_d > p_h THEN CASE WHEN p_a > p_d THEN 'a' ELSE 'd' END WHEN p_a > p_h THEN 'a' ELSE 'h' END AS pick FROM j),
l AS (SELECT *, CASE pick WHEN 'h' THEN odds_h WHEN 'd' THEN odds_d ELSE odds_a END AS o, 1 - confidence > {ABSTAIN} AS abstain FROM k),
s AS (SELECT *, CASE WHEN abstain THEN 0 ELSE least({STAKE_CAP}::DOUBLE, greatest(0, (confidence * o - 1) / (o - 1))) END AS stake FROM l), r AS (SELECT *, CASE WHEN abstain THEN 0 ELSE least(1, stake * (o - 1)) END AS pnl FROM s)
SELECT {IDS_SQL}, pick, abstain, {up_sql('stake')} AS stake, {up_sql('pnl')} AS r_pnl, {up_sql('2 * confidence - 1')} AS r_ic, {up_sql('confidence - 1')} AS r_cal, {up_sql('CASE WHEN abstain THEN 0 ELSE greatest(-1, least(1, pnl - stake)) END')} AS r_risk, CASE WHEN abstain THEN {PRIZE}::DOUBLE ELSE 0 END AS r_abs FROM r""")
def mkt_34_rewards(spark, d):
    """A Kelly stake on the likeliest outcome (the first of equals) unless doubt is too large, with the five parts of its reward."""
    p_h, p_d, p_a = (c(f"p_{k}") for k in "hda")
    j = joined(spark, d).withColumn("pick", F.when(p_d > p_h, F.when(p_a > p_d, "a").otherwise("d")).when(p_a > p_h, "a").otherwise("h"))
    j = j.withColumns({"o": F.when(c("pick") == "h", c("odds_h")).when(c("pick") == "d", c("odds_d")).otherwise(c("odds_a")), "abstain": 1 - c("confidence") > ABSTAIN})
    staked = lambda x: F.when(c("abstain"), 0.0).otherwise(x)
    j = j.withColumn("stake", staked(mk.kelly(c("confidence"), c("o"), 1.0, STAKE_CAP)))
    j = j.withColumn("pnl", staked(F.least(F.lit(1.0), c("stake") * (c("o") - 1))))
    parts = {"stake": c("stake"), "r_pnl": c("pnl"), "r_ic": mk.clamp(2 * c("confidence") - 1, -1, 1), "r_cal": c("confidence") - 1, "r_risk": staked(mk.clamp(c("pnl") - c("stake"), -1, 1))}
    return j.select(*IDS, "pick", "abstain", *[up(x).alias(n) for n, x in parts.items()], F.when(c("abstain"), PRIZE).otherwise(0.0).alias("r_abs"))


# ---- MKT-35: bets inside JSON ----

@query("mkt_35_nested_bets", f"""WITH {BOTH}, o AS ({outcomes_sql('j', 'p', 'odds')}), b AS (SELECT *, round((p - 1 / odds) * 100 + 1e-9, 4) AS edge_percent, round(confidence, 4) AS conf FROM o)
SELECT {IDS_SQL}, outcome, edge_percent, conf AS confidence FROM b WHERE edge_percent >= 4.2 AND conf >= 0.5 ORDER BY edge_percent DESC, {IDS_SQL}, outcome LIMIT 50""")
def mkt_35_nested(spark, d, least=4.2, confidence=0.5, top=50):
    """Bets kept as an array inside each prediction's JSON: written as text, parsed with a schema (text that isn't JSON and members that lack a number go),
    exploded, filtered, and the ``top`` of them by edge. Spark keeps ``top`` rows a task for the order."""
    bet = lambda k: F.struct(F.lit(k).alias("outcome"), up((c(f"p_{k}") - 1 / c(f"odds_{k}")) * 100, 4).alias("edge_percent"), F.round("confidence", 4).alias("confidence"))
    stored = joined(spark, d).select(*IDS, F.to_json(F.struct(F.array(*map(bet, "hda")).alias("value_bets"))).alias("features"))
    return nested_bets(stored, "features", IDS, least, confidence).orderBy(F.desc("edge_percent"), *IDS, "outcome").limit(top)


def nested_bets(stored, column, keys, least, confidence):
    """The bets of ``value_bets`` in each row's JSON text with at least the given edge and confidence."""
    schema = "value_bets array<struct<outcome: string, edge_percent: double, confidence: double>>"
    bets = stored.select(*keys, F.explode(F.from_json(column, schema)["value_bets"]).alias("b")).select(*keys, "b.*")
    return bets.where((c("edge_percent") >= least) & (c("confidence") >= confidence))


# ---- MKT-36: importance by position and rounds left, stages of a cup ----

#: The importance of a cup's stages, in their order.
STAGES = {"qualifying": 0.70, "group": 0.50, "r16": 0.80, "qf": 0.90, "sf": 0.95, "final": 1.00}
ROUNDS, SIZE = 38, 20


def _stakes(pos: str) -> str:
    return f"CASE WHEN {pos} > {SIZE - 2} AND r <= 10 THEN least(1, (11 - r) / 10.0::DOUBLE) WHEN {pos} <= 2 AND r <= 8 THEN least(1, (9 - r) / 8.0::DOUBLE) WHEN {pos} <= 6 AND r <= 6 THEN least(0.7::DOUBLE, (7 - r) / 8.0::DOUBLE) ELSE 0 END"


@query("mkt_36_match_importance", f"""WITH {src.TEAM_ROWS}, sums AS (SELECT league_id, team, sum(points) AS p, sum(gf - ga) AS gd, sum(gf) AS f FROM team_rows GROUP BY 1, 2), st AS (SELECT league_id, team, row_number() OVER (PARTITION BY league_id ORDER BY p DESC, gd DESC, f DESC, team) AS position FROM sums),
g AS (SELECT *, greatest(1, {ROUNDS} + 1 - row_number() OVER (PARTITION BY league_id, team, year(match_date) ORDER BY match_date, match_id, is_home)) AS r FROM team_rows), k AS (SELECT g.*, h.position AS ph, a.position AS pa, (month(match_date) - 1) // 2 AS stage FROM g JOIN st h ON h.league_id = g.league_id AND h.team = g.team JOIN st a ON a.league_id = g.league_id AND a.team = g.opponent WHERE is_home)
SELECT match_id, CASE WHEN league_id = '{CUP}' THEN [{", ".join(f"{x}::DOUBLE" for x in STAGES.values())}][stage + 1] ELSE round(greatest({_stakes("ph")}, {_stakes("pa")}) + 1e-9, 3) END AS importance, CAST(r AS BIGINT) AS rounds_left, league_id = '{CUP}' AS cup FROM k""")
def mkt_36_match(spark, d):
    """What a match is worth to the side that it means more to: relegation, title and places in Europe as the season of the home team runs out; a cup's by its
    stage (two months each). Positions are those of the league's table."""
    m = src.matches(spark, d)
    season = Window.partitionBy("league_id", "team", F.year("match_date")).orderBy("match_date", "match_id", "is_home")
    g = ops.team_rows(ops.settled(m)).withColumn("r", F.greatest(F.lit(1), ROUNDS + 1 - F.row_number().over(season))).where("is_home")
    st = ops.standings(m).select("league_id", "team", "position")
    g = g.join(st.withColumnRenamed("position", "ph"), ["league_id", "team"]).join(st.select("league_id", c("team").alias("opponent"), c("position").alias("pa")), ["league_id", "opponent"])

    def stakes(pos):
        r = c("r")
        part = lambda most, of, cap=1.0: F.least(F.lit(cap), (most + 1 - r) / of)
        return F.when((pos > SIZE - 2) & (r <= 10), part(10, 10.0)).when((pos <= 2) & (r <= 8), part(8, 8.0)).when((pos <= 6) & (r <= 6), part(6, 8.0, 0.7)).otherwise(0.0)

    cup = c("league_id") == CUP
    stage = F.get(F.array(*map(F.lit, STAGES.values())), F.floor((F.month("match_date") - 1) / 2).cast("int"))
    return g.select("match_id", F.when(cup, stage).otherwise(up(F.greatest(stakes(c("ph")), stakes(c("pa"))), 3)).alias("importance"), c("r").cast("long").alias("rounds_left"), cup.alias("cup"))


#: The cap of a full Kelly stake in each league; others have the last.
LEAGUE_CAPS, OTHER_CAP = {"1-URGENT": 0.03, "2-HIGH": 0.025}, 0.02


@query("mkt_40_league_edges", f"""WITH {M}, {BOTH}, o AS ({outcomes_sql("j", "p", "odds")}), b AS (SELECT league_id, outcome, p - 1 / odds AS edge, least(CASE league_id {" ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in LEAGUE_CAPS.items())} ELSE {OTHER_CAP}::DOUBLE END, greatest(0, (p * (odds - 1) - (1 - p)) / (odds - 1))) AS stake, confidence FROM o JOIN matches USING (match_id) WHERE odds > 1.01 AND round(p - 1 / odds, 9) > {MIN_EDGE})
SELECT league_id, outcome, count(*) AS bets, round(avg(edge) * 100, 4) AS edge_pct, round(avg(stake) * 100, 4) AS stake_pct, round(sum(edge) * 100, 2) AS clv_cents, round(avg(confidence), 6) AS confidence FROM b GROUP BY ALL""")
def mkt_40_edges(spark, d):
    """Bets over the least raw edge by league and outcome: edge, Kelly stake up to the league's cap, the cents of edge taken over all of them, confidence."""
    o = outcomes(joined(spark, d), "p", "odds").withColumn("edge", c("p") - 1 / c("odds")).where((c("odds") > 1.01) & (F.round("edge", 9) > MIN_EDGE))
    cap = picked({v: c("league_id") == k for k, v in LEAGUE_CAPS.items()}, OTHER_CAP)
    b = o.join(src.matches(spark, d).select("match_id", "league_id"), "match_id").withColumn("stake", F.least(cap, mk.kelly(c("p"), c("odds"))))
    return b.groupBy("league_id", "outcome").agg(F.count("*").alias("bets"), F.round(F.avg("edge") * 100, 4).alias("edge_pct"), F.round(F.avg("stake") * 100, 4).alias("stake_pct"), F.round(F.sum("edge") * 100, 2).alias("clv_cents"), F.round(F.avg("confidence"), 6).alias("confidence"))
