"""Sequential rating replays in bounded memory: Elo with a durable ledger, Pi and Berrar ratings, weighted form.

A league's matches change each other's inputs, so a league is replayed in order of (date, match_id) by one task. It is not held there: rows are
dealt by league, sorted within partitions by Spark (which spills), and streamed through the task in Arrow batches; what
stays in memory is a row for each team of the league at hand, however many matches it has. Self-play rows and rows without
scores are skipped; of the listings of a match the earliest counts.

The Elo ledger has a row a match with its place in the league's sequence and a chain: the digest of the chain before it and of
the match as it was replayed. ``resumed`` goes on from a ledger: the state is read from its rows (the last of each team, the last of each
league), the matches up to there are only hashed, and where the chain differs from the ledger's (a match came late, changed or went) the league is
refused instead of being continued from a state that never was.
"""

from __future__ import annotations

import hashlib
import math
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the rating systems.
ELO_BASE, ELO_K, ELO_HOME, ELO_CARRY = 1500.0, 20.0, 100.0, 0.5
IMPORTANCE = {"1-URGENT": 1.2, "2-HIGH": 1.0, "3-MEDIUM": 1.0, "4-NOT SPECIFIED": 0.9, "5-LOW": 0.9}
PI_RATE = 0.030
BERRAR_BASE, BERRAR_K, BERRAR_DECAY = 1500.0, 32.0, 0.98
FORM_ALPHA, FORM_WINDOW, FORM_NONE = 0.7, 10, (0.50, 0.333, 1.0)

COLUMNS = ["league_id", "match_id", "home_id", "away_id", "match_date", "home_score", "away_score"]
#: What a replay reads of a match; dates as microseconds.
MATCH = "league_id string, match_id long, at long, season int, home_id long, away_id long, home_score long, away_score long"
PHASE8 = ("home_pi_attack", "home_pi_defense", "away_pi_attack", "away_pi_defense", "home_berrar_rating", "away_berrar_rating", *[f"{s}_weighted_{x}" for s in ("home", "away") for x in ("win_rate", "draw_rate", "ppg")])
PHASE8_SCHEMA = "league_id string, match_id long, " + ", ".join(f"{c} double" for c in PHASE8)
LEDGER_SCHEMA = f"""{MATCH}, seq long, home_pre double, away_pre double, home_post double, away_post double,
season_sum double, season_n long, day_sum double, day_n long, chain string"""


def played(matches: DataFrame) -> DataFrame:
    """The matches that count, once each, as ``MATCH``; seasons start in July."""
    day = F.col("match_date").cast("timestamp")
    m = matches.select("league_id", F.col("match_id").cast("long").alias("match_id"), F.unix_micros(day).alias("at"), (F.year(day) - F.when(F.month(day) >= 7, 0).otherwise(1)).alias("season"), *[F.col(c).cast("long").alias(c) for c in ("home_id", "away_id", "home_score", "away_score")])
    m = m.where("home_id <> away_id and home_score >= 0 and away_score >= 0 and at is not null")
    first = m.groupBy("league_id", "match_id").agg(F.min(F.struct("at", "season", "home_id", "away_id", "home_score", "away_score")).alias("m"))
    return first.select("league_id", "match_id", "m.*").select(*[f.name for f in T._parse_datatype_string(MATCH).fields])


def streamed(rows: DataFrame, order: list[str], make: Callable[[str], Callable[[dict], list[tuple]]], schema: str) -> DataFrame:
    """Rows of each league in ``order`` through ``make(league)``, which gives the output rows of one input row."""
    names, kinds = rows.columns, T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        shape, league, step = to_arrow_schema(kinds), object(), None
        for batch in batches:
            out = []
            for values in zip(*[c.to_pylist() for c in batch.columns]):
                row = dict(zip(names, values))
                if row["league_id"] != league:
                    league = row["league_id"]
                    step = make(league)
                out += step(row)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(shape), shape)], schema=shape)

    return rows.repartition("league_id").sortWithinPartitions("league_id", *order).mapInArrow(run, kinds)


def outcome(home: int, away: int) -> float:
    return 1.0 if home > away else 0.5 if home == away else 0.0


class Elo:
    """One league's ratings. A rating and the season's mean are read strictly before the match's date: of two matches at one time both
    start from the rating before it. The first match of a season pulls a team to the mean of the season so far."""

    def __init__(self, league: str):
        self.teams: dict[int, tuple] = {}  # team -> (at, rating before that date, rating after, season)
        self.k = ELO_K * IMPORTANCE.get(league, 1.0)
        self.at, self.season, self.total, self.n, self.day_total, self.day_n = None, None, 0.0, 0, 0.0, 0
        self.seq, self.chain = 0, ""

    def link(self, m: dict) -> None:
        """Take the match into the chain."""
        self.seq += 1
        told = ":".join(str(m[c]) for c in ("match_id", "at", "home_id", "away_id", "home_score", "away_score"))
        self.chain = hashlib.sha256(f"{self.chain}|{self.seq}:{told}".encode()).hexdigest()

    def now(self, team: int, at: int, season: int) -> float:
        if team not in self.teams:
            return ELO_BASE
        last, before, after, its_season = self.teams[team]
        rating = before if last == at else after
        if its_season != season and last != at:
            mean = self.total / self.n if self.n else ELO_BASE
            rating = mean + ELO_CARRY * (rating - mean)
        return rating

    def play(self, m: dict) -> tuple:
        at, season = m["at"], m["season"]
        if season != self.season:
            self.total, self.n, self.day_total, self.day_n = 0.0, 0, 0.0, 0
        elif at != self.at:
            self.total, self.n, self.day_total, self.day_n = self.total + self.day_total, self.n + self.day_n, 0.0, 0
        self.at, self.season = at, season
        h, a = self.now(m["home_id"], at, season), self.now(m["away_id"], at, season)
        expected = 1 / (1 + 10 ** ((a - h - ELO_HOME) / 400))
        delta = self.k * (outcome(m["home_score"], m["away_score"]) - expected)
        for team, pre, post in ((m["home_id"], h, h + delta), (m["away_id"], a, a - delta)):
            known = self.teams.get(team)
            self.teams[team] = (at, known[1] if known and known[0] == at else pre, post, season)
            self.day_total += post
            self.day_n += 1
        self.link(m)
        return (m["league_id"], m["match_id"], at, season, m["home_id"], m["away_id"], m["home_score"], m["away_score"], self.seq, h, a, h + delta, a - delta, self.total, self.n, self.day_total, self.day_n, self.chain)


def elo_ledger(matches: DataFrame) -> DataFrame:
    """A whole replay: the ledger's rows."""

    def make(league: str):
        state = Elo(league)
        return lambda m: [state.play(m)]

    return streamed(played(matches), ["at", "match_id"], make, LEDGER_SCHEMA)


def snapshot(ledger: DataFrame) -> DataFrame:
    """The state that a ledger ends in: a row a league (its last match) and a row a team (its last date)."""
    head = ledger.groupBy("league_id").agg(F.max_by(F.struct("at", "match_id", "season", "seq", "season_sum", "season_n", "day_sum", "day_n", "chain"), "seq").alias("head"))
    side = lambda s: F.struct(F.col(f"{s}_id").alias("team"), F.col(f"{s}_pre").alias("pre"), F.col(f"{s}_post").alias("post"))
    rows = ledger.select("league_id", "at", "season", "seq", F.explode(F.array(side("home"), side("away"))).alias("s")).select("league_id", "at", "season", "seq", "s.*")
    # several matches at one time: the rating before the first, and after the last
    days = rows.groupBy("league_id", "team", "at").agg(F.min_by("pre", "seq").alias("pre"), F.max_by("post", "seq").alias("post"), F.max("season").alias("season"))
    teams = days.groupBy("league_id", "team").agg(F.max(F.struct("at", "pre", "post", "season")).alias("state"))
    return head.withColumns({"team": F.lit(None).cast("long"), "state": F.lit(None).cast(teams.schema["state"].dataType)}).unionByName(teams.withColumn("head", F.lit(None).cast(head.schema["head"].dataType)))


def pending(matches: DataFrame, ledger: DataFrame, limit: int | None = None) -> DataFrame:
    """Matches without a ledger row, as ``MATCH``; with ``limit`` the oldest of all leagues."""
    fresh = played(matches).join(ledger.select("league_id", "match_id"), ["league_id", "match_id"], "left_anti")
    return fresh.orderBy("at", "match_id", "league_id").limit(limit) if limit is not None else fresh


def resumed(matches: DataFrame, ledger: DataFrame, limit: int | None = None) -> DataFrame:
    """(status, ledger row) of what follows the ledger: ``replayed`` rows, and for a league whose earlier matches aren't those that
    the ledger was made of one row ``refused``, with its league only. Matches beyond the ``limit`` oldest pending ones wait."""
    names = [f.name for f in T._parse_datatype_string(MATCH).fields]
    fresh = pending(matches, ledger, limit)
    # matches as they are told today, in the ledger's place
    known = played(matches).join(ledger.select("league_id", "match_id"), ["league_id", "match_id"], "left_semi")
    state = snapshot(ledger)
    none = lambda c, df: F.lit(None).cast(df.schema[c].dataType).alias(c)
    both = known.withColumn("fresh", F.lit(False)).unionByName(fresh.withColumn("fresh", F.lit(True)))
    rows = both.select(F.lit(1).alias("kind"), *names, "fresh", *[none(c, state) for c in ("team", "head", "state")])
    around = lambda kind, df: df.select(F.lit(kind).alias("kind"), "league_id", *[none(n, known) for n in names[1:]], F.lit(False).alias("fresh"), "team", "head", "state")
    nothing = (None,) * (len(T._parse_datatype_string(LEDGER_SCHEMA).fields) - 1)
    # the state first, the matches, and the end of the ledger's leagues
    rows = around(0, state).unionByName(rows).unionByName(around(2, state.where("head is not null")))

    def make(league: str):
        replay, told, seen = Elo(league), Elo(league), {"head": None, "sure": None}

        def judged(sure: bool) -> list[tuple]:
            seen["sure"] = sure
            return [] if sure else [("refused", league, *nothing)]

        def step(row: dict) -> list[tuple]:
            head = seen["head"]
            if row["kind"] == 0 and row["head"]:
                head = seen["head"] = row["head"]
                replay.at, replay.season, replay.seq, replay.chain = head["at"], head["season"], head["seq"], head["chain"]
                replay.total, replay.n, replay.day_total, replay.day_n = head["season_sum"], head["season_n"], head["day_sum"], head["day_n"]
                return []
            if row["kind"] == 0:
                s = row["state"]
                replay.teams[row["team"]] = (s["at"], s["pre"], s["post"], s["season"])
                return []
            if seen["sure"] is False:
                return []
            if head and row["kind"] == 1 and (row["at"], row["match_id"]) <= (head["at"], head["match_id"]):
                told.link(row)
                return judged(False) if row["fresh"] else []
            out = judged(not head or (told.seq, told.chain) == (head["seq"], head["chain"])) if seen["sure"] is None else []
            return out + [("replayed", *replay.play(row))] if seen["sure"] and row["kind"] == 1 else out

        return step

    return streamed(rows, ["kind", "at", "match_id"], make, f"status string, {LEDGER_SCHEMA}")


def ratings_of(ledger: DataFrame) -> DataFrame:
    return ledger.select("league_id", "match_id", "home_pre", "away_pre", "home_post", "away_post")


def elo(matches: DataFrame) -> DataFrame:
    """Ratings before and after each match."""
    return ratings_of(elo_ledger(matches))


def form(results: deque) -> tuple[float, float, float]:
    """Win rate, draw rate and points a game, newest results first in weight; ``FORM_NONE`` without any."""
    if not results:
        return FORM_NONE
    weights = [FORM_ALPHA ** (len(results) - 1 - i) for i in range(len(results))]
    total = sum(weights)
    share = lambda value: sum(w * value(r) for w, r in zip(weights, results)) / total
    return share(lambda r: float(r == 1.0)), share(lambda r: float(r == 0.5)), share(lambda r: 3.0 if r == 1.0 else 1.0 if r == 0.5 else 0.0)


class Phase8:
    """One league's Pi attack and defence, Berrar ratings and last results; each row is what was known before its match."""

    def __init__(self, league: str):
        self.attack: dict[int, float] = {}
        self.defence: dict[int, float] = {}
        self.berrar: dict[int, float] = {}
        self.results: dict[int, deque] = {}

    def play(self, m: dict) -> tuple:
        h, a, hs, away = m["home_id"], m["away_id"], m["home_score"], m["away_score"]
        ah, dh, aa, da = self.attack.get(h, 0.0), self.defence.get(h, 0.0), self.attack.get(a, 0.0), self.defence.get(a, 0.0)
        bh, ba = self.berrar.get(h, BERRAR_BASE), self.berrar.get(a, BERRAR_BASE)
        seen = [self.results.setdefault(t, deque(maxlen=FORM_WINDOW)) for t in (h, a)]
        row = (m["league_id"], m["match_id"], ah, dh, aa, da, bh, ba, *form(seen[0]), *form(seen[1]))
        if goals := hs + away:
            # both expectations first, then the four updates
            logistic = lambda x: 1 / (1 + math.exp(-x))
            home, guest = PI_RATE * (hs / goals - logistic(ah - da)), PI_RATE * (away / goals - logistic(aa - dh))
            self.attack[h], self.defence[a] = ah + home, da - guest
            self.attack[a], self.defence[h] = aa + guest, dh - home
        score = outcome(hs, away)
        delta = BERRAR_K * BERRAR_DECAY * (score - 1 / (1 + 10 ** ((ba - bh) / 400)))
        self.berrar[h], self.berrar[a] = bh + delta, ba - delta
        for results, value in zip(seen, (score, 1 - score)):
            results.append(value)
        return row


def phase8(matches: DataFrame) -> DataFrame:
    """The columns of ``PHASE8`` of each match that counts, unrounded."""

    def make(league: str):
        state = Phase8(league)
        return lambda m: [state.play(m)]

    return streamed(played(matches), ["at", "match_id"], make, PHASE8_SCHEMA)


def phase8_columns(matches: DataFrame) -> DataFrame:
    """The 15 columns: ratings to four places (Berrar: two), with their differences."""
    c, r = F.col, lambda x, n=4: F.round(x, n)
    p = phase8(matches)
    return p.select(
        "league_id", "match_id", *[r(c(x)).alias(x) for x in PHASE8[:4]], r(c("home_pi_attack") - c("away_pi_attack")).alias("pi_attack_diff"), r(c("away_pi_defense") - c("home_pi_defense")).alias("pi_defense_diff"),
        *[r(c(x), 2).alias(x) for x in PHASE8[4:6]], r(c("home_berrar_rating") - c("away_berrar_rating"), 2).alias("berrar_rating_diff"), *[r(c(x)).alias(x) for x in PHASE8[6:]],
    )


def pi_berrar(matches: DataFrame) -> DataFrame:
    """Pi attack and defence differences and Berrar ratings before each match."""
    p = phase8(matches)
    return p.select("league_id", "match_id", F.round(F.col("home_pi_attack") - F.col("away_pi_attack"), 4).alias("attack_diff"), F.round(F.col("away_pi_defense") - F.col("home_pi_defense"), 4).alias("defence_diff"), F.col("home_berrar_rating").alias("berrar_home"), F.col("away_berrar_rating").alias("berrar_away"))


def ledger(ratings: DataFrame, matches: DataFrame) -> DataFrame:
    """A row a match and team: pre and post."""
    both = F.explode(F.array(*[F.struct(F.col(f"{s}_id").alias("team"), F.col(f"{s}_pre").alias("pre"), F.col(f"{s}_post").alias("post")) for s in ("home", "away")]))
    j = ratings.join(matches.select("match_id", "home_id", "away_id", "match_date"), "match_id")
    return j.select("league_id", "match_id", "match_date", both.alias("s")).select("league_id", "match_id", "match_date", "s.*")
