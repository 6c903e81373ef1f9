import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from touchline.operators import ratings as rt


def table(spark, rows, league="2-HIGH"):
    """(home, away, date, home score, away score), numbered."""
    return spark.createDataFrame([(league, i, h, a, d, hs, as_) for i, (h, a, d, hs, as_) in enumerate(rows)], "league_id string, match_id long, home_id long, away_id long, match_date string, home_score long, away_score long").withColumn("match_date", F.to_timestamp("match_date"))


def elo(spark, rows):
    return {r["match_id"]: r for r in rt.elo(table(spark, rows)).collect()}


def some(n, seed=1, teams=6):
    """Matches over two and a half seasons, several at a time."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        h, a = rnd.sample(range(teams), 2)
        month = 30 * i // n
        out.append((h, a, f"{2022 + (6 + month) // 12}-{(6 + month) % 12 + 1:02d}-{1 + (i // 2) % 28:02d}", rnd.randint(0, 4), rnd.randint(0, 3)))
    return sorted(out, key=lambda r: r[2])


def plain_elo(rows, k=20.0):
    """The durable rule, read off a ledger of team rows for every match: nothing is kept between matches."""
    ledger, out = [], {}

    def context(team, day, season):
        mine = [r for r in ledger if r[0] == team and r[1] < day]
        if not mine:
            return 1500.0
        last = mine[-1][3]
        if all(r[2] != season for r in mine[-5:]):
            posts = [r[3] for r in ledger if r[2] == season and r[1] < day]
            mean = sum(posts) / len(posts) if posts else 1500.0
            last = mean + 0.5 * (last - mean)
        return last

    for i, (h, a, day, hs, as_) in sorted(enumerate(rows), key=lambda r: (r[1][2], r[0])):
        season = int(day[:4]) - (int(day[5:7]) < 7)
        x, y = context(h, day, season), context(a, day, season)
        delta = k * ((1.0 if hs > as_ else 0.5 if hs == as_ else 0.0) - 1 / (1 + 10 ** ((y - x - 100) / 400)))
        ledger += [(h, day, season, x + delta), (a, day, season, y - delta)]
        out[i] = (x, y, x + delta, y - delta)
    return out


def test_elo_is_the_durable_rule(spark):
    rows = some(160)
    got = elo(spark, rows)
    for i, want in plain_elo(rows).items():
        assert tuple(got[i])[2:] == pytest.approx(want, abs=1e-9)


def test_elo_moves_and_conserves(spark):
    out = elo(spark, [(0, 1, "2024-08-01", 2, 0), (1, 2, "2024-08-09", 1, 1)])
    expected = 1 / (1 + 10 ** (-100 / 400))
    assert out[0]["home_post"] == pytest.approx(1500 + 20 * (1 - expected)) and out[0]["home_post"] + out[0]["away_post"] == pytest.approx(3000)
    assert out[1]["home_pre"] == pytest.approx(out[0]["away_post"])


def test_two_matches_on_one_day_start_from_the_rating_before_it(spark):
    out = elo(spark, [(0, 1, "2024-08-01", 2, 0), (0, 2, "2024-08-01", 0, 1), (0, 3, "2024-08-02", 1, 1)])
    assert out[1]["home_pre"] == 1500 and out[2]["home_pre"] == pytest.approx(out[1]["home_post"])


def test_self_play_missing_scores_and_repeats_are_skipped(spark):
    m = table(spark, [(0, 0, "2024-08-01", 2, 0), (0, 1, "2024-08-02", None, 0), (0, 1, "2024-08-03", 1, 0), (0, 1, "2024-08-04", -1, 0)])
    later = m.where("match_id = 2").withColumn("match_date", F.to_timestamp(F.lit("2024-09-01")))
    out = rt.elo(m.union(m).union(later)).collect()
    assert [r["match_id"] for r in out] == [2] and rt.phase8(m.union(later)).count() == 1


def test_order_of_input_rows_does_not_matter(spark):
    m = table(spark, some(60))
    rows = lambda df: sorted(map(tuple, rt.phase8(df).collect()))
    assert rows(m) == rows(m.orderBy(F.desc("match_id")).repartition(3))


def test_earlier_rows_do_not_see_later_ones(spark):
    m = table(spark, some(40))
    whole = {r["match_id"]: r for r in rt.elo(m).collect()}
    assert all(whole[r["match_id"]] == r for r in rt.elo(m.where("match_id < 25")).collect())


def plain_phase8(rows):
    attack, defence, berrar, results, out = {}, {}, {}, {}, {}
    import math

    for i, (h, a, _, hs, as_) in sorted(enumerate(rows), key=lambda r: (r[1][2], r[0])):
        g = lambda d, t, x=0.0: d.get(t, x)
        out[i] = [g(attack, h), g(defence, h), g(attack, a), g(defence, a), g(berrar, h, 1500.0), g(berrar, a, 1500.0)]
        for t in (h, a):
            seen = list(results.get(t, ()))
            w = [0.7 ** (len(seen) - 1 - j) for j in range(len(seen))]
            mean = lambda f: sum(x * f(r) for x, r in zip(w, seen)) / sum(w)  # noqa: B023, E731
            out[i] += [mean(lambda r: r == 1), mean(lambda r: r == 0), mean(lambda r: {1: 3, 0: 1, -1: 0}[r])] if seen else [0.5, 0.333, 1.0]
        if hs + as_:
            share_h, share_a = hs / (hs + as_), as_ / (hs + as_)
            exp_h, exp_a = 1 / (1 + math.exp(g(defence, a) - g(attack, h))), 1 / (1 + math.exp(g(defence, h) - g(attack, a)))
            for d, t, x in ((attack, h, share_h - exp_h), (defence, a, exp_a - share_a), (attack, a, share_a - exp_a), (defence, h, exp_h - share_h)):
                d[t] = g(d, t) + 0.03 * x
        rh, ra = g(berrar, h, 1500.0), g(berrar, a, 1500.0)
        exp = 1 / (1 + 10 ** ((ra - rh) / 400))
        score = 1.0 if hs > as_ else 0.5 if hs == as_ else 0.0
        berrar[h], berrar[a] = rh + 32 * (score - exp) * 0.98, ra - 32 * (score - exp) * 0.98
        code = (hs > as_) - (hs < as_)
        for t, r in ((h, code), (a, -code)):
            results.setdefault(t, deque(maxlen=10)).append(r)
    return out


def test_phase8_has_fifteen_columns_of_what_was_known_before(spark):
    rows = some(120, seed=4)
    got = {r["match_id"]: tuple(r)[2:] for r in rt.phase8(table(spark, rows)).collect()}
    for i, want in plain_phase8(rows).items():
        assert got[i] == pytest.approx(want, abs=1e-9)
    assert len(rt.phase8_columns(table(spark, rows)).columns) == 2 + 15


@pytest.mark.parametrize("cuts", [(70,), (1, 2, 90), (0, 119)])
def test_parts_equal_one_whole_replay(spark, tmp_path, cuts):
    """Cuts inside a date and inside a season; every column of the ledger is equal, the sums and the chain too."""
    m = table(spark, some(120, seed=2))
    m = m.union(m.withColumn("league_id", F.lit("5-LOW")).where("match_id % 3 <> 0"))
    whole = sorted(map(tuple, rt.elo_ledger(m).collect()))
    path = str(tmp_path / "ledger")
    rt.elo_ledger(m.limit(0)).write.parquet(path)
    for limit in (*[2 * (b - a) for a, b in zip((0, *cuts), cuts)], None):
        rt.resumed(m, spark.read.parquet(path), limit).where("status = 'replayed'").drop("status").write.mode("append").parquet(path)
        spark.catalog.refreshByPath(path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == whole
    assert rt.resumed(m, spark.read.parquet(path)).count() == 0


def test_another_past_is_refused(spark, tmp_path):
    m = table(spark, some(80, seed=3))
    path = str(tmp_path / "ledger")
    rt.elo_ledger(m.where("match_id < 50")).write.parquet(path)
    ledger = spark.read.parquet(path)
    late = m.where("match_id = 3").withColumn("match_id", F.lit(1000).cast("long"))
    pasts = {
        "as it was": m, "a score changed": m.withColumn("home_score", F.col("home_score") + (F.col("match_id") == 10).cast("long")), "one went": m.where("match_id <> 20"), "one came late": m.union(late),
        "only one came late": m.where("match_id < 50").union(late), "one went, nothing new": m.where("match_id < 50 and match_id <> 7"),
    }
    status = {k: {r["status"] for r in rt.resumed(df, ledger).collect()} for k, df in pasts.items()}
    assert status == {k: {"replayed"} if k == "as it was" else {"refused"} for k in pasts}


def test_no_matches(spark):
    m = table(spark, some(4)).limit(0)
    assert rt.elo_ledger(m).count() == 0 and rt.phase8(m).count() == 0 and rt.resumed(m, rt.elo_ledger(m)).count() == 0
