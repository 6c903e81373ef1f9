"""Names to teams (ENT): the index, the tiers and the matcher, over teams and given names made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import text as tx
from touchline.operators import identity as ident
from touchline.plans.registry import query
from touchline.sources import adapters as src

#: Second and third words of the team names.
SECOND = ("united", "city", "rovers", "athletic", "wanderers", "albion", "town")
THIRD = ("north", "south", "harbour", "valley", "park", "hill", "bridge", "forest", "castle")


def _word(words, k: str) -> str:
    return f"CASE {k} {' '.join(f'WHEN {i} THEN {w!r}' for i, w in enumerate(words))} END"


# the same expressions in both engines
NAME = f"lower(n_name) || ' ' || {_word(SECOND, 'k % 7')} || ' ' || {_word(THIRD, 'k % 9')}"


def _team(name: str) -> str:
    return f"CASE k % 3 WHEN 0 THEN {name} || ' FC' WHEN 1 THEN {name} || ' 1907' ELSE {name} END"


def _given(name: str, first: str, second: str, third: str) -> str:
    return f"""CASE k % 8 WHEN 0 THEN upper({name}) WHEN 1 THEN 'FC ' || {name} || ' 1899' WHEN 2 THEN substr({name}, 1, 4) || ' ' || substr({second}, 1, 3) || ' ' || {third}
 WHEN 3 THEN {name} || ' supporters' WHEN 4 THEN 'side x' || k % 40 WHEN 5 THEN replace({name}, 'i', '') WHEN 6 THEN 'AFC ' || {name} ELSE {first} || ' ' || {second} END"""


TEAM, GIVEN = _team(NAME), _given(NAME, "lower(n_name)", _word(SECOND, "k % 7"), _word(THIRD, "k % 9"))
VIEWS = f"""t AS (SELECT id, league, {TEAM} AS name, {NAME} AS plain FROM (SELECT s_suppkey AS id, s_suppkey AS k, n_nationkey AS league, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)),
 g AS (SELECT q, league, {GIVEN} AS name FROM (SELECT c_custkey AS q, c_custkey AS k, n_nationkey AS league, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey))"""


def _worded(df):
    """The words of a name and the name as columns, each made once a row: with them written out in full wherever they
    occur, as in the SQL, Spark's code of a stage is too long to be compiled."""
    word = lambda words, n: F.get(F.array(*map(F.lit, words)), (F.col("k") % n).cast("int"))
    df = df.withColumns({"first": F.lower("n_name"), "second": word(SECOND, 7), "third": word(THIRD, 9)})
    return df.withColumn("plain", F.expr("first || ' ' || second || ' ' || third"))


def teams(spark, d):
    n = src.table(spark, d, "nation").select(F.col("n_nationkey").alias("league"), "n_name")
    s = src.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("league"))
    return _worded(s.join(n, "league")).select("id", "league", F.expr(_team("plain")).alias("name"), "plain")


def given(spark, d):
    n = src.table(spark, d, "nation").select(F.col("n_nationkey").alias("league"), "n_name")
    q = src.table(spark, d, "customer").select(F.col("c_custkey").alias("q"), F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("league"))
    return _worded(q.join(n, "league")).select("q", "league", F.expr(_given("plain", "first", "second", "third")).alias("name"))


def _norm(x: str) -> str:
    # these names have ASCII letters only; ent_01_normalise has the others
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def _tokens(x: str) -> str:
    noise = ", ".join(map(repr, tx.NOISE))
    return f"list_filter(string_split({_norm(x)}, ' '), lambda w: w <> '' AND NOT (w IN ({noise}) OR regexp_full_match(w, '[0-9]{{1,4}}')))"


AT = f"list_filter(range(1, len(acc) + 1), lambda i: acc[i] = x[1] OR (least(length(acc[i]), length(x[1])) >= {ident.LEAST_TOKEN} AND (starts_with(acc[i], x[1]) OR starts_with(x[1], acc[i]))))[1]"
FITS = f"list_reduce(list_transform(gw, lambda w: [w]), lambda acc, x: CASE WHEN acc = ['!'] OR {AT} IS NULL THEN ['!'] ELSE acc[1:{AT} - 1] || acc[{AT} + 1:] END, tw) <> ['!']"


@query("ent_04_index_resolve", f"""WITH {VIEWS}, ti AS (SELECT *, {_tokens('name')} AS tw FROM t), gi AS (SELECT *, {_tokens('name')} AS gw FROM g),
 u AS (SELECT league, array_to_string(tw, ' ') AS k, min(id) AS id, count(DISTINCT id) AS n FROM ti GROUP BY ALL),
 y AS (SELECT league, 'side x' || id % 40 AS k, min(id) AS id, count(DISTINCT id) AS n FROM ti WHERE id % 2 = 0 GROUP BY ALL),
 p AS (SELECT q, min(id) AS id, count(DISTINCT id) AS n FROM gi JOIN ti USING (league) WHERE len(gw) >= 2 AND len(gw) <= len(tw) AND {FITS} GROUP BY 1)
SELECT q, CASE WHEN u.n = 1 THEN u.id WHEN u.n IS NULL AND y.n = 1 THEN y.id WHEN u.n IS NULL AND y.n IS NULL AND p.n = 1 THEN p.id END AS id,
 CASE WHEN u.n = 1 THEN 'exact' WHEN u.n > 1 THEN 'ambiguous' WHEN y.n = 1 THEN 'alias' WHEN y.n > 1 THEN 'ambiguous' WHEN p.n = 1 THEN 'prefix' WHEN p.n > 1 THEN 'ambiguous' ELSE 'none' END AS tier
FROM gi LEFT JOIN u ON u.league = gi.league AND u.k = array_to_string(gw, ' ') LEFT JOIN y ON y.league = gi.league AND y.k = array_to_string(gw, ' ') LEFT JOIN p USING (q)""")
def ent_04(spark, d):
    """Aliases: every second team is also known by a short name."""
    t, g = teams(spark, d), given(spark, d)
    short = t.where("id % 2 = 0").select("league", "name", F.expr("'side x' || id % 40").alias("alias")).distinct()
    aliases = short.select("league", F.array_join(tx.tokens(F.col("name")), " ").alias("key"), "alias")
    return g.join(ident.by_index(g, t, aliases), ["league", "name"]).select("q", "id", "tier")


KEY = f"trim(regexp_replace(regexp_replace({_norm('name')}, '{tx.LEADING}', ''), '{tx.TRAILING}', ''))"
AFFIX = "lower(CASE WHEN trim(regexp_replace(trim(name), '{0}', '', 'gi')) = '' THEN trim(name) ELSE trim(regexp_replace(trim(name), '{0}', '', 'gi')) END)".format(tx.AFFIX_PATTERN.removeprefix("(?i)"))
FORMS = f"lower(trim(name)) AS exact, {AFFIX} AS affix, {KEY} AS key"


def _tier(name: str, on: str) -> str:
    return f"{name} AS (SELECT q, min(ti.id) AS id FROM gi JOIN ti ON ti.league = gi.league AND {on} GROUP BY 1 HAVING count(DISTINCT ti.id) = 1)"


LONG = f"length(gi.key) >= {ident.LEAST_KEY} AND length(ti.key) >= {ident.LEAST_KEY}"


@query("ent_05_key_tiers", f"""WITH {VIEWS}, ti AS (SELECT *, {FORMS} FROM t), gi AS (SELECT *, {FORMS} FROM g), {_tier('a', 'ti.exact = gi.exact')}, {_tier('b', 'ti.affix = gi.affix')}, {_tier('c', "ti.key = gi.key AND ti.key <> ''")},
 {_tier('h', f"{LONG} AND (contains(' ' || ti.key || ' ', ' ' || gi.key || ' ') OR contains(' ' || gi.key || ' ', ' ' || ti.key || ' '))")},
 al AS (SELECT DISTINCT league, 'side x' || id % 40 AS key, plain AS target FROM t WHERE id < 40), k AS (SELECT league, key AS target, min(id) AS id FROM ti GROUP BY ALL HAVING count(DISTINCT id) = 1),
 l AS (SELECT gi.q, k.id FROM gi JOIN al USING (league, key) JOIN k USING (league, target))
SELECT q, coalesce(a.id, b.id, c.id, h.id, l.id) AS id, CASE WHEN a.id IS NOT NULL THEN 'exact' WHEN b.id IS NOT NULL THEN 'affix' WHEN c.id IS NOT NULL THEN 'key' WHEN h.id IS NOT NULL THEN 'containment' WHEN l.id IS NOT NULL THEN 'alias' ELSE 'none' END AS tier
FROM gi LEFT JOIN a USING (q) LEFT JOIN b USING (q) LEFT JOIN c USING (q) LEFT JOIN h USING (q) LEFT JOIN l USING (q)""")
def ent_05_keys(spark, d, fuzzy=False):
    """The tiers before the fuzzy one. Aliases: the first 39 teams by a short name."""
    t, g = teams(spark, d), given(spark, d)
    aliases = t.where("id < 40").select("league", F.expr("'side x' || id % 40").alias("key"), F.col("plain").alias("target"))
    return g.join(ident.by_tiers(g, t, aliases, fuzzy), ["league", "name"]).select("q", "id", "tier")


@query("ent_05_tiered_resolver")
def ent_05(spark, d):
    """All six tiers; the matcher has no SQL, so a plain replay checks the last."""
    return ent_05_keys(spark, d, fuzzy=True)


@query("ent_06_matcher_ratio")
def ent_06(spark, d):
    """The matcher's similarity inside a block."""
    n = src.table(spark, d, "nation").select("n_nationkey", "n_regionkey", "n_name")
    a, b = n.select("n_regionkey", F.col("n_nationkey").alias("a"), F.col("n_name").alias("x")), n.select("n_regionkey", F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"))
    return a.join(b, "n_regionkey").where("a < b").select("a", "b", ident.ratio("x", "y").alias("ratio"))


@query("ent_08_matcher_reconcile")
def ent_08(spark, d):
    """Each given name with the decision on its most similar team."""
    g = given(spark, d)
    return g.join(ident.reconciled(g, teams(spark, d)), ["league", "name"]).select("q", "status", "team", "score")


#: How the provider spells a name, by record.
SPELT = """CASE k % 6 WHEN 0 THEN upper(name) WHEN 1 THEN replace(name, ' ', '-') WHEN 2 THEN substr(name, 1, length(name) - 2) WHEN 3 THEN concat(name, ' FC') WHEN 4 THEN replace(name, 'e', '') ELSE name END"""


def fixture_names(spark, d):
    """Fixtures of the matches, half hours apart, with names, and what a provider says of them: spelt and timed otherwise."""
    m = src.matches(spark, d)
    nations = src.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.expr(NAME).alias("name"))
    named = lambda side: nations.select(F.col("k").alias(f"{side}_id"), F.col("name").alias(side))
    kickoff = F.col("match_date").cast("timestamp") + F.make_interval(mins=(F.col("match_id") % 5 * 30).cast("int"))
    f = m.join(named("home"), "home_id").join(named("away"), "away_id").select(F.col("match_id").alias("fixture"), F.col("league_id").alias("league"), "home", "away", kickoff.alias("kickoff"))
    spelt = lambda side, shift: F.expr(SPELT.replace("k %", f"(fixture + {shift}) %").replace("name", side)).alias(side)
    given = f.where("fixture % 3 = 0").select(F.col("fixture").alias("record"), "league", spelt("home", 0), spelt("away", 1), (F.col("kickoff") + F.make_interval(mins=(F.col("fixture") % 7 * 20).cast("int"))).alias("kickoff"))
    return given, f


@query("ent_07_reconcile")
def ent_07(spark, d):
    """Every third fixture as a provider tells it, to the canonical ones by names and kickoff; the matcher has no SQL."""
    given, fixtures = fixture_names(spark, d)
    return ident.fixtures_reconciled(given, fixtures)
