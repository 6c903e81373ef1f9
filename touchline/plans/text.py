"""Identity, similarity and text queries (ENT, SIML, TXT, FN)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.functions import text as tx
from touchline.operators import similarity as sim
from touchline.plans.registry import query
from touchline.sources import adapters as src
from touchline.sources import html as markup

#: Names with letters beyond Latin-1, ligatures, marks of their own, and club designators.
FOREIGN = ("Beşiktaş JK", "MFK Ružomberok", "Śląsk Wrocław", "İstanbul Başakşehir", "FK Čukarički", "Győri ETO", "ﬁnland FC", "Cafe\u0301 CF", "Mönchengladbach", "Straße AFC", "A.F.C. Ｗｉｄｅ", "½ Côte d’Azur 1907", "Брест", "Chelsea Football Club", "Ǆ Ajax", "C.F. São Ⅷ")


def _foreign(k: str, name: str) -> str:
    return f"CASE {k} % 20 {' '.join(f'WHEN {i} THEN {x!r}' for i, x in enumerate(FOREIGN)).replace(chr(34), chr(39))} ELSE {name} END"


def norm_sql(x: str) -> str:
    """The rule with DuckDB's functions: each character by its decomposition, which Python's table gives."""
    one, plain, gone, several = tx.decomposed()
    several = ", ".join(f"'{k}': '{v}'" for k, v in several.items())
    spelled = f"array_to_string(list_transform(string_split({x}, ''), lambda ch: coalesce(MAP {{{several}}}[ch], ch)), '')"
    return f"trim(regexp_replace(lower(translate({spelled}, '{one}{gone}', '{plain}')), '[^a-z0-9]+', ' ', 'g'))"


@query("ent_01_normalise", f"SELECT s_suppkey, {norm_sql('name')} AS name FROM (SELECT s_suppkey, {_foreign('s_suppkey', 's_name')} AS name FROM supplier)")
def ent_01(spark, d):
    s = src.table(spark, d, "supplier").select("s_suppkey", F.expr(_foreign("s_suppkey", "s_name")).alias("name"))
    return s.select("s_suppkey", tx.normalised(F.col("name")).alias("name"))


@query("ent_02_club_key", f"""SELECT c_custkey, replace(regexp_replace(regexp_replace(trim(regexp_replace(replace(lower({_foreign('c_custkey', 'c_name')}), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g')), '{tx.CLUB_BEFORE}', ''), '{tx.CLUB_AFTER}', ''), ' ', '') AS key FROM customer""")
def ent_02(spark, d):
    c = src.table(spark, d, "customer").select("c_custkey", F.expr(_foreign("c_custkey", "c_name")).alias("name"))
    return c.select("c_custkey", tx.club_key(F.col("name")).alias("key"))


@query("ent_06_edit_similarity", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, levenshtein(a.n_name, b.n_name) AS distance FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def ent_06(spark, d):
    """Candidates share a block (here the region), which bounds the pairs."""
    n = src.table(spark, d, "nation").select("n_nationkey", "n_regionkey", "n_name")
    a, b = n.select("n_regionkey", F.col("n_nationkey").alias("a"), F.col("n_name").alias("x")), n.select("n_regionkey", F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"))
    return a.join(b, "n_regionkey").where("a < b").select("a", "b", F.levenshtein("x", "y").cast("long").alias("distance"))


@query("ent_09_stable_ids", "SELECT s_suppkey, substr(sha256(concat_ws('|', lower(s_name), CAST(s_nationkey AS VARCHAR))), 1, 24) AS id FROM supplier")
def ent_09(spark, d):
    return src.table(spark, d, "supplier").select("s_suppkey", tx.stable_id(F.lower("s_name"), F.col("s_nationkey").cast("string")).alias("id"))


@query("siml_01_cosine_topk", "WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]) AS s FROM q JOIN embeddings ON vec_id <> query_id) SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS place, round(s, 5) AS similarity FROM s QUALIFY place <= 10")
def siml_01(spark, d, k=10):
    """Every hundredth vector against all rows, in blocks of which each gives a query its best."""
    e = src.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    s = sim.scored(e, e.where("vec_id % 100 = 0"), "vec_id", "e", sim.cosines, sim.top(k), "query_id long, vec_id long, s double").withColumn("s", F.when(~F.isnan("s"), F.col("s")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("s", 9)), "vec_id"))
    return s.withColumn("place", place.cast("long")).where(F.col("place") <= k).select("query_id", "vec_id", "place", F.round("s", 5).alias("similarity"))


def _keyword(words, column="text"):
    return " + ".join(f"contains(lower({column}), '{w}')::INT" for w in words)


POS, NEG = _keyword(tx.POSITIVE), _keyword(tx.NEGATIVE)


@query("txt_01_sentiment", f"SELECT lang, count(*) AS n, round(avg(coalesce(({POS} - ({NEG})) / nullif({POS} + {NEG}, 0)::DOUBLE, 0)), 6) AS sentiment, round(least(1, count(*) / 100.0::DOUBLE), 6) AS confidence, count(*) > 50 AS trending FROM documents GROUP BY 1")
def txt_01(spark, d):
    docs = src.table(spark, d, "documents").groupBy("lang")
    return docs.agg(F.count("*").alias("n"), F.round(F.avg(tx.sentiment(F.col("text"))), 6).alias("sentiment"), F.round(F.least(F.lit(1.0), F.count("*") / 100.0), 6).alias("confidence"), (F.count("*") > 50).alias("trending"))


@query("txt_02_credibility", f"SELECT lang, round(sum(coalesce(({POS} - ({NEG})) / nullif({POS} + {NEG}, 0)::DOUBLE, 0) * CASE WHEN source IN ('src0', 'src1') THEN 5 WHEN source IN ('src2', 'src3') THEN 2 ELSE 1 END) / sum(CASE WHEN source IN ('src0', 'src1') THEN 5 WHEN source IN ('src2', 'src3') THEN 2 ELSE 1 END), 6) AS weighted FROM documents GROUP BY 1")
def txt_02(spark, d):
    w = F.when(F.col("source").isin("src0", "src1"), 5).when(F.col("source").isin("src2", "src3"), 2).otherwise(1)
    return src.table(spark, d, "documents").groupBy("lang").agg(F.round(F.sum(tx.sentiment(F.col("text")) * w) / F.sum(w), 6).alias("weighted"))


TOPICS = ("tion", "ment", "keit", "ción")


@query("txt_03_topics", "SELECT topic, n FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS topic, count(*) FILTER (contains(lower(text), '{t}')) AS n FROM documents" for t in TOPICS) + ") WHERE n > 0 ORDER BY n DESC, topic LIMIT 3")
def txt_03(spark, d):
    """All topics in one scan."""
    one = src.table(spark, d, "documents").agg(*[F.count_if(F.contains(F.lower("text"), F.lit(t))).alias(t) for t in TOPICS])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(t).alias("topic"), F.col(t).alias("n")) for t in TOPICS])).alias("s")).select("s.*")
    return rows.where("n > 0").orderBy(F.desc("n"), "topic").limit(3)


@query("txt_04_shift", "WITH m AS (SELECT max(ts) AS t FROM events), k AS (SELECT event_type, avg(value) FILTER (ts > t - INTERVAL 6 HOUR) AS recent, avg(value) FILTER (ts <= t - INTERVAL 6 HOUR) AS before FROM events, m GROUP BY 1) SELECT event_type, round(recent - before, 6) AS shift, abs(recent - before) > 0.3 AS shifted FROM k")
def txt_04(spark, d):
    e = src.table(spark, d, "events")
    e = e.join(F.broadcast(e.agg(F.max("ts").alias("t"))), F.lit(True))
    late = F.col("ts") > F.col("t") - F.expr("INTERVAL 6 HOURS")
    k = e.groupBy("event_type").agg((F.avg(F.when(late, F.col("value"))) - F.avg(F.when(~late, F.col("value")))).alias("gap"))
    return k.select("event_type", F.round("gap", 6).alias("shift"), (F.abs("gap") > 0.3).alias("shifted"))


@query("txt_07_redaction", r"SELECT page_id, regexp_replace(url, '(?i)\b(api[_-]?key|token|secret|password|ref)=([^&\s]+)', '\1=***', 'g') AS url FROM pages")
def txt_07(spark, d):
    return src.table(spark, d, "pages").select("page_id", tx.redacted(F.col("url")).alias("url"))


@query("txt_08_slug", "SELECT page_id, translate(regexp_extract(url, '://([^/?#]+)', 1), '.', ' ') AS slug FROM pages")
def txt_08(spark, d):
    return src.table(spark, d, "pages").select("page_id", F.translate(F.regexp_extract("url", "://([^/?#]+)", 1), ".", " ").alias("slug"))


@query("fn_02_dates", f"WITH {src.MATCHES} SELECT match_id, isodow(match_date) - 1 AS weekday, isodow(match_date) >= 6 AS weekend, month(match_date) AS month, quarter(match_date) AS quarter FROM matches")
def fn_02(spark, d):
    m = src.matches(spark, d)
    return m.select("match_id", F.weekday("match_date").cast("long").alias("weekday"), (F.weekday("match_date") >= 5).alias("weekend"), F.month("match_date").cast("long").alias("month"), F.quarter("match_date").cast("long").alias("quarter"))


@query("fn_03_seasons", f"WITH {src.MATCHES} SELECT match_id, year(match_date) - (month(match_date) < 7)::INT AS season_july, year(match_date) - (month(match_date) < 8)::INT AS season_august FROM matches")
def fn_03(spark, d):
    cut = lambda k: (F.year("match_date") - (F.month("match_date") < k).cast("int")).cast("long")
    return src.matches(spark, d).select("match_id", cut(7).alias("season_july"), cut(8).alias("season_august"))


@query("fn_06_arrays", "SELECT vec_id, round(list_sum(list_slice(embedding::DOUBLE[], -5, -1)), 5) AS tail_sum, list_position(embedding, list_max(embedding)) - 1 AS argmax FROM embeddings")
def fn_06(spark, d):
    e = src.table(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    return e.select("vec_id", F.round(F.aggregate(F.slice("v", -5, 5), F.lit(0.0), lambda s, x: s + x), 5).alias("tail_sum"), (F.array_position("v", F.array_max("v")) - 1).alias("argmax"))


@query("fn_08_hash", "SELECT page_id, sha256(url) AS url_sha256 FROM pages")
def fn_08(spark, d):
    return src.table(spark, d, "pages").select("page_id", F.sha2("url", 256).alias("url_sha256"))


@query("src_11_html_links", r"SELECT page_id, len(regexp_extract_all(html, '<a href=')) AS links, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages")
def src_11(spark, d):
    return src.table(spark, d, "pages").select("page_id", F.regexp_count("html", F.lit("<a href=")).cast("long").alias("links"), F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))


@query("src_16_valuation_parse", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 90) * 1e6 WHEN o_orderkey % 3 = 1 THEN (o_orderkey % 900) * 1e3 ELSE 0 END::DOUBLE AS value FROM orders")
def src_16(spark, d):
    from touchline.sources.files import valuation

    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("€"), (k % 90).cast("string"), F.lit("m"))).when(k % 3 == 1, F.concat(F.lit("€"), (k % 900).cast("string"), F.lit("k"))).otherwise("-")
    return src.table(spark, d, "orders").select("o_orderkey", valuation(raw).alias("value"))


# the pages' lists become tables, with cells and rows left open and cells that span rows and columns
LISTS = (("<ul>", '<table id="links"><thead><tr><th>mark<th colspan="2">link</thead>'), ("</ul>", "</table>"), ("<li>", '<tr><td rowspan="2">*<td>'), ("</li>", "<!-- </tr> --><tr><td> next &amp; <i>more </i>"))


@query("src_11_html_tables", """WITH l AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<ul>(.*?)</ul>', 1), '(?s)<li>(.*?)</li>', 1) AS items FROM pages WHERE contains(html, '<ul>')),
i AS (SELECT page_id, unnest(items) AS item, generate_subscripts(items, 1) AS n FROM l),
x AS (SELECT page_id, n, trim(regexp_replace(item, '(?s)<[^>]*>', '', 'g')) AS text FROM i)
SELECT page_id, 0 AS row, unnest([0, 1, 2]) AS col, unnest(['mark', 'link', 'link']) AS text, TRUE AS header FROM l
UNION ALL SELECT page_id, (2 * n - 1)::INT, unnest([0, 1]), unnest(['*', text]), FALSE FROM x
UNION ALL SELECT page_id, (2 * n)::INT, unnest([0, 1]), unnest(['*', 'next &more']), FALSE FROM x""")
def src_11_tables(spark, d):
    """Every cell of every table of the pages; ``link`` texts have no entities or marks inside."""
    p = src.table(spark, d, "pages").select("page_id", "html")
    for old, new in LISTS:
        p = p.withColumn("html", F.replace("html", F.lit(old), F.lit(new)))
    return markup.tables(p).select("page_id", "row", F.col("column").alias("col"), "text", "header")
