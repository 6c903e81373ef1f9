"""Mixing sources to target weights through a tree of domains, languages and sources.

Budget. The token budget is split top-down. At every node, children get it in proportion to
their weights, but none more than its subtree can give (its tokens times ``epochs``); what a
child can't take goes to its siblings in proportion to their weights, and only what all of
them together can't take is missing at the parent, so that its own siblings get it. A node's
children are thus filled like connected vessels: sorted by capacity over weight, a prefix of
them is full and the rest share what is left (running sums, no iteration).

Selection. A leaf's documents are put in a seeded order for each epoch (MD5 of seed, epoch
and doc_id); the epochs follow each other, and the leaf gets the longest prefix of whole
documents whose tokens stay within its budget. Running sums aren't taken over a leaf as a
whole, which may hold a third of all rows: documents are dealt to ranges of the order
(their number follows the table), sums of ranges are accumulated, then rows within a range.

A token is a word: a run of anything but the ASCII white space 0x20 0x09-0x0D.

Defined results: null text has no tokens, and documents without tokens are taken with the
prefix they stand in; null lang and source are leaves of their own ('' in the tree); weights
that aren't given are 1; weight 0 takes nothing as long as siblings can; rows with equal
doc_id keep their place together, ordered by text; an empty table gives no rows; other
columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import written

SEED, EPOCHS = 17, 2
#: Domain by source: the first is one large crawl; nothing known: 'other'.
DOMAINS = {"crawl": ("src0",), "reference": tuple(f"src{i}" for i in range(1, 10)), "forum": tuple(f"src{i}" for i in range(10, 20))}
DOMAIN_WEIGHTS = {"crawl": 3.0, "reference": 4.0, "forum": 3.0}
LANG_WEIGHTS = {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}
#: The budget as a share of the tokens there are.
SHARE = 0.9
ROWS_A_RANGE = 2000
LEVELS = ("domain", "lang", "source")


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weight_of(column: Column, weights: dict[str, float]) -> Column:
    return F.coalesce(*[F.when(column == k, F.lit(float(v))) for k, v in weights.items()], F.lit(1.0)) if weights else F.lit(1.0)


def domain_of(source: Column) -> Column:
    return F.coalesce(*[F.when(source.isin(list(s)), F.lit(d)) for d, s in DOMAINS.items()], F.lit("other"))


def leaves(tags: DataFrame) -> DataFrame:
    """domain, lang, source, tokens, rows: the leaves of the tree over ``tagged`` rows, of bounded number."""
    return tags.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))


def levels_of() -> tuple[Column, Column, Column]:
    """domain, language and source of a row of documents."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return domain_of(source), F.coalesce(F.col("lang").cast("string"), F.lit("")), source


def tagged(docs: DataFrame) -> DataFrame:
    """doc_id, text digest, the tree's levels and n_tokens."""
    levels = [c.alias(k) for k, c in zip(LEVELS, levels_of(), strict=True)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *levels).withColumn("n_tokens", token_count(F.col("text"))).withColumn("text", F.md5(F.col("text").cast("binary")))


def poured(nodes: DataFrame, above: list[str], budget: str, capacity: str, weight: str, out: str) -> DataFrame:
    """Split each parent's budget over its children. A child whose capacity over weight is
    at most the water level is full; the level follows from running sums over the children
    in the order of that ratio."""
    order = Window.partitionBy(*above).orderBy(F.col("_fill"), *LEVELS[: len(above) + 1]) if above else Window.orderBy(F.col("_fill"), LEVELS[0])
    everything = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    steps = nodes.withColumn("_fill", F.when(F.col(weight) > 0, F.col(capacity) / F.col(weight)).otherwise(F.lit(float("inf"))))
    steps = steps.withColumns({"_full": F.coalesce(F.sum(capacity).over(before), F.lit(0.0)), "_open": F.sum(weight).over(everything) - F.coalesce(F.sum(weight).over(before), F.lit(0.0))})
    level = F.when(F.col(weight) > 0, (F.col(budget) - F.col("_full")) / F.col("_open"))
    # it rises over the full children and falls after the first that isn't, so the largest is the water level
    steps = steps.withColumn("_level", F.max(level).over(everything))
    # children of weight 0 come last and get what the others can't take
    given = F.when(F.col(weight) > 0, F.col(weight) * F.col("_level")).otherwise(F.col(budget) - F.col("_full"))
    return steps.withColumn(out, F.least(F.col(capacity), F.greatest(F.lit(0.0), given))).drop("_fill", "_full", "_open", "_level")


def budgets(docs: DataFrame, **options) -> DataFrame:
    """domain, lang, source, tokens, rows, budget of each leaf of documents; options: those of ``shared_out``."""
    return shared_out(tagged(docs), **options)


def shared_out(tags: DataFrame, total: float | None = None, share: float = SHARE, epochs: int = EPOCHS, domain_weights=None, lang_weights=None, source_weights=None) -> DataFrame:
    """domain, lang, source, tokens, budget of each leaf of ``tagged`` rows."""
    leaf = leaves(tags).withColumn("capacity", (F.col("tokens") * epochs).cast("double"))
    langs = leaf.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    domains = langs.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
    whole = Window.partitionBy(F.lit(0))
    top = F.lit(float(total)) if total is not None else F.floor(F.sum("capacity").over(whole) / epochs * share).cast("double")
    domains = domains.withColumns({"budget": top, "w": weight_of(F.col("domain"), DOMAIN_WEIGHTS if domain_weights is None else domain_weights)})
    domains = poured(domains, [], "budget", "capacity", "w", "given").select("domain", F.col("given").alias("budget"))
    langs = langs.join(domains, "domain").withColumn("w", weight_of(F.col("lang"), LANG_WEIGHTS if lang_weights is None else lang_weights))
    langs = poured(langs, ["domain"], "budget", "capacity", "w", "given").select("domain", "lang", F.col("given").alias("budget"))
    leaf = leaf.join(langs, ["domain", "lang"]).withColumn("w", weight_of(F.col("source"), source_weights or {}))
    return poured(leaf, ["domain", "lang"], "budget", "capacity", "w", "given").select(*LEVELS, "tokens", "rows", F.floor(F.round("given", 6)).cast("long").alias("budget"))


def selection(docs: DataFrame, epochs: int = EPOCHS, seed: int = SEED, ranges: int | None = None, **options) -> DataFrame:
    """doc_id, text (its MD5), epoch, domain, lang, source, n_tokens of the chosen documents."""
    tags = written(tagged(docs), "tagged")  # texts are read once; what follows needs a few short columns
    plan = shared_out(tags, epochs=epochs, **options)
    each = tags.withColumn("epoch", F.explode(F.array(*map(F.lit, range(epochs)))))
    each = each.withColumn("place", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")))
    if ranges is None:
        ranges = max(1, tags.count() // ROWS_A_RANGE)
    # the first 8 hex digits of the order fall into equal ranges
    width = -(-(1 << 32) // ranges)
    each = each.withColumn("range", F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") / F.lit(width)))
    leaf = [F.col(c) for c in LEVELS]
    sums = each.groupBy(*leaf, "epoch", "range").agg(F.sum("n_tokens").alias("in_range"))
    sums = sums.withColumn("before", F.sum("in_range").over(Window.partitionBy(*leaf).orderBy("epoch", "range").rowsBetween(Window.unboundedPreceding, -1))).select(*leaf, "epoch", "range", F.coalesce("before", F.lit(0)).alias("before"))
    # where a range begins beyond the budget, none of its rows can be chosen
    starts = sums.join(plan.select(*leaf, "budget"), list(LEVELS)).where(F.col("before") <= F.col("budget"))
    near = each.join(starts, [*LEVELS, "epoch", "range"])
    running = F.sum("n_tokens").over(Window.partitionBy(*leaf, "epoch", "range").orderBy("place", "text").rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("upto", F.col("before") + running).where(F.col("upto") <= F.col("budget")).select("doc_id", "text", "epoch", *leaf, "n_tokens")


def op5_budget_mixing(spark, sf_dir):
    from touchline.llm.common import table

    return selection(table(spark, sf_dir, "documents")).drop("text")


def mixed(spark, docs: DataFrame, sf_dir: str | None = None, epochs: int = 1, share: float = SHARE) -> DataFrame:
    """The chosen rows of ``docs``, with its columns, as often as the selection takes them (at most
    ``epochs`` times each). Of a row that is there several times as many copies are taken as the
    prefix holds; if the copies differ in other columns, it isn't defined which."""
    key = ["id", "md5", *LEVELS]
    chosen = selection(docs, epochs=epochs, share=share).groupBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").alias("md5"), *LEVELS).agg(F.count("*").alias("takes"))
    tags = [c.alias(k) for k, c in zip(LEVELS, levels_of(), strict=True)]
    # the row is wrapped, so that its columns can have any names
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    marked = docs.select(row, F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("id"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("md5"), *tags)
    copies = Window.partitionBy(*key)
    joined = marked.join(chosen, key).withColumns({"copy": F.row_number().over(copies.orderBy("id")), "copies": F.count("*").over(copies)})
    times = (F.floor(F.col("takes") / F.col("copies")) + (F.col("copy") <= F.col("takes") % F.col("copies")).cast("long")).cast("int")
    return joined.withColumn("again", F.explode(F.array_repeat(F.lit(True), times))).select("row.*")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, md5(coalesce(text, '')) AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CASE WHEN coalesce(source, '') = 'src0' THEN 'crawl'
              WHEN regexp_full_match(coalesce(source, ''), 'src[1-9]') THEN 'reference'
              WHEN regexp_full_match(coalesce(source, ''), 'src1[0-9]') THEN 'forum' ELSE 'other' END AS domain,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) * 2 AS DOUBLE) AS cap, 1.0::DOUBLE AS w FROM t GROUP BY ALL),
l AS (SELECT domain, lang, sum(cap) AS cap, CASE lang WHEN 'en' THEN 4.0 WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 WHEN 'es' THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM leaf GROUP BY ALL),
d AS (SELECT domain, sum(cap) AS cap, CASE domain WHEN 'crawl' THEN 3.0 WHEN 'reference' THEN 4.0 WHEN 'forum' THEN 3.0 ELSE 1.0 END::DOUBLE AS w FROM l GROUP BY ALL),
d0 AS (SELECT *, CAST(floor(sum(cap) OVER () / 2 * 0.9) AS DOUBLE) AS budget FROM d),
d1 AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
              (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev FROM d0),
d2 AS (SELECT domain, least(cap, greatest(0, w * max(lev) OVER ())) AS budget FROM d1),
l0 AS (SELECT l.*, d2.budget FROM l JOIN d2 USING (domain)),
l1 AS (SELECT *, (budget - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
              (sum(w) OVER (PARTITION BY domain) - coalesce(sum(w) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev FROM l0),
l2 AS (SELECT domain, lang, least(cap, greatest(0, w * max(lev) OVER (PARTITION BY domain))) AS budget FROM l1),
s0 AS (SELECT leaf.*, l2.budget FROM leaf JOIN l2 USING (domain, lang)),
s1 AS (SELECT *, (budget - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
              (sum(w) OVER (PARTITION BY domain, lang) - coalesce(sum(w) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev FROM s0),
s2 AS (SELECT domain, lang, source, CAST(floor(round(least(cap, greatest(0, w * max(lev) OVER (PARTITION BY domain, lang))), 6)) AS BIGINT) AS budget FROM s1),
e AS (SELECT t.*, CAST(epoch AS INTEGER) AS epoch, md5('17:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place FROM t, range(2) AS r(epoch)),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY epoch, place, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM e)
SELECT doc_id, epoch, domain, lang, source, n_tokens FROM c JOIN s2 USING (domain, lang, source) WHERE upto <= budget
"""
