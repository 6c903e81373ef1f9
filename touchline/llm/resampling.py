r"""Target-distribution importance resampling. Native Spark SQL throughout.

Words are runs of digits, lower-cased letters and characters beyond ASCII; features are runs of ``ngrams[0]`` to
``ngrams[1]`` consecutive words. A feature's bucket is its CRC-32 modulo ``buckets``. Buckets are counted over the whole corpus and
over the whole target texts; a bucket's gain is the logarithm of its smoothed share in the target over that in the
corpus (in thousandths, rounded down), and a document's weight the sum over its features. A seeded Gumbel
variable by document is added to the weight, so the highest scores are a draw without replacement in
proportion to the likelihood ratio.

The plan: arrays of words are exploded and counted by bucket, a partial count in each task, so ``buckets``
rows a task are shuffled; the gain table has exactly ``buckets`` rows (its size is a parameter) and is broadcast to the exploded words; a
document's sum is complete within its task before one short row of it is shuffled. Then all rows are sorted over range
partitions, the candidates first; a row's place within its partition plus the sizes of the partitions before it is its rank.
Rows that tie in everything are told apart by a row number, so they spread over partitions too.

Defined results: null text has no words; a document without words has weight 0; a null doc_id counts as an empty
string in the hash and comes after the others in ties; repeated rows each have a rank; a null or empty target gives every
bucket a target share by smoothing alone; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII other than digits and lower-case letters (upper-case ones are lowered before).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, SEED, LEAST, PERCENT = 10_000, 2024, 20, 10
#: monotonically_increasing_id holds the partition above this many bits.
PLACE_BITS = 33


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, BETWEEN), "")


def grams(words: Column, ngrams: tuple[int, int]) -> Column:
    """All runs of the given numbers of words, joined by a space; repeats stay."""
    if ngrams == (1, 1):
        return words
    left = lambda w, n: F.greatest(F.size(w) - n + 1, F.lit(0))

    def all_runs(w: Column) -> Column:
        runs = [w]
        for n in range(2, ngrams[1] + 1):  # a run of n is one of n - 1 and the word that follows it
            runs.append(F.zip_with(F.slice(runs[-1], F.lit(1), left(w, n)), F.slice(w, F.lit(n), left(w, n)), lambda a, b: F.concat(a, F.lit(" "), b)))
        return F.flatten(F.array(*runs[ngrams[0] - 1 :]))

    return F.element_at(F.transform(F.array(words), all_runs), 1)  # the words are split once


def bucket_of(feature: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets)).cast("int")


def counted(texts: DataFrame, buckets: int, ngrams: tuple[int, int], name: str) -> DataFrame:
    """bucket and how many of all the texts' features lie in it."""
    features = texts.select(F.explode(grams(words_of(F.col("text")), ngrams)).alias("feature"))
    return features.groupBy(bucket_of(F.col("feature"), buckets).alias("bucket")).agg(F.count("*").alias(name))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, ngrams: tuple[int, int] = (1, 1)) -> DataFrame:
    """bucket, gain: exactly ``buckets`` rows, written once."""
    all_buckets = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = all_buckets.join(counted(docs, buckets, ngrams, "s"), "bucket", "left").join(counted(target, buckets, ngrams, "t"), "bucket", "left").fillna(0, ["s", "t"])
    both = written(both, "buckets")
    total = both.agg(F.sum("s"), F.sum("t")).first()
    smoothed = lambda c: (F.col(c) + 1).cast("double")
    ratio = smoothed("t") * F.lit(float(total[0] + buckets)) / (smoothed("s") * F.lit(float(total[1] + buckets)))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weighed(docs: DataFrame, table_of_gains: DataFrame, buckets: int = BUCKETS, ngrams: tuple[int, int] = (1, 1)) -> DataFrame:
    """row, doc_id, n_words, n_features, weight, a row for each document."""
    words = words_of(F.col("text"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"))
    features = rows.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.explode_outer(grams(F.col("words"), ngrams)).alias("feature"))
    found = features.withColumn("bucket", bucket_of(F.col("feature"), buckets)).join(F.broadcast(table_of_gains), "bucket", "left")
    return found.groupBy("row", "doc_id", "n_words").agg(F.count("feature").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """A seeded Gumbel variable by id, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, order: list[Column], among: Column, percent: int) -> DataFrame:
    """``scored`` with rank: 1, 2, 3... in ``order`` for the first floor(percent * n / 100) of the n rows that ``among`` names, else null."""
    part, place = F.shiftright("place", PLACE_BITS), F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    # written, so that the places stay: a sort done again may cut its ranges elsewhere
    placed = written(scored.withColumn("among", among).orderBy(F.desc("among"), *order).withColumn("place", F.monotonically_increasing_id()), "places")
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows"), F.count_if("among").alias("n"))
    # a row for each range partition
    before = sizes.select("part", F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("n"))
    at = F.coalesce(F.col("before"), F.lit(0)) + place + 1
    drawn = F.col("among") & (at <= F.floor(F.col("n") * percent / 100))
    return placed.withColumn("part", part).join(F.broadcast(before), "part").withColumn("rank", F.when(drawn, at)).drop("part", "before", "n", "place", "among")


def resampled(
    docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, ngrams: tuple[int, int] = (1, 1), seed: int = SEED, least: int = LEAST, percent: int = PERCENT
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null where it isn't drawn."""
    scored = weighed(docs, gains(docs, target, buckets, ngrams), buckets, ngrams).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("row")]
    return ranked(scored, order, F.col("n_words") >= least, percent).select("doc_id", "n_features", "weight", "score", "rank")


def op13_importance_resampling(spark, sf_dir):
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 in SQL: the 256 remainders follow from the polynomial, a word's bytes from its hex digits; once for each different word.
ORACLE = f"""
WITH remainders AS (
    SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS r),
texts AS (
    SELECT 'd' AS side, row_number() OVER () AS row, doc_id, text FROM documents
    UNION ALL SELECT 'b', NULL, NULL, text FROM benchmark),
listed AS (
    SELECT side, row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM texts),
features AS (SELECT side, row, unnest(words) AS w FROM listed),
vocabulary AS (SELECT side, w, count(*) AS n FROM features GROUP BY ALL),
hexed AS (SELECT w, hex(w) AS x FROM (SELECT DISTINCT w FROM vocabulary)),
byted AS (
    SELECT w, list_transform(range(length(x) // 2), lambda i: (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 1) AS bytes FROM hexed),
bucketed AS (
    SELECT w, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, r[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM byted, remainders),
sums AS (
    SELECT bucket, sum(CASE WHEN side = 'd' THEN n ELSE 0 END) AS s, sum(CASE WHEN side = 'b' THEN n ELSE 0 END) AS t FROM vocabulary JOIN bucketed USING (w) GROUP BY bucket),
totals AS (SELECT sum(s) AS ss, sum(t) AS tt FROM sums),
gained AS (
    SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(ss + {BUCKETS} AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(tt + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS gain FROM sums, totals),
weights AS (
    SELECT row, sum(gain) AS weight FROM features JOIN bucketed USING (w) JOIN gained USING (bucket) WHERE side = 'd' GROUP BY row),
hashes AS (
    SELECT row, doc_id, CAST(len(words) AS BIGINT) AS n_features,
        list_reduce(list_transform(range(8), lambda i: instr('0123456789abcdef', sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), ''))[i + 1]) - 1), lambda a, b: a * 16 + b) AS h
    FROM listed WHERE side = 'd'),
scored AS (
    SELECT row, doc_id, n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
        CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
    FROM hashes LEFT JOIN weights USING (row)),
drawn AS (
    SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, row) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * {PERCENT} // 100 THEN rank END AS rank
FROM scored LEFT JOIN drawn USING (row)"""
