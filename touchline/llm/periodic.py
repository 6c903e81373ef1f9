r"""Periodic runs of words, found in the repeated k-grams of each text and cut down to their first period.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and length of at least
max(``least``, 2 q) that can't be extended either way with period q. Its words other than the last q equal those q later, so it
overlaps itself by at least k = ceil(``least`` / 2) words: max(least, 2 q) - q is never less. So every
word of a run lies in a k-gram that its text repeats. All other words are masked (k-grams are told apart by
64-bit hashes: a collision masks less, never more) and the segments that survive are searched alone.

The search is Main and Lorentz's: cut a segment in two; a run over the cut has, for a period p to the left or right of it,
a longest common extension forwards and one backwards from the cut which together reach p; then search both halves. A
run is kept at the block that holds it whole and is cut inside it, so it is found there only. All blocks of one depth
of all segments of a batch of texts are searched at a time in arrays. Common extensions come from ranks of windows of
1, 2, 4... words: equal ranks are equal words, no hash decides. The smallest of the periods with which a stretch is found is its own.

Time is O(m log^2 m) and memory O(m log m) for the m surviving words of a text, O(n) for all n words; texts are never put together
with others beyond BATCH_WORDS words. Nothing is shuffled: a text's runs are found where it is read, so neither hot keys nor
copies matter, and a lost executor costs its own texts again.

Defined results: null text has no words and no runs; words are separated by ASCII white space (space, tab to carriage return)
only; repeated rows and ties (equal starts) are all kept; an empty table gives no rows; columns not asked for are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.common import table

LEAST = 12
#: Texts are searched together until they have so many words.
BATCH_WORDS = 100_000
#: Pairs of positions that are looked at at a time.
CHUNK = 500_000
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
#: An odd multiplier of the k-grams' polynomial hash modulo 2^64, and one that mixes the text's number in (both fixed values).
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def overlap(least: int) -> int:
    """The fewest words by which a run overlaps itself."""
    return max(1, (least + 1) // 2)


def surviving(ids: np.ndarray, begins: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of the stretches of words that lie in k-grams repeated in their own text. ``begins``: first words of the
    texts and, last, the number of all words."""
    n = len(ids)
    if n < k:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    keys = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        keys = keys * BASE + ids[j : n - k + 1 + j].astype(np.uint64) + np.uint64(1)
    inside = np.flatnonzero(text[: n - k + 1] == text[k - 1 :])
    keys = keys[inside] + text[inside].astype(np.uint64) * MIX
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    repeated = np.zeros(len(inside), bool)
    repeated[order[1:]] = same
    repeated[order[:-1]] |= same
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, inside[repeated], 1)
    np.add.at(cover, inside[repeated] + k, -1)
    covered = np.cumsum(cover[:-1]) > 0
    first = np.zeros(n, bool)
    first[begins[:-1][begins[:-1] < n]] = True
    starts = np.flatnonzero(covered & (first | ~np.r_[False, covered[:-1]]))
    ends = np.flatnonzero(covered & np.r_[first[1:] | ~covered[1:], True]) + 1
    return starts, ends


def ranks(words: np.ndarray) -> list[np.ndarray]:
    """For 1, 2, 4... the ranks of the windows of so many words at each position, as long as any window repeats."""
    found, n, span = [words.astype(np.int32)], len(words), 1
    while 2 * span <= n:
        last = found[-1]
        pairs = (last[: n - 2 * span + 1].astype(np.int64) << 32) | (last[span : n - span + 1].astype(np.int64) & 0xFFFFFFFF)
        values, at = np.unique(pairs, return_inverse=True)
        if len(values) == len(pairs):
            break
        wider = -1 - np.arange(n, dtype=np.int32)  # windows beyond the end equal no other
        wider[: len(pairs)] = at
        found.append(wider)
        span *= 2
    return found


def extensions(found: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words from i and j on are equal, and how many before i and j; i < j."""
    forward, back = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for level in reversed(range(len(found))):
        rank, span = found[level], 1 << level
        # both words sequences end at a word that occurs once, so no index passes the end
        forward += span * (rank[i + forward] == rank[j + forward])
        a, b = i - back - span, j - back - span
        back += span * ((a >= 0) & (rank[np.maximum(a, 0)] == rank[np.maximum(b, 0)]))
    return forward, back


def maximal(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """Rows (start, end, period) of the runs in the segments [start, end) of ``words``, which are separated by words that occur once."""
    found, rows = ranks(words), [np.empty((0, 3), np.int64)]
    while len(starts):
        middle, sizes = (starts + ends) // 2, ends - starts
        last = np.cumsum(sizes)
        for at in range(0, int(last[-1]), CHUNK):
            number = np.arange(at, min(at + CHUNK, int(last[-1])))
            block = np.searchsorted(last, number, "right")
            number -= last[block] - sizes[block]  # within the block: first the periods to the left of the cut, then those to the right
            cut, left = middle[block], middle[block] - starts[block]
            i = np.where(number < left, cut - number - 1, cut)
            j = np.where(number < left, cut, cut + number - left + 1)
            some = (words[i] == words[j]) | (words[i - 1] == words[j - 1])
            i, j, block = i[some], j[some], block[some]
            forward, back = extensions(found, i, j)
            period, start, end = j - i, i - back, j + forward
            kept = (forward + back >= period) & (end - start >= least) & (start >= starts[block]) & (end <= ends[block])
            rows.append(np.stack([start[kept], end[kept], period[kept]], axis=1))
        starts, ends = np.r_[starts, middle], np.r_[middle, ends]
        large = ends - starts >= least
        starts, ends = starts[large], ends[large]
    every = np.concatenate(rows)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    smallest = np.ones(len(every), bool)
    smallest[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
    return every[smallest]


def runs_of(texts: list[list], least: int = LEAST) -> list[np.ndarray]:
    """For each text, a list of words, its runs as rows (start, length, period), by start, then period."""
    flat = [w for words in texts for w in words]
    begins = np.cumsum([0, *map(len, texts)])
    number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    ids = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    starts, ends = surviving(ids, begins, overlap(least))
    large = ends - starts >= least
    starts, ends = starts[large], ends[large]
    if not len(starts):
        return [np.empty((0, 3), np.int64)] * len(texts)
    # the segments one after the other, with a word that occurs once before, between and after them
    sizes = ends - starts
    placed = np.cumsum(np.r_[0, sizes[:-1]]) + np.arange(1, len(sizes) + 1)
    joined = -1 - np.arange(int(sizes.sum()) + len(sizes) + 1, dtype=np.int64)
    inner = np.repeat(placed - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(int(sizes.sum()))
    joined[inner] = ids[np.repeat(starts, sizes) + inner - np.repeat(placed, sizes)]
    rows = maximal(joined, placed, placed + sizes, least)
    segment = np.searchsorted(placed, rows[:, 0], "right") - 1
    start = rows[:, 0] - placed[segment] + starts[segment]
    text = np.searchsorted(begins, start, "right") - 1
    out = np.stack([start - begins[text], rows[:, 1] - rows[:, 0], rows[:, 2]], axis=1)
    order = np.lexsort((out[:, 2], out[:, 0], text))
    return np.split(out[order], np.searchsorted(text[order], np.arange(1, len(texts))))


def kept_words(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words, joined by a space, without those that a run has after its first period."""
    if not len(runs):
        return b" ".join(words)
    dropped = np.zeros(len(words) + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(dropped[:-1]) == 0)])


def without_runs(docs: DataFrame, keep: list[str], text: Column | str = "text", least: int = LEAST) -> DataFrame:
    """The ``keep`` columns of each row, its ``runs`` (start, length, period in words) and ``collapsed``, the text without repeats of
    a run's first period."""
    text = F.col(text) if isinstance(text, str) else text
    rows = docs.select(*keep, F.coalesce(text.cast("string"), F.lit("")).cast("binary").alias("_words"))
    schema = T.StructType([f for f in rows.schema if f.name != "_words"] + T._parse_datatype_string(f"runs {RUNS}, collapsed string").fields)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, texts, n = 0, [], 0
            column = batch.column(batch.num_columns - 1)
            for i in range(batch.num_rows):
                texts.append(column[i].as_py().split())
                n += len(texts[-1])
                if n >= BATCH_WORDS or i == batch.num_rows - 1:
                    yield result(batch.slice(done, len(texts)), texts)
                    done, texts, n = i + 1, [], 0

    def result(rows: pa.RecordBatch, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of(texts, least)
        every = np.concatenate(found)
        structs = pa.StructArray.from_arrays([pa.array(every[:, c]) for c in range(3)], names=["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), structs)
        collapsed = pa.array(list(map(kept_words, texts, found)), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([*rows.columns[:-1], lists, collapsed], names=[f.name for f in schema])

    return rows.mapInArrow(search, schema)


WORDS = r"[\x20\x09-\x0D]+"


def planted(doc_id: Column, text: Column) -> Column:
    """The text as words joined by a space, where a tenth of the documents, by the CRC-32 h of their number, repeat themselves from
    word a on with period p: a = g % n and p = 1 + floor((n - a) / (3 + g % 8)), g = floor(h / 10)."""
    h = F.crc32(doc_id.cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")

        def from_a(a: Column) -> Column:
            p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8)))).cast("long")
            word = lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + F.pmod(i - a, p)).cast("int")))
            return F.array_join(F.transform(words, word), " ")

        return F.when(n > 0, F.element_at(F.transform(F.array(F.pmod(g, n)), from_a), 1)).otherwise(F.lit(""))

    words = F.array_remove(F.split(text, WORDS), "")
    return F.when((F.pmod(h, F.lit(10)) == 0) & text.isNotNull(), F.element_at(F.transform(F.array(words), repeated), 1)).otherwise(text)


def digested(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period) and digests of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    best = found.withColumn("best", longest)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return digested(without_runs(docs, ["doc_id"], planted(F.col("doc_id"), F.col("text"))))


#: All pairs of equal 6-grams of a text, put together to stretches of equal distance. CRC-32 as its 256 remainders and the digits' bytes.
ORACLE = rf"""
WITH remainders AS (
    SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS r),
texts AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, CAST(doc_id AS VARCHAR) AS d FROM documents),
hashed AS (
    SELECT row, doc_id, words, len(words) AS n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(d)), lambda i: ord(d[i + 1]))), lambda c, b: xor(c >> 8, r[(xor(c, b) & 255) + 1])), 4294967295) AS h
    FROM texts, remainders),
places AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM hashed),
periods AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM places),
planted AS (
    SELECT row, doc_id, CASE WHEN a IS NULL THEN words ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN words[i + 1] ELSE words[a + (i - a) % p + 1] END) END AS words FROM periods),
words AS (SELECT row, unnest(words) AS w, unnest(range(len(words))) AS i FROM planted),
grams AS (
    SELECT row, i, hash(w, lead(w) OVER v, lead(w, 2) OVER v, lead(w, 3) OVER v, lead(w, 4) OVER v, lead(w, 5) OVER v) AS g, lead(w, 5) OVER v AS sixth FROM words WINDOW v AS (PARTITION BY row ORDER BY i)),
whole AS (SELECT row, i, g FROM grams WHERE sixth IS NOT NULL),
pairs AS (SELECT x.row, x.i, y.i - x.i AS q FROM whole x JOIN whole y ON x.row = y.row AND x.g = y.g AND x.i < y.i),
islands AS (SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT row, q, min(i) AS start, count(*) + 5 + q AS length FROM islands GROUP BY row, q, island HAVING count(*) + 5 + q >= greatest({LEAST}, 2 * q)),
runs AS (SELECT row, start, length, min(q) AS period FROM stretches GROUP BY row, start, length),
dropped AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM runs),
told AS (
    SELECT row, count(*) AS n_runs, max({{'length': length, 'start': -start, 'period': -period}}) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
    FROM runs GROUP BY row),
collapsed AS (SELECT row, string_agg(w, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (row, i) GROUP BY row)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(-best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length, CAST(-best.period AS BIGINT) AS period, CAST(1000 * best.length // -best.period AS BIGINT) AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM texts LEFT JOIN told USING (row) LEFT JOIN collapsed USING (row)"""
