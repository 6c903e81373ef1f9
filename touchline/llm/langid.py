"""Language ID by multilingual mixture inference.

Model: for every language the smoothed probabilities of hashed byte 4-grams (of
lower-cased words, with a space at both ends; a word of one byte is a 3-gram), counted by
Spark over the labelled training texts. A document is a mixture: each of its n-grams comes from language l with
probability pi_l. Expectation-maximisation estimates pi; languages are then taken out one
by one, smallest share first, as long as the penalised likelihood

    sum of log-likelihoods - (languages - 1) / 2 * log(n-grams)

doesn't fall. The prediction is the language with the largest share, the score that share.

The stage of the pipeline (``drop_foreign``) gives every document one component more: text of no
learned language, a uniform distribution over the n-grams. A document goes if that
component explains more than FOREIGN of its n-grams, or if it has no letter.

Training rows: non-null text and lang, chosen by ``trainable``. Of each language the
``per_language`` different rows with the smallest hash of (doc_id, text) are used, whole texts
(a documented bound on labelled rows; PER_LANGUAGE). The model is languages x 65,536 numbers.

Defined results: a text that is null or has no letter is ``und`` with score 0; with no
training rows everything is ``und``; equal shares go to the smaller name; repeated rows
get equal results; very long texts are counted in blocks, whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import small_batches

BUCKETS, GRAM, BLOCK = 1 << 16, 4, 1 << 20
PER_LANGUAGE = 1500
ROUNDS, SMOOTH = 12, 0.05
#: The stage's limit on the share of n-grams that no learned language explains.
FOREIGN = 0.5
UND = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


#: ASCII upper case to lower case, ASCII characters other than letters to spaces; bytes of other characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the byte n-grams that hold no inner space."""
    import re

    folded = b" " + re.sub(rb" +", b" ", text.lower().encode("utf-8", "replace").translate(FOLD)) + b"  "  # the second space lets the last word begin a window, whatever its length
    buf = np.frombuffer(folded, np.uint8)
    if len(buf) <= 16_384:
        return np.unique(gram_buckets(buf), return_counts=True)
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(buf) - GRAM + 1, BLOCK):
        total += np.bincount(gram_buckets(buf[at : at + BLOCK + GRAM - 1]), minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found, total[found]


def gram_buckets(buf: np.ndarray) -> np.ndarray:
    n = len(buf) - GRAM + 1
    if n < 1:
        return np.empty(0, np.int64)
    x = buf.astype(np.uint32)
    packed = x[:n] << 24 | x[1 : n + 1] << 16 | x[2 : n + 2] << 8 | x[3 : n + 3]
    inner = (buf[1 : n + 1] != 32) & (buf[2 : n + 2] != 32)
    alone = x[1 : n + 1][(buf[:n] == 32) & (buf[1 : n + 1] != 32) & (buf[2 : n + 2] == 32)]
    return ((np.concatenate((packed[inner], alone)) * np.uint32(2654435761)) >> 16).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sums: dict[str, np.ndarray] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            at, n = gram_counts(text)
            if lang not in sums:
                sums[lang] = np.zeros(BUCKETS, np.int64)
            sums[lang][at] += n
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "n"])


def fit(docs: DataFrame, trainable: Column | None = None, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """(languages in order, natural log-probabilities [languages, BUCKETS])."""
    from pyspark.sql import Window

    small_batches(docs.sparkSession)
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("doc_id").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string"), (trainable if trainable is not None else F.lit(True)).alias("ok")).where("ok")
    # a threshold on the hash keeps about twice the bound, so that few rows are ranked in one window
    keyed = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], np.zeros((0, BUCKETS), np.float32)
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 2.0 * per_language / n))])
    near = keyed.where((F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))) <= share[F.col("lang")])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))
    chosen = near.select("lang", "h").distinct().select("lang", "h", rank.alias("rank")).where(F.col("rank") <= per_language).select("lang", "h")
    # at most per_language x languages rows are broadcast; of equal rows one counts
    taken = near.join(F.broadcast(chosen), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])
    counted = taken.select("lang", "text").mapInArrow(_count_grams, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sizes)
    table = np.full((len(languages), BUCKETS), SMOOTH)
    table[counted["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int), counted["bucket"].to_numpy(int)] += counted["n"].to_numpy(float)
    return languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def shares(p: np.ndarray, counts: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, float]:
    """EM on the mixture; p: [grams, languages] likelihoods. -> proportions, log-likelihood."""
    n = counts.sum()
    for _ in range(ROUNDS):
        weighted = p * pi
        whole = weighted.sum(axis=1)
        fresh = (counts / whole) @ weighted / n
        done = np.abs(fresh - pi).max() < 1e-4
        pi = fresh
        if done:
            break
    return pi, float(counts @ np.log(p @ pi))


def foreign_share(log_p: np.ndarray, at: np.ndarray, counts: np.ndarray) -> float:
    """The proportion of the component that is no learned language, estimated beside all languages."""
    logs = np.column_stack((log_p[:, at].T.astype(np.float64), np.full(len(at), -np.log(BUCKETS))))
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return float(shares(p, counts, np.full(p.shape[1], 1 / p.shape[1]))[0][-1])


def mixture(log_p: np.ndarray, at: np.ndarray, counts: np.ndarray) -> dict[int, float]:
    """The chosen languages' proportions."""
    logs = log_p[:, at].T.astype(np.float64)
    top = logs.max(axis=1)
    p = np.exp(logs - top[:, None])  # a factor for each n-gram changes no comparison
    kept = np.arange(log_p.shape[0])
    pi, fit_ = shares(p, counts, np.full(len(kept), 1 / len(kept)))
    penalty = 0.5 * np.log(max(counts.sum(), 2))
    while len(kept) > 1:
        out = int(np.lexsort((-kept, pi))[0])
        fewer = np.delete(kept, out)
        start = np.delete(pi, out)
        start = start / start.sum() if start.sum() > 0 else np.full(len(fewer), 1 / len(fewer))
        if len(fewer) == 1:
            less_pi, less_fit = np.ones(1), float(counts @ np.log(np.maximum(p[:, fewer[0]], 1e-300)))
        else:
            less_pi, less_fit = shares(p[:, fewer], counts, start)
        if less_fit + penalty < fit_:
            break
        kept, pi, fit_ = fewer, less_pi, less_fit
    return dict(zip(kept.tolist(), pi.tolist(), strict=True))


def predict(docs: DataFrame, languages: list[str], log_p: np.ndarray) -> DataFrame:
    """The input's doc_id and text with lang_pred, score and the chosen ``languages``' shares."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((languages, log_p))  # languages x 65,536 floats, whatever the corpus

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, table = model.value
        for frame in batches:
            preds, scores, sets = [], [], []
            for text in frame["text"]:
                if not names or not has_letter(text):
                    preds.append(UND)
                    scores.append(0.0)
                    sets.append({})
                    continue
                found = mixture(table, *gram_counts(text))  # a letter makes a word, so there are n-grams
                best = min(found, key=lambda k: (-found[k], k))
                preds.append(names[best])
                scores.append(min(1.0, max(0.0, found[best])))
                sets.append({names[k]: v for k, v in found.items()})
            yield pd.DataFrame({"doc_id": frame["doc_id"], "lang_pred": preds, "score": scores, "shares": sets})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(judge, "doc_id long, lang_pred string, score double, shares map<string,double>")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Train on the rows that aren't held out and predict all: doc_id, held_out, lang_pred, score, shares."""
    languages, log_p = fit(docs, ~held_out(F.col("doc_id")), per_language)
    return predict(docs, languages, log_p).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "shares")


def op6_language_mixture(spark, sf_dir):
    from touchline.llm.common import table

    return identify(table(spark, sf_dir, "documents")).drop("shares")


def drop_foreign(spark, docs: DataFrame, sf_dir: str | None = None, limit: float = FOREIGN, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The documents in a learned language (learned from the rows that aren't held out): those go that have
    no letter, or of whose n-grams more than ``limit`` belong to no learned language by the mixture. Without
    training rows all texts with a letter stay. Rows and columns otherwise stay, and repeated ids are
    kept or dropped by their own text."""
    languages, log_p = fit(docs, ~held_out(F.col("doc_id")), per_language)
    model = spark.sparkContext.broadcast((bool(languages), log_p))  # languages x 65,536 floats, whatever the corpus

    @F.pandas_udf("boolean")
    def native(text: pd.Series) -> pd.Series:
        known, table = model.value
        return text.map(lambda t: has_letter(t) and (not known or foreign_share(table, *gram_counts(t)) <= limit)).astype(bool)

    return docs.where(native(F.col("text").cast("string")))
