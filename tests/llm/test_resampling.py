import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from touchline.llm import resampling as m


def features(text, lo, hi):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return words, [" ".join(words[i : i + n]) for n in range(lo, hi + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, buckets=10_000, ngrams=(1, 1), seed=2024, least=20, percent=10):
    """Rows as (doc_id, n_features, weight, score, rank), sorted."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, text in docs for f in features(text, *ngrams)[1])
    t = Counter(bucket(f) for text in target for f in features(text, *ngrams)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for doc_id, text in docs:
        words, found = features(text, *ngrams)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    among = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(among[: percent * len(among) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


DOCS = [
    *[(i, f"Alpha beta GAMMA delta{i % 7} {'match ' * (i % 30)}é漢 x-y_z ÀB 1{i}") for i in range(200)],
    *[(7, "alpha beta " * 15)] * 5, (None, None), (None, "gamma " * 30), (None, "gamma " * 30), (300, ""), (301, " \n-- "), (302, "word " * 50_000), (303, "🙂 a\x7fb c"), (-4, "beta " * 20),
]
TARGET = ["alpha match match", None, "", "Gamma É漢 delta3"]


def frames(spark, docs=DOCS, target=TARGET):
    rows = [(i, t, "clash", 5, 6) for i, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, bucket int, words int").repartition(3), spark.createDataFrame([(t, 1) for t in target], "text string, gain int")


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"ngrams": (1, 3), "buckets": 50}, {"ngrams": (2, 2), "least": 0, "percent": 100, "seed": 1}])
def test_equals_plain(spark, options):
    assert got(m.resampled(*frames(spark), **options)) == plain(DOCS, TARGET, **options)


def test_ranks_are_whole_over_many_partitions(spark):
    """Ties in everything spread over partitions and still have each rank once."""
    docs = [(i // 40, "same words here " * 10) for i in range(2000)]
    rows = m.resampled(*frames(spark, docs), percent=50).collect()
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 1001))
    ranked = sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"])
    assert [(-r["score"], r["doc_id"]) for r in ranked] == sorted((-r["score"], r["doc_id"]) for r in ranked)


def test_empty_tables(spark):
    docs, target = frames(spark)
    assert m.resampled(docs.limit(0), target).count() == 0
    assert got(m.resampled(docs, target.limit(0))) == plain(DOCS, [])


def test_no_python_in_the_plan(spark):
    plan = m.resampled(*frames(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
