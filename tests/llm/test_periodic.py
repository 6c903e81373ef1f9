import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from touchline.llm import periodic as m


def plain_runs(w, least=12):
    """Every distance, word by word: (start, length, smallest period)."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            if i > s and i - s + q >= max(least, 2 * q):
                found.setdefault((s, i - s + q), q)
            i += i == s
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    told = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *told, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def words(rnd, n, kinds):
    w = [rnd.choice("abcdé漢"[:kinds]) for _ in range(n)]
    if n and rnd.random() < 0.6:
        a, p = rnd.randrange(n), rnd.randint(1, max(1, n // 3))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


@pytest.mark.parametrize("least", [2, 5, 12, 13, 20])
def test_runs_equal_plain(least):
    rnd = random.Random(least)
    for _ in range(300):
        texts = [words(rnd, rnd.randint(0, 80), rnd.randint(1, 6)) for _ in range(rnd.randint(1, 4))]
        assert [[tuple(map(int, r)) for r in runs] for runs in m.runs_of(texts, least)] == [plain_runs(w, least) for w in texts]


def test_thue_morse_and_fibonacci_words():
    """Words that are hard for hashes and rich in runs."""
    thue = [bin(i).count("1") % 2 for i in range(1024)]
    fib = ["a"], ["a", "b"]
    while len(fib[1]) < 900:
        fib = fib[1], fib[1] + fib[0]
    assert [[tuple(map(int, r)) for r in runs] for runs in m.runs_of([thue, fib[1], thue * 2])] == [plain_runs(w) for w in (thue, fib[1], thue * 2)]


def test_chunks_and_batches_change_nothing(monkeypatch):
    rnd = random.Random(5)
    texts = [words(rnd, 200, 3) for _ in range(20)]
    whole = [r.tolist() for r in m.runs_of(texts)]
    monkeypatch.setattr(m, "CHUNK", 37)
    assert [r.tolist() for r in m.runs_of(texts)] == whole
    assert [m.runs_of([t])[0].tolist() for t in texts] == whole


def test_every_word_of_a_run_survives_the_mask():
    rnd = random.Random(8)
    for least in (2, 7, 12):
        for _ in range(200):
            w = words(rnd, rnd.randint(1, 60), 3)
            number = {x: i for i, x in enumerate(dict.fromkeys(w))}
            starts, ends = m.surviving(m.np.array([number[x] for x in w]), m.np.array([0, len(w)]), m.overlap(least))
            for s, n, _ in plain_runs(w, least):
                assert any(a <= s and s + n <= b for a, b in zip(starts, ends))


def rows():
    rnd = random.Random(3)
    out = [(i, " ".join(words(rnd, rnd.randint(0, 90), rnd.randint(1, 6)))) for i in range(150)]
    long = " ".join(f"w{i % 501}" for i in range(20_000))
    edges = [(None, "a " * 30), (None, None), (900, None), (901, ""), (902, " \x0b\n\t"), (903, "a\x1cb\x85c\xa0d e " * 8), (904, "x"), (10, out[10][1]), (10, out[10][1]), (-10, "b c " * 20), (5_000_000_000, "b\tc\r\n" * 20), (905, long)]
    return out + edges


def test_query_equals_plain(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows()], "doc_id long, text string, runs string, collapsed int").repartition(3)
    found = m.digested(m.without_runs(docs, ["doc_id"], m.planted(F.col("doc_id"), F.col("text"))))
    got = sorted(str(tuple(r)) for r in found.where("doc_id is null or doc_id <> 905").collect())
    assert got == sorted(str(plain(i, t)) for i, t in rows() if i != 905)
    long = found.where("doc_id = 905").first()
    assert long["n_runs"] == 1 and long["period"] == 501 and long["start"] + long["length"] == 20_000


def test_operator_gives_spans_and_text(spark):
    docs = spark.createDataFrame([("p", "s " + "a b " * 6 + "e"), ("q", None)], "key string, body string")
    got = {r["key"]: (r["runs"], r["collapsed"]) for r in m.without_runs(docs, ["key"], "body").collect()}
    assert got == {"p": ([(1, 12, 2)], "s a b e"), "q": ([], "")}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert m.digested(m.without_runs(docs, ["doc_id"])).count() == 0
