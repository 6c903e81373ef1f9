import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from touchline.llm import suffix as m


def brute(texts):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text by the definition."""
    bodies = [(t or "").encode() for t in texts]
    where = defaultdict(list)
    for d, b in enumerate(bodies):
        for i in range(len(b) - m.LENGTH + 1):
            where[b[i : i + m.LENGTH]].append((d, i))
    covered = [np.zeros(len(b), bool) for b in bodies]
    for places in where.values():
        if len(places) > 1:
            for d, i in places:
                covered[d][i : i + m.LENGTH] = True
    out = []
    for b, c in zip(bodies, covered):
        kept = bytes(np.frombuffer(b, np.uint8)[~c])
        out.append((len(b), int(c.sum()), int((np.diff(np.concatenate(([0], c.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    rnd = random.Random(4)
    words = lambda n, a="abcdefghé": "".join(rnd.choice(a + " ") for _ in range(n))
    base = [words(rnd.randint(50, 1500)) for _ in range(30)]
    shared = [words(n) for n in (199, 200, 201, 230, 260, 400, 900)]
    out = list(base)
    for s in shared:
        for _ in range(3):
            out.append(words(rnd.randint(0, 120)) + s + words(rnd.randint(0, 120)))
    for b in base[:8]:  # near copies with an edit every so often
        c = list(b)
        for i in range(rnd.randint(0, 90), len(c), rnd.randint(120, 420)):
            c[i] = "X"
        out.append("".join(c))
    line = words(120)
    out += [words(200) + line + words(200) for _ in range(25)]  # a common line shorter than LENGTH
    # windows that only pairs of different partners share: left of one, right of another
    core, a, b = words(60), words(100), words(100)
    out += [a + core + b, a + core + words(150), words(150) + core + b, words(100) + a[40:] + core + b[:80] + words(90)]
    out += ["ab" * 400, "ab" * 150 + "x", "a" * 1000, base[3], base[3], words(300) + base[4] + base[4], None, "", "short"]
    return out


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, body string")
    return {(r["doc_id"]): (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in m.repeats(docs).collect()}


@pytest.mark.parametrize(("hot", "piece"), [(4000, 1 << 19), (2, 1 << 19), (4000, 333)])
def test_against_brute_force(spark, monkeypatch, hot, piece):
    monkeypatch.setattr(m, "HOT_ANCHOR", hot)
    monkeypatch.setattr(m, "PIECE", piece)
    t = texts()
    if piece != 1 << 19:  # workers import their own copy of the module: scan here
        whole, split = [scan_here(m, t, p) for p in (1 << 19, piece)]
        assert whole == split
        return
    got, want = run(spark, enumerate(t)), brute(t)
    assert sum(w[1] for w in want) > 10_000
    assert [got[i] for i in range(len(t))] == want


def scan_here(m, texts, piece):
    import pyarrow as pa

    m.PIECE = piece
    body = [(t or "").encode() for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(body, pa.binary()), pa.array(range(len(body)), pa.int64()), pa.array([7] * len(body), pa.int64())], ["body", "did", "th"])
    return sorted(tuple(r.values()) for b in m._scan(iter([batch])) for r in b.to_pylist())


def test_suffix_sort_is_lexicographic():
    rnd = random.Random(6)
    buf = np.frombuffer("".join(rnd.choice("ab") for _ in range(4000)).encode(), np.uint8)
    starts = np.array([rnd.randrange(3800) for _ in range(300)])
    sizes = np.array([rnd.randint(0, 150) for _ in range(300)])
    group = np.sort(np.array([rnd.randrange(20) for _ in range(300)]))
    order, common = m.suffix_sort(buf, starts, sizes, group)
    cut = [bytes(buf[a : a + n]) for a, n in zip(starts, sizes)]
    assert [(group[i], cut[i]) for i in order] == sorted(zip(group, cut))
    for k in range(1, 300):
        x, y = cut[order[k - 1]], cut[order[k]]
        if group[order[k - 1]] == group[order[k]]:
            assert common[k] == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_a_lying_hash_is_found(monkeypatch):
    rnd = random.Random(8)
    buf = np.frombuffer("".join(rnd.choice("abcd") for _ in range(600)).encode(), np.uint8)
    starts, sizes, group = np.arange(0, 500, 5), np.full(100, 60), np.zeros(100, np.int64)
    right = m.suffix_sort(buf, starts, sizes, group)
    real = m.hashes

    class Constant(m.Hashes):
        def of(self, prefix, at, size):
            return np.zeros(len(at), np.uint64)

    monkeypatch.setattr(m, "hashes", lambda seed: Constant(seed) if seed == 11 else real(seed))
    again = m.suffix_sort(buf, starts, sizes, group)
    assert (right[0] == again[0]).all() and (right[1] == again[1]).all()


def test_empty_table_and_null_ids(spark):
    assert m.repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rnd = random.Random(1)
    t = "".join(rnd.choice("abc ") for _ in range(400))
    got = run(spark, [(None, t), (2, t + "tail")])
    assert got[None][1] == 400 and got[2][1] == 400


def colliding(h):
    """Two different blocks of 128 letters with one hash: a Thue-Morse pattern of two words whose
    hashes agree in 34 bits, and its complement."""
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGH", np.uint8)
    words = np.array(np.meshgrid(*[letters] * 4)).reshape(4, -1).T
    low = (h.values[words] * m._powers(h.base, 4)).sum(axis=1, dtype=np.uint64) & np.uint64((1 << 34) - 1)
    order = np.argsort(low, kind="stable")
    at = np.flatnonzero(low[order][1:] == low[order][:-1])[0]
    pair = [bytes(words[order[at + k]]) for k in (0, 1)]
    pattern = [bin(i).count("1") % 2 for i in range(32)]
    blocks = [b"".join(pair[t ^ k] for t in pattern) for k in (0, 1)]
    prefix = h.prefix(np.frombuffer(blocks[0] + blocks[1], np.uint8))
    assert blocks[0] != blocks[1] and h.of(prefix, np.array([0]), 128) == h.of(prefix, np.array([128]), 128)
    return blocks


def test_patterns_that_collide_in_the_hash_are_sorted_and_kept(spark):
    rnd = random.Random(31)
    words = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    for seed in (2, 3, 11):
        one, two = colliding(m.hashes(seed))
        tails = [words(40).encode() for _ in range(6)]
        cut = [b + t for t in tails for b in (one, two)]
        buf, sizes = np.frombuffer(b"".join(cut), np.uint8), np.full(len(cut), 168)
        order, _ = m.suffix_sort(buf, np.arange(len(cut)) * 168, sizes, np.zeros(len(cut), np.int64))
        assert [cut[i] for i in order] == sorted(cut)
        # equal tails after blocks that only look equal
        near, tail = words(24), words(552)
        t = [words(300) + b.decode() + near + tail for b in (one, two)] + [words(300) + b.decode() + near + words(500) for b in (one, two, one)]
        assert [run(spark, enumerate(t))[i] for i in range(len(t))] == brute(t)


def test_the_prime_and_the_bytes_sort_alike(monkeypatch):
    rnd = random.Random(9)
    buf = np.frombuffer("".join(rnd.choice("ab") for _ in range(3000)).encode(), np.uint8)
    starts, sizes, group = np.array([rnd.randrange(2800) for _ in range(200)]), np.array([rnd.randint(0, 150) for _ in range(200)]), np.sort(np.array([rnd.randrange(9) for _ in range(200)]))
    by_prime, by_bytes = m._mergesort(buf, starts, sizes, group, m.PrimeHashes(12)), m._sorted_by_bytes(buf, starts, sizes, group)
    cut = [bytes(buf[a : a + n]) for a, n in zip(starts, sizes)]
    for order, common in (by_prime, by_bytes):
        assert [(group[i], cut[i]) for i in order] == sorted(zip(group, cut)) and m._verified(buf, starts, sizes, order, common)
    assert (by_prime[1] == by_bytes[1]).all()
    h = m.PrimeHashes(12)
    prefix = h.prefix(buf)
    value = sum(int(h.values[b]) * pow(h.base, i, m.PRIME) for i, b in enumerate(buf[7:90].tolist())) % m.PRIME
    assert int(h.of(prefix, np.array([7]), 83)[0]) == value


def test_many_copies_and_clashing_names(spark):
    rnd = random.Random(3)
    t = "".join(rnd.choice("abc ") for _ in range(900))
    docs = spark.createDataFrame([(5, t)] * 300 + [(6, t[:500])], "doc_id long, text string")
    found = m.spans(docs).groupBy("did", "th", "start", "end").count()
    assert m.with_spans(docs).selectExpr("max(size(cover))").first()[0] <= found.count()
    assert {tuple(r) for r in m.repeats(docs).select("doc_id", "n_removed", "n_spans").collect()} == {(5, 900, 1), (6, 500, 1)}
    names = ["_new", "_did", "_th", "_start", "_end", "did", "th", "row", "cover", "touched", "new", "body"]
    table = spark.createDataFrame([(i, x, i, *[f"own {k}" for k in names]) for i, x in enumerate([t + "one", "other", t + "two", None])], f"doc_id long, text string, n_chars long, {', '.join(f'`{k}` string' for k in names)}")
    out = m.without_repeats(spark, table)
    assert out.columns == table.columns
    assert {tuple(r)[:3] for r in out.collect()} == {(0, "one", 3), (1, "other", 1), (2, "two", 3), (3, None, 3)}
    assert all(list(r)[3:] == [f"own {k}" for k in names] for r in out.collect())
