import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from touchline.llm import simhash as m


def brute(texts):
    """fingerprints and components by the definition, all pairs."""
    fps = []
    for t in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
        sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return fps, [find(i) for i in range(len(fps))]


def test_golay_indices_meet_at_distance_one():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)
    flipped = words ^ (1 << rng.integers(0, 23, 3000))
    sets = []
    for w in (words, flipped):
        rows, idx = m.indices(w)
        own = [set() for _ in w]
        for r, i in zip(rows.tolist(), idx.tolist()):
            own[r].add(i)
        sets.append(own)
        assert max(map(len, own)) <= 6
    assert all(a & b for a, b in zip(*sets))


def test_keys_meet_at_distance_two():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    for k in (1, 2):
        b = a.copy()
        for _ in range(k):
            b ^= np.uint64(1) << rng.integers(0, 64, len(a)).astype(np.uint64)
        keys = []
        for f in (a, b):
            own = [set() for _ in f]
            for r, key in zip(*(x.tolist() for x in m.fuzzy_keys(f))):
                own[r].add(key)
            keys.append(own)
        assert all(x & y for x, y in zip(*keys))


def texts():
    rnd = random.Random(3)
    base = [" ".join(rnd.choice("abcdefghij") * rnd.randint(1, 3) for _ in range(rnd.randint(40, 300))) for _ in range(25)]
    out = list(base)
    for t in base[:12]:
        w = t.split()
        for _ in range(6):
            v = list(w)
            v[rnd.randrange(len(v))] = "edit"
            out.append(" ".join(v))
    return out + [None, "", "  \t ", "One", "one", "A b", "É café x"] + base[:3]


@pytest.mark.parametrize("hot", [20_000, 2])
def test_against_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(m, "HOT_KEY", hot)
    t = texts()
    fps, comps = brute(t)
    docs = spark.createDataFrame([(i, x, "en", "keep") for i, x in enumerate(t)], "doc_id long, text string, lang string, fp string")
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in m.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(t))] == list(zip(fps, comps))
    assert max(Counter(comps).values()) > 5


def test_long_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(200)], "a long, b long")
    assert {r["root"] for r in m.components(links).collect()} == {0}


def test_empty_repeats_and_nulls(spark):
    schema = "doc_id long, text string, component_id string"
    assert m.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(5, "a b c d", "x"), (5, "a b c d", "x"), (None, "a b c d", "x"), (7, None, "x"), (8, "", "x")]
    docs = spark.createDataFrame(rows, schema)
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in m.near_duplicates(docs).collect())
    assert got == [("5", 5), ("5", 5), ("7", 7), ("8", 7), ("None", 5)]
    kept = m.one_of_each(spark, docs)
    assert kept.columns == ["doc_id", "text", "component_id"] and sorted(r["doc_id"] for r in kept.collect()) == [5, 7]


def test_long_text_is_hashed_whole():
    rnd = random.Random(5)
    long = " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 4) for _ in range(m.BLOCK + 900))
    assert m.simhash(long) == brute([long])[0][0] and m.simhash(long) != m.simhash(long[: len(long) // 3])


def jaccard_groups(texts):
    """The stage's groups by the definition: five words, likeness of 0.8 and more, all pairs."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root, pairs = list(range(len(sets))), []
    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * common >= 4 * len(sets[i] | sets[j]):
                pairs.append((j, i))
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root, pairs, sets


def near_copies():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randint(2, 7)))
    out = []
    for _ in range(6):
        base = [word() for _ in range(rnd.randint(60, 400))]
        out.append(" ".join(base))
        for edits in (1, 1, 2, 2, 3, 3, 4, 5, 6, 8) * 3:
            v = list(base)
            at = rnd.randrange(len(v) - 1)
            for k in range(edits * len(v) // 100 + 1):
                v[(at + k * 31) % len(v)] = word()
            out.append(" ".join(v))
    return out + ["one two three four five six", "one two three four five", "", None]


@pytest.mark.parametrize("block", [m.KEY_BLOCK, 5])
def test_stage_links_at_its_own_likeness(spark, monkeypatch, block):
    monkeypatch.setattr(m, "KEY_BLOCK", block)
    t = near_copies()
    root, pairs, _ = jaccard_groups(t)
    assert sum(bin(m.simhash(t[i]) ^ m.simhash(t[j])).count("1") > m.MAX_BITS for i, j in pairs) > 50
    docs = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in m.one_of_each(spark, docs).collect()) == sorted(set(root))


def test_large_keys_are_compared_whole():
    """Star pairs inside a large key, then all pairs that are still apart."""
    rng = np.random.default_rng(4)
    n = 60
    keys, sids, sizes = np.zeros(n, np.int64), np.arange(n), np.full(n, 100)
    fps = np.where(np.arange(n) % 2, np.uint64(0), np.uint64(0xFFFFFFFFFFFF)) ^ rng.integers(0, 4, n, np.uint64)
    found = list(m.key_pairs(keys, sids, sizes, fps))
    stars = {(int(x), int(y)) for a, b, kind in found if not kind for x, y in zip(a, b)}
    assert 0 < len(stars) <= 2 * n and sum(len(a) for a, _, kind in found if kind) == n
    roots = np.sort(sids // 20)
    # sets of 100, some with few others; one value in two collides in 32 bits, which must not hide a link
    real = [set(range(1000 * (i % 2), 1000 * (i % 2) + 100 - i // 4)) | {10_000 * i + k for k in range(i // 4)} for i in range(n)]
    short = np.empty(n, object)
    short[:] = [np.unique(np.array([v // 2 if v < 100 else v for v in s], np.uint32)).tobytes() for s in real]
    rest = {(int(x), int(y)) for a, b, _ in m.apart_pairs(keys, roots, sids, sizes, short, fps) for x, y in zip(a, b)}
    pairs = {(i, j) for i in range(n) for j in range(i + 1, n) if roots[i] != roots[j]}
    like = {(i, j) for i, j in pairs if 5 * len(real[i] & real[j]) >= 4 * len(real[i] | real[j])}
    assert like <= rest <= {(i, j) for i, j in pairs if (i - j) % 2 == 0} and len(rest) < len(pairs) // 2
    assert {p for p in rest if p[0] % 2} == {p for p in like if p[0] % 2}  # nothing collides there


def test_null_ids_and_one_id_with_two_texts(spark):
    schema = "doc_id long, text string, tag string"
    a, b, c, d, e = ("alpha beta gamma delta one", "red green blue white black grey", "sun moon star sky cloud", "cat dog cow pig hen", "oak elm ash fir yew")
    rows = [(None, a, "x"), (None, b, "x"), (None, c, "x"), (None, c, "x"), (4, c, "x"), (9, d, "x"), (9, e, "x"), (9, e, "x"), (None, None, "x"), (11, d.upper(), "x")]
    kept = m.one_of_each(spark, spark.createDataFrame(rows, schema)).collect()
    want = [(None, a), (None, b), (4, c), (9, d), (9, e), (None, None)]
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept) == sorted((str(i), str(t)) for i, t in want)
    assert m.one_of_each(spark, spark.createDataFrame([(None, a, "y"), (None, a, "x")], schema)).count() == 1


def test_joins_of_the_links_are_not_broadcast(spark, monkeypatch):
    texts = [f"alpha {i % 9} beta gamma {i % 9} delta" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plans, kept = [], {k: getattr(m, k) for k in ("written", "checkpointed")}
    planned = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(m, "written", lambda df, label: planned(df) or kept["written"](df, label))
    monkeypatch.setattr(m, "checkpointed", lambda df: planned(df) or kept["checkpointed"](df))
    found = m.near_duplicates(docs)
    planned(found)
    assert found.count() == 60
    assert sum("SortMergeJoin" in p for p in plans) >= 3
    assert not any("Broadcast" in p for p in plans)
