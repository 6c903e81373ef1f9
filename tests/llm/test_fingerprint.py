import base64
import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from touchline.llm import fingerprint as m


def pieces(text):
    rarity = lambda w, i: 1 if w[-1:] in "\n" else (1 if i < m.FINE else m.SENTENCES) if w[-1:] in ".!?" else m.FINE_CUT if i < m.FINE else m.CUT  # noqa: E731  '' ends too
    marked = "".join(w + ("\x1e" if digest(w) % rarity(w, i) == 0 else " ") for i, w in enumerate(re.split(r" |(?<=\n)", text)))
    return {p for p in marked.split("\x1e") if p.strip(" ")}


def digest(piece):
    return int.from_bytes(xxhash.xxh64_digest(piece.encode(), 42), "big", signed=True)


def unpacked(fingerprint):
    """(count, digests, check sums) of the 16 cells."""
    raw = base64.b64decode(fingerprint)
    return [tuple(int.from_bytes(raw[i + x : i + y], "big", signed=x == 2) for x, y in ((0, 2), (2, 10), (10, 14))) for i in range(0, len(raw), 14)]


def peeled(one, two):
    """Plain peeling of the difference of two fingerprints: ({digests only in one}, {only in two}), None if cells stay."""
    spark_hash = lambda k: xxhash.xxh64_intdigest(k.to_bytes(8, "little", signed=True), 42)
    cells = [[a[0] - b[0], a[1] ^ b[1], a[2] ^ b[2]] for a, b in zip(unpacked(one), unpacked(two))]
    found = (set(), set())
    while True:
        c = next((c for c in cells if abs(c[0]) == 1 and spark_hash(c[1]) & 0xFFFFFFFF == c[2]), None)
        if c is None:
            return None if any(map(any, cells)) else found
        n, k, check = c
        found[n < 0].add(k)
        for row in range(4):
            cell = cells[4 * row + ((k & (2**64 - 1)) >> 3 * row) % 4]
            cell[0], cell[1], cell[2] = cell[0] - n, cell[1] ^ k, cell[2] ^ check


def near(a, b):
    x, y = pieces(a), pieces(b)
    return 1.0 if not x | y else 1 - len(x ^ y) / (len(x) + len(y))


def texts():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7)))
    out = []
    for n in (0, 1, 2, 5, 20, 60, 400):
        for _ in range(3):
            out.append("".join(" ".join(word() for _ in range(rnd.randint(1, 9))) + rnd.choice([". ", "! ", "\n", "\n\n"]) for _ in range(n)))
    return [*out, None, "", "🙂é漢", out[5], " \n "]


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, part string")


def test_against_sets(spark):
    t = texts()
    ids = [3 * i * i * 97 + (5_000_000_000 if i > 20 else 0) for i in range(len(t))]  # gaps over ranges and runs of ranges
    got = {r["doc_id"]: r for r in m.fingerprints(rows_of(spark, list(zip(ids, t, ["x"] * len(t))))).collect()}
    t = [x or "" for x in t]
    for i, text in enumerate(t):
        following, r, half = t[(i + 1) % len(t)], got[ids[i]], len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(near(text, changed)) and r["near_next"] == pytest.approx(near(text, following))
    by_text = {}
    for i, text in enumerate(t):
        assert by_text.setdefault(text, got[ids[i]]["fingerprint"]) == got[ids[i]]["fingerprint"]
    assert len(set(by_text.values())) >= len({frozenset(pieces(x)) for x in t})


def test_published_fingerprints_tell_small_differences(spark):
    t = [x or "" for x in texts()]
    got = sorted(m.fingerprints(rows_of(spark, [(i, x, "x") for i, x in enumerate(t)])).collect(), key=lambda r: r["doc_id"])
    told = 0
    for i, r in enumerate(got):
        changed, following = t[i][: len(t[i]) - len(t[i]) // 2] + t[(i + 1) % len(t)][: len(t[i]) // 2], t[(i + 1) % len(t)]
        for other, print_, found in ((changed, r["edited_fingerprint"], r["differs_edited"]), (following, got[(i + 1) % len(t)]["fingerprint"], r["differs_next"])):
            mine, theirs = ({digest(p) for p in pieces(x)} for x in (t[i], other))
            assert {d["k"] for d in found if d["n"] == 1} == mine - theirs and {d["k"] for d in found if d["n"] == -1} == theirs - mine
            small = peeled(r["fingerprint"], print_)
            assert small is None or small == (mine - theirs, theirs - mine)
            told += small is not None
            assert sum(c[0] for c in unpacked(print_)[:4]) == len(theirs)
    assert told > 20


def pairs_of(spark, one, two):
    return spark.createDataFrame([(7, one, [("new", two, len(one) + len(two))])], "row long, own array<long>, pairs array<struct<which:string,two:array<long>,n:int>>")


def test_larger_sketches_recover_and_fall_back(spark, monkeypatch):
    a, b = [digest(str(i)) for i in range(900)], [digest(str(i)) for i in range(450, 1500)]
    for one, two in ((a, b), (a, []), (a[:3], b[:2])):
        found = m.recovered(pairs_of(spark, one, two)).first()["found"]
        assert m.recovered(pairs_of(spark, one, two), listed=False).first()["found"] == len(found)
        assert {(d["n"], d["k"]) for d in found} == {(1, k) for k in set(one) - set(two)} | {(-1, k) for k in set(two) - set(one)}
    tried = m.attempt(pairs_of(spark, a, b), 0.05).first()  # far too few cells
    assert not tried["ok"]
    monkeypatch.setattr(m, "STEPS", 0)  # no attempt peels
    monkeypatch.setattr(m, "TRIES", 2)
    found = m.recovered(pairs_of(spark, a[:4], b[:2])).first()["found"]
    assert sorted((d["n"], d["k"]) for d in found) == sorted([(1, k) for k in a[:4]] + [(-1, k) for k in b[:2]])


def test_half_of_a_text_stays_nearer_than_another(spark):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8)))
    sentence = lambda: " ".join(word() for _ in range(rnd.randint(6, 14))) + ". "
    t = ["".join(sentence() for _ in range(rnd.randint(3, 30))) for _ in range(300)]
    got = m.fingerprints(rows_of(spark, [(i, x, "x") for i, x in enumerate(t)])).collect()
    assert sum(r["near_edited"] > r["near_next"] for r in got) >= 0.98 * len(t)
    line = [" ".join(word() for _ in range(200)) for _ in range(20)]  # no sentence ends at all
    got = m.fingerprints(rows_of(spark, [(i, x, "x") for i, x in enumerate(line)])).collect()
    assert sum(r["near_edited"] > r["near_next"] for r in got) >= 18


def test_one_range_a_row_and_one_id(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    rows = [(rnd.randint(-(2**62), 2**62), f"{word()} {word()}.", "x") for _ in range(400)]
    got = {r["doc_id"]: r for r in m.with_next(rows_of(spark, rows)).collect()}
    order = sorted(rows)
    assert all(got[i]["next_text"] == order[(k + 1) % len(order)][1] for k, (i, _, _) in enumerate(order))
    same = m.with_next(rows_of(spark, [(5, t, "x") for _, t, _ in rows])).collect()
    assert sorted(r["text"] for r in same) == sorted(r["next_text"] for r in same) and all(r["text"] != r["next_text"] for r in same)


def test_edges(spark):
    assert m.fingerprints(rows_of(spark, [])).count() == 0
    alone = m.fingerprints(rows_of(spark, [(None, "One. Two.", "x")])).first()
    assert alone["near_next"] == 1.0 and alone["doc_id"] is None
    same = m.fingerprints(rows_of(spark, [(4, "b", "x"), (4, "a", "x"), (4, "a", "x"), (None, "zz", "x")])).collect()
    assert sorted(r["near_next"] for r in same) == [0, 0, 0, 1]


def test_no_python_in_the_plan(spark):
    plan = m.fingerprints(rows_of(spark, [(1, "a", "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
