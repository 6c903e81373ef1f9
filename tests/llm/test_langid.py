import random
import zlib

import numpy as np

from touchline.llm import langid as m

WORDS = {"aa": ["the", "and", "house", "water", "green"], "bb": ["der", "und", "haus", "wasser", "grün"], "cc": ["maison", "eau", "vert", "étoile", "avec"]}


def text(rnd, lang, n):
    return " ".join(rnd.choice(WORDS[lang]) for _ in range(n))


def frame(spark, n=240):
    rnd = random.Random(5)
    rows = [(i, text(rnd, x, rnd.randint(3, 60)), x, "s") for i in range(n) for x in [rnd.choice(list(WORDS))]]
    rows += [(1000, None, "aa", "s"), (1001, "12 !! 7", "aa", "s"), (1002, "", None, "s"), (None, text(rnd, "bb", 20), None, "s"), (1003, "house " * 20_000, None, "s"), (3, rows[3][1], rows[3][2], "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), rows


def test_held_out_accuracy_and_edges(spark):
    docs, rows = frame(spark)
    got = m.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    truth = {r[0]: r[2] for r in rows[:240]}
    assert np.mean([by[i]["lang_pred"] == x for i, x in truth.items()]) > 0.97
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000]["score"] == 0
    assert by[None]["lang_pred"] == "bb" and by[1003]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got)
    kept = m.drop_foreign(spark, docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3


def test_mixture_shares(spark):
    docs, _ = frame(spark)
    rnd = random.Random(9)
    languages, log_p = m.fit(docs)
    both = text(rnd, "aa", 300) + " " + text(rnd, "cc", 300)
    found = m.mixture(log_p, *m.gram_counts(both))
    assert {languages[k] for k in found} == {"aa", "cc"} and min(found.values()) > 0.3
    one = m.mixture(log_p, *m.gram_counts(text(rnd, "bb", 200)))
    assert {languages[k] for k in one} == {"bb"}


def test_long_texts_count_as_short_ones():
    rnd = random.Random(1)
    long = " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 9))) for _ in range(30_000))
    assert len(long) > 16_384
    at, n = m.gram_counts(long)
    whole, k = np.unique(m.gram_buckets(np.frombuffer(b" " + long.encode() + b"  ", np.uint8)), return_counts=True)
    assert (at == whole).all() and (n == k).all()


def test_words_of_one_letter_have_evidence(spark):
    rows = [(i, t, x) for i in range(300) for t, x in [(" a la maison" * 3, "zz") if i % 2 else ("the house I see " * 3, "mm")]]
    docs = spark.createDataFrame([*rows, (1000, "I", None), (1001, "a", None), (1002, "A!", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in m.identify(docs).where("doc_id >= 1000").collect()}
    assert got == {1000: "mm", 1001: "zz", 1002: "zz"}


def twin(rows):
    """(lang_pred, score, share of no language) of each text in plain Python: dictionaries of
    n-grams instead of tables, the same mixture."""
    import math
    import re
    from collections import Counter

    def grams(t):
        t = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in t.lower().encode())
        out = Counter()
        for w in re.split(rb" +", t):
            padded = b" " + w + b" "
            out.update([w] if len(w) == 1 else [padded[i : i + 4] for i in range(len(padded) - 3)] if w else [])
        return out

    bucket = lambda g: (int.from_bytes(g, "big") * 2654435761 % 2**32) >> 16
    seen, langs = {}, {}
    for i, t, lang, *_ in rows:
        if t is not None and lang is not None and i is not None and zlib.crc32(str(i).encode()) % 3 != 1 and (i, t, lang) not in seen:
            seen[(i, t, lang)] = True
            langs.setdefault(lang, Counter()).update({bucket(g): 0 for g in grams(t)})
            for g, n in grams(t).items():
                langs[lang][bucket(g)] += n
    names = sorted(langs)
    total = {x: sum(langs[x].values()) + m.SMOOTH * m.BUCKETS for x in names}

    def em(like, counts, kept):
        pi = dict(kept)
        for _ in range(m.ROUNDS):
            fresh = dict.fromkeys(pi, 0.0)
            for g, n in counts.items():
                whole = sum(pi[x] * like[x](g) for x in pi)
                for x in pi:
                    fresh[x] += n * pi[x] * like[x](g) / whole
            fresh = {x: v / sum(counts.values()) for x, v in fresh.items()}
            done = max(abs(fresh[x] - pi[x]) for x in pi) < 1e-4
            pi = fresh
            if done:
                break
        return pi, sum(n * math.log(sum(pi[x] * like[x](g) for x in pi)) for g, n in counts.items())

    out = []
    for _, t, *_ in rows:
        if not m.has_letter(t):
            out.append((m.UND, 0.0, None))
            continue
        counts = Counter()
        for g, n in grams(t).items():
            counts[bucket(g)] += n
        like = {x: lambda g, x=x: (langs[x][g] + m.SMOOTH) / total[x] for x in names}
        pi, fit = em(like, counts, dict.fromkeys(names, 1 / len(names)))
        while len(pi) > 1:
            gone = min(pi, key=lambda x: (pi[x], [-ord(c) for c in x]))
            fewer = {x: v for x, v in pi.items() if x != gone}
            fewer = {x: v / sum(fewer.values()) for x, v in fewer.items()} if sum(fewer.values()) else dict.fromkeys(fewer, 1 / len(fewer))
            less, less_fit = em(like, counts, fewer)
            if less_fit + 0.5 * math.log(max(sum(counts.values()), 2)) < fit:
                break
            pi, fit = less, less_fit
        best = min(pi, key=lambda x: (-pi[x], x))
        like["?"] = lambda g: 1 / m.BUCKETS
        out.append((best, pi[best], em(like, counts, dict.fromkeys(like, 1 / len(like)))[0]["?"]))
    return out


def test_against_a_plain_twin(spark):
    rnd = random.Random(21)
    docs, rows = frame(spark, 90)
    junk = lambda n: " ".join("".join(rnd.choice("qxzjkvw") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    rows = [r for r in rows if r[0] != 1003] + [(2000, junk(30), None, "s"), (2001, text(rnd, "aa", 30) + " " + text(rnd, "cc", 25), None, "s"), (2002, text(rnd, "aa", 9) + " " + junk(40), None, "s"), (2003, text(rnd, "aa", 60) + " " + junk(5), None, "s")]
    docs = spark.createDataFrame(rows, docs.schema)
    want = twin(rows)
    got = sorted(m.identify(docs).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0]))
    for r, k in zip(got, order):
        assert r["lang_pred"] == want[k][0] and abs(r["score"] - want[k][1]) < 1e-4, rows[k]
    kept = m.drop_foreign(spark, docs).collect()
    stay = [rows[k] for k in range(len(rows)) if want[k][2] is not None and want[k][2] <= m.FOREIGN]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, stay))
    gone = {r[0] for r in rows} - {r[0] for r in stay}
    assert {2000, 2002} <= gone and 2003 not in gone  # the model removes them, not the letter test
    assert all(m.has_letter(r[1]) for r in rows if r[0] in (2000, 2002))


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert m.identify(docs).first()["lang_pred"] == "und"
    assert m.identify(docs.limit(0)).count() == 0


def test_stage_without_training_rows_keeps_texts_with_a_letter(spark):
    rows = [(1, "abc", None), (2, "12 !", None), (3, None, None), (4, "", None), (5, "é", None), (5, "7", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r["text"] for r in m.drop_foreign(spark, docs).collect()) == ["abc", "é"]
    held = spark.createDataFrame([(i, "some words", "aa") for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1], "doc_id long, text string, lang string")
    assert m.drop_foreign(spark, held).count() == held.count() > 0
