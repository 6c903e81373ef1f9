import hashlib
import random
import re

import pytest

from touchline.llm import mixing as m


def pour(children, budget):
    """children: {name: (weight, capacity)} -> budgets, by repeated sharing."""
    given = dict.fromkeys(children, 0.0)
    for want_weight in (True, False):
        open_ = {k for k, (w, _) in children.items() if (w > 0) == want_weight}
        while open_:
            left = budget - sum(given.values())
            total = sum(children[k][0] for k in open_) if want_weight else None
            full = {k for k in open_ if (children[k][0] / total * (left + sum(given[x] for x in open_)) if want_weight else left) >= children[k][1]} if left > 1e-9 else set()
            if not full:
                if left > 1e-9 and want_weight:
                    pool = left + sum(given[x] for x in open_)
                    for k in open_:
                        given[k] = children[k][0] / total * pool
                elif left > 1e-9:
                    given[min(open_)] = left
                break
            for k in full if want_weight else [min(full)]:
                given[k] = children[k][1]
            open_ -= full if want_weight else {min(full)}
    return given


def documents(seed=1, n=500):
    rnd = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(rnd.choice([0, 1, 5, 30, 200]))), rnd.choice(["en", "en", "en", "de", "fr", "xx", None]), rnd.choice(["src0"] * 9 + ["src3", "src4", "src12", "zz", None])) for i in range(n)]
    return [*rows, (7, "same id", "de", "src3"), (7, "same id", "de", "src3"), (None, None, "de", "src3")]


def brute(rows, share, epochs):
    toks = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    tree = {}
    for i, t, lang, source in rows:
        d = next((k for k, v in m.DOMAINS.items() if source in v), "other")
        tree.setdefault(d, {}).setdefault(lang or "", {}).setdefault(source or "", []).append((i, t))
    cap = lambda x: sum(toks(t) for _, t in x) * epochs if isinstance(x, list) else sum(map(cap, x.values()))
    out = []
    top = pour({d: (m.DOMAIN_WEIGHTS.get(d, 1.0), cap(x)) for d, x in tree.items()}, int(sum(map(cap, tree.values())) / epochs * share))
    for d, langs in tree.items():
        mid = pour({k: (m.LANG_WEIGHTS.get(k, 1.0), cap(x)) for k, x in langs.items()}, top[d])
        for lang, sources in langs.items():
            low = pour({k: (1.0, cap(x)) for k, x in sources.items()}, mid[lang])
            for source, docs in sources.items():
                used, budget = 0, int(round(low[source], 6) // 1)
                for e in range(epochs):
                    order = sorted(docs, key=lambda x: (hashlib.md5(f"{m.SEED}:{e}:{'null' if x[0] is None else x[0]}".encode()).hexdigest(), hashlib.md5((x[1] or "").encode()).hexdigest()))
                    for i, t in order:
                        used += toks(t)
                        if used <= budget:
                            out.append((str(i), e, d, lang, source, toks(t)))
    return sorted(out)


@pytest.mark.parametrize(("share", "epochs", "ranges"), [(0.9, 2, 7), (0.5, 1, 1), (1.6, 2, 40), (0.02, 3, 5)])
def test_against_brute_force(spark, share, epochs, ranges):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = m.selection(docs, epochs=epochs, share=share, ranges=ranges)
    found = sorted((str(r["doc_id"]), r["epoch"], r["domain"], r["lang"], r["source"], r["n_tokens"]) for r in got.collect())
    assert found == brute(rows, share, epochs) and (found or share < 0.1)


def test_shortage_goes_to_siblings_first(spark):
    rows = [(1, "a " * 10, "en", "src0"), (2, "a " * 1000, "de", "src0"), (3, "a " * 1000, "en", "src3")]
    got = {(r["lang"], r["source"]): r["budget"] for r in m.budgets(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), total=700, epochs=1).collect()}
    # crawl gets 3/7 = 300; its English 10 all taken, the rest stays inside crawl
    assert got == {("en", "src0"): 10, ("de", "src0"): 290, ("en", "src3"): 400}


def test_weight_zero_and_empty(spark):
    schema = "doc_id long, text string, lang string, source string, budget string, w string"
    assert m.selection(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(1, "a b c", "en", "src0", "", ""), (2, "a b c", "de", "src0", "", "")], schema)
    got = {r["lang"]: r["budget"] for r in m.budgets(docs, total=4, epochs=1, lang_weights={"en": 0.0}).collect()}
    assert got == {"de": 3, "en": 1}


def test_stage_keeps_columns_and_repeats(spark):
    docs = spark.createDataFrame([(*r, 1) for r in documents()], "doc_id long, text string, lang string, source string, place int")
    out = m.mixed(spark, docs)
    assert out.columns == docs.columns and 0 < out.count() < docs.count()
    assert out.exceptAll(docs).count() == 0
