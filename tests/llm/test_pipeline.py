import hashlib
import random

import corpus_pipeline
from test_langid import twin as languages_by_hand
from test_mixing import brute as mixed_by_hand
from test_simhash import brute as groups_by_hand
from tokenizers import Tokenizer

from touchline.llm import bpe, langid, suffix
from touchline.llm import mixing as mixing_module


def documents():
    rnd = random.Random(8)
    langs = {"en": ["the", "house", "and", "water", "green", "of", "river"], "de": ["der", "haus", "und", "wasser", "grün", "von", "fluss"]}
    text = lambda lang, n: " ".join(rnd.choice(langs[lang]) + str(rnd.randint(1, 400)) for _ in range(n))
    passage = text("en", 60)
    rows = []
    for i in range(60):
        lang = rnd.choice(list(langs))
        body = text(lang, rnd.randint(20, 250))
        if i % 7 == 0:
            body = text(lang, 90) + passage + body
        rows.append((i, body, lang, rnd.choice(["src0", "src0", "src3", "src12"])))
    rows += [(60 + k, rows[k][1], *rows[k][2:]) for k in range(5)] + [(70, "123 !!", "en", "src0"), (71, None, "en", "src3"), (72, passage[:300], "en", "src3")]
    junk = lambda n: " ".join("".join(rnd.choice("qxzjkvwp") for _ in range(rnd.randint(3, 9))) for _ in range(n))
    return rows + [(73, junk(50), None, "src3"), (74, text("de", 15) + " " + junk(60), None, "src0"), (75, text("en", 80) + " " + junk(6), None, "src12")]


def by_hand(rows):
    share = [foreign for _, _, foreign in languages_by_hand(rows)]
    assert [r[0] for r, x in zip(rows, share) if x is not None and x > langid.FOREIGN] == [73, 74]
    rows = [r for r, x in zip(rows, share) if x is not None and x <= langid.FOREIGN]
    _, group = groups_by_hand([r[1] for r in rows])
    rows = [r for k, r in enumerate(rows) if group[k] == k]
    bodies = [r[1].encode() for r in rows]
    where = {}
    for d, b in enumerate(bodies):
        for i in range(len(b) - suffix.LENGTH + 1):
            where.setdefault(b[i : i + suffix.LENGTH], []).append((d, i))
    gone = [set() for _ in rows]
    for places in where.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + suffix.LENGTH))
    rows = [(r[0], bytes(x for i, x in enumerate(b) if i not in g).decode("utf-8", "ignore"), *r[2:]) for r, b, g in zip(rows, bodies, gone)]
    rows = [r for r in rows if r[1].strip()]
    chosen = {int(x[0]) for x in mixed_by_hand(rows, mixing_module.SHARE, 1)}
    library = Tokenizer.from_file(bpe.default_file())
    out = []
    for i, text, *_ in rows:
        if i in chosen:
            ids = library.encode(text, add_special_tokens=False).ids
            out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out), {"left": len(rows), "cut": sum(map(len, gone))}


def test_against_brute_force(spark, tmp_path):
    rows = documents()
    frame = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    want, did = by_hand(rows)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == want
    assert did["cut"] > 2000 and len(want) < did["left"] < len(rows) - 5


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "tag") for r in documents()], "doc_id long, text string, lang string, source string, n_chars long, did string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert stage(spark, docs.limit(0), "").count() == 0
    cut = corpus_pipeline.suffix_dedup(spark, docs, "").collect()
    assert all(r["n_chars"] == len(r["text"] or "") and r["did"] == "tag" for r in cut)


def test_stages_leave_columns_of_any_name_and_texts_of_one_id(spark):
    names = ["_new", "_did", "_th", "_id", "_md5", "_own", "_takes", "_row", "row", "own", "copy", "id", "md5", "domain", "cover"]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *[f"mine {k}" for k in names]) for r in documents()], f"doc_id long, text string, lang string, source string, n_chars long, {', '.join(f'`{k}` string' for k in names)}")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() > 30
        assert all(list(r)[5:] == [f"mine {k}" for k in names] for r in out.collect())
    rnd = random.Random(4)
    text = lambda: " ".join(f"word{rnd.randint(1, 9999)}" for _ in range(60))
    two = spark.createDataFrame([(5, text(), "en", "src0", 9), (5, text(), "en", "src0", 9), (None, text(), "en", "src0", 9), (None, text(), "en", "src0", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, two, "").count() == 4


def test_copies_of_a_row_are_taken_as_often_as_the_prefix_holds(spark):
    rows = [(1, "w " * 10, "en", "src0")] * 6 + [(2, "v " * 10, "en", "src0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sorted(r["doc_id"] for r in mixing_module.mixed(spark, docs, share=0.7).collect())
    assert len(got) == 4 and set(got) <= {1, 2}
