import hashlib
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from touchline.llm import secret_scan as m

KEY = "0123456789abcdef" * 3


def base_spans(text):
    """The contract's base, searched as it is written there and tested for length afterwards."""
    found = []
    for place, (kind, pattern, group, least) in enumerate(
        [
            ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
            ("access", r"AKIA[A-Z0-9]+", 0, 16),
            ("hex", r"[0-9a-f]+", 0, 32),
        ]
    ):
        found += [(x.start(), place, f"{kind}:{x.start()}:{x.end()}") for x in re.finditer(pattern, text or "", re.ASCII) if len(x[group]) >= least]
    return [s for _, _, s in sorted(found)]


TEXTS = [
    None, "", "no secret here", "token = short", "token: token:abcdefgh1", "token: token token:abcdefgh1", "api_key=token=abcdefgh", "paſſword=abcdefghij toKen=abcdefghij",
    f'🙂é漢 Password "=" secret\' :   "{KEY}" AKIA{"A1" * 5}x AKIA{"B2" * 6} AKIAAKIA{"C" * 12}', f"{KEY}{KEY}g{KEY[:31]} {KEY[:32]}", f"apikey:{KEY} API_KEY  =  abc.def/+=_-\nSECRET=12345678",
    "token=abcdefgh " * 300, "x" * 200_000 + f" passwd={KEY}", "AKIA" * 40, "password::abcdefgh1 password=\n=abcdefgh",
]
MORE = "-----BEGIN RSA PRIVATE KEY-----\nabcd+/=\n-----END RSA PRIVATE KEY----- eyJabcdefghij12.eyJabcdefghij12.sig_nature-123 ghp_" + "a1B2" * 9 + " xoxb-123456789012-abc"


def history(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, blob string, spans int").repartition(3)


def test_base_spans_equal_plain(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[8]), (8, TEXTS[8]), (8, "token=abcdefgh")]
    ledger, docs = m.Ledger(spark, str(tmp_path / "ledger")), history(spark, rows)
    ledger.scan(docs)
    got = sorted(((r["doc_id"], r["blob"], r["base"], r["n_assign"], r["n_access"], r["n_hex"]) for r in ledger.report(docs, ["doc_id"]).collect()), key=str)
    want = []
    for i, t in rows:
        spans = base_spans(t)
        want.append((i, hashlib.sha256((t or "").encode()).hexdigest(), ",".join(spans), *[sum(s.startswith(k) for s in spans) for k in m.BASE]))
    assert got == sorted(want, key=str)
    assert sum(w[3] for w in want) > 300


def test_further_kinds(spark, tmp_path):
    ledger, docs = m.Ledger(spark, str(tmp_path / "ledger")), history(spark, [(1, MORE)])
    ledger.scan(docs)
    row = ledger.report(docs, ["doc_id"]).first()
    assert [row[f"n_{k}"] for k in ("pem", "jwt", "github", "slack")] == [1] * 4
    assert row["base"] == "" and [MORE[int(a) : int(b)][:4] for _, a, b in (s.split(":") for s in row["spans"].split(","))] == ["----", "eyJa", "ghp_", "xoxb"]


def test_only_unseen_pairs_are_scanned(spark, tmp_path):
    """A second version of one path, then a new version of one rule: each run scans the pairs that are new, and old paths keep their findings."""
    ledger = m.Ledger(spark, str(tmp_path / "ledger"))
    first = [(1, "token=abcdefgh1"), (2, "nothing"), (3, "token=abcdefgh1")]
    scans = lambda run: {r["blob"]: sorted(r["scanned"]) for r in ledger.rows().where(F.col("run") == run).collect()}
    blob = lambda t: hashlib.sha256(t.encode()).hexdigest()
    ids = sorted(r.id for r in m.RULES)
    assert scans(ledger.scan(history(spark, first))) == {blob("nothing"): ids, blob("token=abcdefgh1"): ids}
    second = [*first, (2, "secret=abcdefgh2")]
    assert scans(ledger.scan(history(spark, second))) == {blob("secret=abcdefgh2"): ids}
    assert scans(ledger.scan(history(spark, second))) == {}
    longer = tuple(replace(r, version=2, least=10, needs=r.needs) if r.kind == "assign" else r for r in m.RULES)
    assert set(map(tuple, scans(ledger.scan(history(spark, second), longer)).values())) == {("assign@2",)}
    spans = lambda rules: sorted((r["doc_id"], r["base"]) for r in ledger.report(history(spark, second), ["doc_id"], rules).collect())
    assert spans(m.RULES) == [(1, "assign:0:15"), (2, ""), (2, "assign:0:16"), (3, "assign:0:15")]
    assert [b for _, b in spans(longer)] == ["", "", "", ""]


def test_a_pair_scanned_twice_counts_once(spark, tmp_path):
    docs = history(spark, [(1, "token=abcdefgh1 token=abcdefgh1")])
    for _ in range(2):  # as by two runs at a time
        m.scanned(m.blobs_of(docs).withColumn("todo", F.array(*[F.lit(r.id) for r in m.RULES]))).select(F.lit("r").alias("run"), "blob", "scanned", "spans").write.mode("append").parquet(str(tmp_path / "ledger"))
    assert m.Ledger(spark, str(tmp_path / "ledger")).report(docs, ["doc_id"]).first()["base"] == "assign:0:15,assign:16:31"


def test_empty_history(spark, tmp_path):
    ledger, docs = m.Ledger(spark, str(tmp_path / "ledger")), history(spark, [(1, "x")]).limit(0)
    ledger.scan(docs)
    assert ledger.rows().count() == 0 and ledger.report(docs, ["doc_id"]).count() == 0


@pytest.mark.parametrize("rule", m.RULES, ids=lambda r: r.kind)
def test_every_kept_match_fits_what_it_needs(rule):
    for text in [*TEXTS, MORE]:
        if any(len(x[rule.group]) >= rule.least for x in re.finditer(rule.pattern, text or "")):
            assert re.search(rule.needs, text)


def test_no_python_in_the_plan(spark):
    plan = m.op12_blob_ledger(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
