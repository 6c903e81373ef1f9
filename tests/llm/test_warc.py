import hashlib
import random

import pytest

from touchline.llm import warc as m

SCHEMA = "page_id long, url string, html string, sha256 string"


def pages():
    rnd = random.Random(1)
    big = ["<p>é" + "".join(rnd.choice("abc ") for _ in range(n)) for n in (995, 996, 999, 4000, 90_000)]
    rows = [(i, f"http://x/{i}", rnd.choice([*big, None, "", "small"]), "x") for i in range(60)]
    return [*rows, (None, "http://n", big[3], "x"), (7, rows[7][1], rows[7][2], "x"), (99, None, big[4], "x"), (100, "http://a\r\nEvil: 1", "tiny", "x")]


def want(rows):
    out = []
    bodies = [(r[2] or "").encode() for r in rows]
    for r, b in zip(rows, bodies):
        owner = None
        if len(b) >= 1000:
            owner = max((-1 if q[0] is None else q[0]) for q, c in zip(rows, bodies) if c == b)
        mine = -1 if r[0] is None else r[0]
        out.append((r[0], len(b), hashlib.sha1(b).hexdigest(), owner, mine))
    return out


def test_round_trip_and_types(spark, tmp_path):
    rows = pages()
    path = str(tmp_path / "a")
    m.write_archive(spark.createDataFrame(rows, SCHEMA), path)
    got = m.read_archive(spark, path).collect()
    assert len(got) == len(rows)
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"]) for r in got) == sorted((str(w[0]), w[1], w[2]) for w in want(rows))
    own = {w[0]: w for w in want(rows)}
    for r in got:
        _, size, _, owner, mine = own[r["page_id"]]
        if r["page_id"] == 7:
            continue  # repeated rows are looked at below
        revisit = owner is not None and owner != mine
        assert r["record_type"] == ("revisit" if revisit else "response")
        assert r["refers_to"] == (owner if revisit else None)
        fields = m.parse_header(bytes(r["record"]).split(b"\r\n\r\n")[0])
        assert fields["warc-type"] == r["record_type"] and int(fields["content-length"]) == (0 if revisit else size)
        assert "evil" not in fields
    assert spark.read.parquet(f"{path}/payloads").count() == len({r[2] or "" for r in rows})


def test_repeated_rows_have_one_response(spark, tmp_path):
    body = "x" * 2000
    m.write_archive(spark.createDataFrame([(5, "u", body, ""), (5, "u", body, ""), (4, "u", body, "")], SCHEMA), str(tmp_path / "a"))
    got = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in m.read_archive(spark, str(tmp_path / "a")).collect() if r["record_type"] == "revisit")
    assert got == [(4, "revisit", 5), (5, "revisit", 5)]


def test_exactly_a_thousand_bytes(spark, tmp_path):
    rows = [(1, "u", "a" * 999, ""), (2, "u", "a" * 999, ""), (3, "u", "b" * 1000, ""), (4, "u", "b" * 1000, "")]
    m.write_archive(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "a"))
    assert {r["page_id"]: r["refers_to"] for r in m.read_archive(spark, str(tmp_path / "a")).collect()} == {1: None, 2: None, 3: 4, 4: None}


def test_empty_table_and_broken_payload(spark, tmp_path):
    m.write_archive(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"))
    assert m.read_archive(spark, str(tmp_path / "e")).count() == 0
    path = str(tmp_path / "b")
    m.write_archive(spark.createDataFrame([(1, "u", "one", "")], SCHEMA), path)
    other = m.archive(spark.createDataFrame([(1, "u", "two", "")], SCHEMA))[0]
    digest = spark.read.parquet(f"{path}/payloads").first()["sha256"]
    from pyspark.sql import functions as F

    other.withColumn("sha256", F.lit(digest)).write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="has other bytes"):
        m.read_archive(spark, path).collect()
