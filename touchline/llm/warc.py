"""WARC as a content-addressed archive.

Two tables make an archive: ``payloads`` holds the bytes of each different payload once
(zstandard, under their SHA-256), ``records`` the exact header bytes of every record and
the digest of its payload. A record's original bytes are header + payload + CRLF CRLF,
put together by a join on the digest; every payload is hashed again when read.

Record types: of the records with equal payloads of at least ``revisit_from`` bytes the
one with the largest page_id is ``response`` and the others are ``revisit``, referring to
it; smaller payloads are all ``response``. A revisit's header block carries
WARC-Refers-To and the payload digest of the full payload.

Defined results: null html is an empty payload; a null url is written as an empty target;
a null page_id sorts below every other; of repeated rows (same page_id and payload) one is
the response and the rest revisit it; an empty table gives an empty archive; further
columns of the input are ignored.

A payload is shuffled once, compressed, under its page's own key, so thousands of equal
payloads don't meet in one task; digests are grouped with partial aggregation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVISIT_FROM = 1000
#: Fixed value: the archive's date field; nothing in the result depends on the clock.
WARC_DATE = "2000-01-01T00:00:00Z"
CRLF = b"\r\n"

PAYLOADS = "sha256 string, n_bytes long, zstd binary"


def uri(page_id: int | None, n: int) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{n}>"


def header_bytes(page_id, copy, url, kind, sha1, n_bytes, refers_page, refers_copy) -> bytes:
    """The exact header block of a record, its closing blank line included."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {uri(page_id, copy)}", f"WARC-Date: {WARC_DATE}", f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url or '')}", f"WARC-Payload-Digest: sha1:{sha1}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {uri(refers_page, refers_copy)}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {n_bytes if kind == 'response' else 0}"]
    return CRLF.join(x.encode() for x in lines) + CRLF + CRLF


def parse_header(block: bytes) -> dict[str, str]:
    """Field names (lower case) to values; ``version`` is the first line."""
    first, *rest = block.decode("utf-8", "replace").split("\r\n")
    fields = {"version": first}
    for line in rest:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return fields


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = b.to_pylist()
        blocks = [header_bytes(r["page_id"], r["copy"], r["url"], r["kind"], r["sha1"], r["n_bytes"], r["refers_page"], r["refers_copy"]) for r in rows]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("sha256"), pa.array(blocks, pa.binary())], ["page_id", "sha256", "header"])


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=3)
    for b in batches:
        html = [x or b"" for x in b.column("payload").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("sha256"), pa.array([len(x) for x in html], pa.int64()), pa.array([pack.compress(x) for x in html], pa.binary())], ["page_id", "sha256", "n_bytes", "zstd"])


def digests(pages: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha1(body).alias("sha1"), F.sha2(body, 256).alias("sha256"))


def record_plan(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """A row per page: copy (0, 1, ... among repeated rows), kind, refers_page, refers_copy.
    Only the page_id's own rows are numbered together; the owner of a digest is a maximum."""
    from pyspark.sql import Window

    rows = digests(pages)
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("page_id").orderBy("sha256", "url")) - 1)
    key = F.struct(F.coalesce("page_id", F.lit(-(2**63))).alias("p"), F.col("copy").alias("c"))
    owners = rows.where(F.col("n_bytes") >= revisit_from).groupBy("sha256").agg(F.max(key).alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(owners, "sha256", "left")
    revisit = (F.col("n_bytes") >= revisit_from) & F.col("owner").isNotNull() & (F.col("owner") != key)
    return joined.withColumns({
        "kind": F.when(revisit, "revisit").otherwise("response"),
        "refers_page": F.when(revisit & (F.col("owner.p") != -(2**63)), F.col("owner.p")), "refers_copy": F.when(revisit, F.col("owner.c")),
    }).drop("owner")


def archive(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> tuple[DataFrame, DataFrame]:
    """(payloads, records), not yet written. Every payload's bytes appear once whatever its
    size; the keeper is the row with the smallest page_id, found before any bytes move."""
    records = record_plan(pages, revisit_from).mapInArrow(_headers, "page_id long, sha256 string, header binary")
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    packed = pages.select(F.col("page_id").cast("long"), F.sha2(body, 256).alias("sha256"), body.alias("payload")).mapInArrow(_compress, "page_id long, sha256 string, n_bytes long, zstd binary")
    # a keyed minimum with partial aggregation: of equal payloads each task passes on one
    payloads = packed.groupBy("sha256").agg(F.min(F.struct("n_bytes", "zstd")).alias("kept")).select("sha256", "kept.n_bytes", "kept.zstd")
    return payloads, records


def write_archive(pages: DataFrame, path: str, revisit_from: int = REVISIT_FROM) -> None:
    payloads, records = archive(pages, revisit_from)
    payloads.write.mode("errorifexists").parquet(f"{path}/payloads")
    records.write.mode("errorifexists").parquet(f"{path}/records")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record bytes are rebuilt and read; a payload that doesn't hash to its address stops the job."""
    import hashlib

    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        out = []
        for r in b.to_pylist():
            payload = unpack.decompress(r["zstd"], max_output_size=max(r["n_bytes"], 1)) if r["n_bytes"] else b""
            if hashlib.sha256(payload).hexdigest() != r["sha256"]:
                raise ValueError(f"the payload stored under {r['sha256']} has other bytes")
            fields = parse_header(r["header"])
            kind, sha1 = fields["warc-type"], hashlib.sha1(payload).hexdigest()
            if fields["warc-payload-digest"] != f"sha1:{sha1}":
                raise ValueError(f"page {r['page_id']}: the header names another payload")
            own = payload if kind == "response" else b""
            if int(fields["content-length"]) != len(own):
                raise ValueError(f"page {r['page_id']}: {len(own)} bytes in the record, not {fields['content-length']}")
            refers = re.fullmatch(r"<urn:page:(-?\d+|null):\d+>", fields.get("warc-refers-to", ""))
            out.append((r["page_id"], len(payload), sha1, kind, int(refers[1]) if refers and refers[1] != "null" else None, r["header"] + own + CRLF + CRLF))
        cols = list(zip(*out, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record"])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record rebuilt from its header and the payload under its digest: page_id,
    payload_bytes, payload_digest, record_type, refers_to and record (the original bytes)."""
    payloads = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads")
    records = spark.read.schema("page_id long, sha256 string, header binary").parquet(f"{path}/records")
    return records.join(payloads, "sha256").mapInArrow(_parse, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record binary")


def op3_warc_archive(spark, sf_dir):
    import uuid

    from touchline.llm.common import shared_dir, table

    path = f"{shared_dir(spark).rstrip('/')}/touchline/warc-{uuid.uuid4().hex}"
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).drop("record")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest, sha256(body) AS strong FROM p),
o AS (SELECT *, max(page_id) OVER (PARTITION BY strong) AS owner FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND owner <> page_id THEN owner END AS refers_to
FROM o
"""
