"""Writes that readers see whole or not at all: journals of small documents, and tables published by a manifest.

A ``Journal`` is a folder of numbered documents that are created but never replaced. The number is taken by creating the file, which
fails if it is there, so of two writers that saw the same last entry one is told so (compare and set). Each document carries
its own digest; one that was cut short is no entry.

A published table is staged in a folder of its own first. Its manifest, an entry of the table's journal, is written last and names every
file with its SHA-256 and rows, the schema and the schema's hash. Readers open only what the newest manifest names,
so a write that ended before its manifest is invisible, and files that were changed, cut or removed since are refused.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a file at most, so that a file's bytes fit in a task that checks its digest.
FILE_ROWS = 2_000_000


class NotPublished(ValueError):
    """There is no manifest, or what it names isn't there as it was written."""


class Conflict(ValueError):
    """Somebody else wrote the entry first."""


def canonical(body: dict) -> str:
    return json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


class Journal:
    """Numbered documents below ``path``, in any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._folder = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def last(self) -> int:
        """The last number taken, 0 before the first."""
        return max(self._numbers(), default=0)

    def append(self, body: dict, expected: int | None = None) -> int:
        """The number of the new entry. With ``expected``, the last number that the caller knows of, ``Conflict`` if there is a later one."""
        number = self.last() + 1
        if expected is not None and number != expected + 1:
            raise Conflict(f"{self.path}: entry {expected + 1} is taken")
        text = canonical(body)
        document = json.dumps({"sha256": hashlib.sha256(text.encode()).hexdigest(), "body": text}).encode()
        try:
            out = self._fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(self._folder, f"{number:09d}.json"), False)
        except Exception as e:
            if "already exists" not in str(e):
                raise
            if expected is not None:
                raise Conflict(f"{self.path}: entry {number} is taken") from e
            return self.append(body)
        try:
            out.write(document)
        finally:
            out.close()
        return number

    def entries(self) -> list[tuple[int, dict]]:
        """(number, body) of the whole documents, in order."""
        numbers = self._numbers()
        if not numbers:
            return []
        rows = self.spark.read.text([f"{self.path}/{n:09d}.json" for n in numbers], wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value").collect()
        found = []
        for row in sorted(rows, key=lambda r: r["name"]):
            try:
                document = json.loads(row["value"])
                if hashlib.sha256(document["body"].encode()).hexdigest() == document["sha256"]:
                    found.append((int(row["name"][:-5]), json.loads(document["body"])))
            except (ValueError, KeyError, TypeError, AttributeError):
                continue  # cut short
        return found


def schema_hash(schema: T.StructType) -> str:
    """Of names and types in order."""
    return hashlib.sha256(json.dumps([{"dtype": f.dataType.simpleString(), "name": f.name} for f in schema], separators=(",", ":"), sort_keys=True).encode()).hexdigest()


@dataclass
class Staged:
    """A table's files, written but not published."""

    path: str
    body: dict = field(default_factory=dict)


def file_facts(spark: SparkSession, folder: str) -> DataFrame:
    """name, sha256, bytes, rows of the Parquet files of a folder."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    digests = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select(name(F.col("path")).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
    rows = spark.read.parquet(folder).groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("rows"))
    return digests.join(rows, "name", "left").select("name", "sha256", "bytes", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"))


def stage(df: DataFrame, path: str, minimum: int = 1, about: dict | None = None) -> Staged:
    """Write ``df`` aside. Fewer than ``minimum`` rows are an error. The manifest lists one entry a file."""
    spark = df.sparkSession
    folder = f"data-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{path.rstrip('/')}/{folder}")
    files = [r.asDict() for r in file_facts(spark, f"{path.rstrip('/')}/{folder}").orderBy("name").collect()]
    rows = sum(f["rows"] for f in files)
    if rows < minimum:
        raise ValueError(f"{rows} rows; {minimum} are required")
    body = {"folder": folder, "files": files, "rows": rows, "columns": len(df.columns), "schema": df.schema.jsonValue(), "schema_sha256": schema_hash(df.schema), "about": about or {}}
    return Staged(path.rstrip("/"), body)


def commit(spark: SparkSession, staged: Staged) -> int:
    """Publish: from here on readers see it."""
    return Journal(spark, f"{staged.path}/manifests").append(staged.body)


def manifest(spark: SparkSession, path: str) -> dict:
    """The newest manifest of a table."""
    found = Journal(spark, f"{path.rstrip('/')}/manifests").entries()
    if not found:
        raise NotPublished(f"{path}: no manifest")
    return found[-1][1]


def published(spark: SparkSession, path: str) -> DataFrame:
    """The table as its newest manifest names it; ``NotPublished`` if a file is missing or differs."""
    body = manifest(spark, path)
    folder = f"{path.rstrip('/')}/{body['folder']}"
    schema = T.StructType.fromJson(body["schema"])
    if schema_hash(schema) != body["schema_sha256"]:
        raise NotPublished(f"{path}: the schema isn't the one that was hashed")
    if not body["files"]:
        return spark.createDataFrame([], schema)
    named = spark.createDataFrame([(f["name"], f["sha256"]) for f in body["files"]], "name string, sha256 string")
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("actual"))
    wrong = named.join(there, "name", "left").where(~F.col("sha256").eqNullSafe(F.col("actual"))).select("name").limit(5).collect()
    if wrong:
        raise NotPublished(f"{path}: missing or changed: {', '.join(r['name'] for r in wrong)}")
    return spark.read.schema(schema).parquet(*[f"{folder}/{f['name']}" for f in body["files"]])


def finite(columns: list[str]) -> Column:
    """All of them are numbers, none is null, NaN or infinite."""
    ok = F.lit(True)
    for c in columns:
        ok &= F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    return ok


def baseline(features: DataFrame, path: str, columns: list[str], league: str, day: str, minimum: int = 1_000) -> int:
    """Publish the reference frame of a drift monitor: ``columns`` of the rows where all are finite, in that order and
    without identifiers; the manifest also says how many rows were left out, the days covered and the rows a league."""
    spark = features.sparkSession
    kept = finite(columns)
    by_league = features.groupBy(league).agg(F.count_if(kept).alias("n"), F.count_if(~kept).alias("skipped"), F.min(F.when(kept, F.col(day))).cast("string").alias("first"), F.max(F.when(kept, F.col(day))).cast("string").alias("last")).collect()
    days = [d for r in by_league for d in (r["first"], r["last"]) if d]
    about = {"leagues": {str(r[league]): r["n"] for r in by_league if r["n"]}, "skipped": sum(r["skipped"] for r in by_league), "start": min(days, default=None), "end": max(days, default=None), "minimum": minimum}
    return commit(spark, stage(features.where(kept).select(*[F.col(c).cast("double").alias(c) for c in columns]), path, minimum, about))
