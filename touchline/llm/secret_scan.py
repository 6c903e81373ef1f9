r"""Secret scans over an incremental ledger of blobs. Native Spark SQL throughout.

A history is rows of (path, version's text). A text is addressed by its SHA-256: the blob. The ledger, a Parquet
folder, has a row for each blob and run: the (rule, version) pairs that were scanned and the spans found, in one
row, so that a run that ends early leaves neither without the other. A run reduces the history to its
different blobs (a partial reduction in each task, so a text that a third of all rows share is shuffled once a task), takes from each
blob the pairs that the ledger has, and scans only what is left: new blobs under all rules, known blobs under new or changed rules. The report joins the
findings of the rules' present versions back to every path.

Spans are code points, end exclusive: what stands between a rule's matches and the matches themselves alternate, so a running
sum of their lengths gives the places.

Kinds: ``assign``, ``access`` and ``hex`` are the base; ``pem``, ``jwt``, ``github`` and ``slack`` come on top.

Defined results: null text is empty and has no secrets; a null path is a path; repeated rows are reported each; a
kind's matches are leftmost and don't overlap, those of different kinds may; a rule's match that is too short is dropped after the
search, so it still covers its place; an empty history gives no rows and leaves the ledger without new ones;
other columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import shared_dir, table


@dataclass(frozen=True)
class Rule:
    """``pattern``: what is searched for; ``needs``: a pattern that every text with a kept match fits; ``group`` must
    have ``least`` characters. A change of any of these needs a new ``version``."""

    kind: str
    pattern: str
    needs: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


def either_case(word: str) -> str:
    """ASCII letters in either case; other letters never fold to them."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Names that secrets are assigned to.
NAMES = ("password", "passwd", "secret", "token", "api_?key")
_NAME = "(" + "|".join(map(either_case, NAMES)) + r""")["']?\x20*[:=]\x20*["']?"""
BASE = ("assign", "access", "hex")
#: Where the characters before a match can't be part of one, "at least n" in the pattern keeps what a search for any length would keep after a test of its length.
#: Not so for assign: a value that is too short may hold the next name.
RULES = (
    Rule("assign", _NAME + "([A-Za-z0-9+/_.=-]+)", _NAME + "[A-Za-z0-9+/_.=-]{8}", group=2, least=8),
    Rule("access", "AKIA[A-Z0-9]{12,}", "AKIA[A-Z0-9]{12}"),
    Rule("hex", "[0-9a-f]{32,}", "[0-9a-f]{32}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]*-----END [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", r"eyJ[A-Za-z0-9_-]{10,}\."),
    Rule("github", "gh[oprsu]_[A-Za-z0-9]{36,}", "gh[oprsu]_[A-Za-z0-9]{36}"),
    Rule("slack", "xox[abeoprs]-[A-Za-z0-9-]{10,}", "xox[abeoprs]-[A-Za-z0-9-]{10}"),
)
SPAN = "struct<start:long,kind:string,version:int,end:long>"
SCHEMA = f"run string, blob string, scanned array<string>, spans array<{SPAN}>"


def address(text: Column) -> Column:
    """The blob of a text."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def blobs_of(history: DataFrame) -> DataFrame:
    """blob, text: each different text once."""
    return history.select(address(F.col("text")).alias("blob"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))


def pieces(rule: Rule, number: int) -> Column:
    """For each match and its place among the rule's matches: characters before it and since the last one, its own, its group's."""
    text, regex = F.col("text"), F.lit(rule.pattern)
    lengths = lambda c: F.transform(c, lambda x: F.char_length(x).cast("long"))
    gap, own = lengths(F.split(text, rule.pattern, -1)), lengths(F.regexp_extract_all(text, regex, F.lit(0)))
    value = lengths(F.regexp_extract_all(text, regex, F.lit(rule.group))) if rule.group else own
    zipped = F.arrays_zip(gap.alias("gap"), own.alias("own"), value.alias("value"))
    row = lambda x, i: F.struct(F.lit(number).alias("rule"), i.alias("i"), x["gap"].alias("gap"), x["own"].alias("own"), x["value"].alias("value"))
    return F.transform(zipped, row)


def scanned(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, scanned, spans of rows (blob, text, todo); todo lists the ids of the rules to apply. Nothing moves between partitions of blobs."""
    none = F.array().cast("array<struct<rule:int,i:int,gap:bigint,own:bigint,value:bigint>>")
    apply = lambda rule, n: F.when(F.array_contains("todo", rule.id) & F.col("text").rlike(rule.needs), pieces(rule, n)).otherwise(none)
    all_pieces = F.flatten(F.array(*[apply(rule, n) for n, rule in enumerate(rules)]))
    found = blobs.select("blob", "todo", F.explode_outer(all_pieces).alias("p")).select("blob", "todo", "p.*")
    running = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.coalesce("own", F.lit(0))).over(running)
    of_rule = lambda f: F.element_at(F.array(*[F.lit(f(r)) for r in rules]), F.col("rule") + 1)
    span = F.struct((F.col("end") - F.col("own")).alias("start"), "rule", of_rule(lambda r: r.kind).alias("kind"), of_rule(lambda r: r.version).alias("version"), F.col("end").alias("end"))
    kept = F.col("own").isNotNull() & (F.col("value") >= of_rule(lambda r: r.least))
    spans = F.array_sort(F.collect_list(F.when(kept, span)))
    short = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["version"].alias("version"), s["end"].alias("end")))
    return found.withColumn("end", end).groupBy("blob").agg(F.first("todo").alias("scanned"), short.alias("spans"))


class Ledger:
    """What has been scanned, and what was found, in a Parquet folder that only grows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMA)  # before the first run

    def unseen(self, history: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """blob, text, todo: the different texts under which some of the rules' present versions weren't applied yet."""
        seen = self.rows().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("seen"))
        present = F.array(*[F.lit(r.id) for r in rules])
        todo = F.array_except(present, F.coalesce("seen", F.array().cast("array<string>")))
        return blobs_of(history).join(seen, "blob", "left").withColumn("todo", todo).where(F.size("todo") > 0).drop("seen")

    def scan(self, history: DataFrame, rules: tuple[Rule, ...] = RULES) -> str:
        """Scan what is unseen and append it; the name of the run."""
        run = uuid.uuid4().hex
        scanned(self.unseen(history, rules), rules).select(F.lit(run).alias("run"), "blob", "scanned", "spans").write.mode("append").parquet(self.path)
        return run

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """blob, spans of the rules' present versions, by start and the rules' order. A pair that two runs scanned at a time counts once."""
        known = F.array(*[F.lit(r.id) for r in rules])
        kinds = F.array(*[F.lit(r.kind) for r in rules])
        current = F.filter("spans", lambda s: F.array_contains(known, F.concat(s["kind"], F.lit("@"), s["version"].cast("string"))))
        listed = self.rows().select("blob", current.alias("spans")).where(F.size("spans") > 0).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
        keyed = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("place"), s["kind"].alias("kind"), s["end"].alias("end"))))
        return listed.select("blob", keyed.alias("spans"))

    def report(self, history: DataFrame, paths: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """The ``paths`` columns of every row of the history, its blob, and n by kind (map), base and all spans as text."""
        shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
        base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
        count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
        told = self.findings(rules).select("blob", *[count(r.kind) for r in rules], shown(base).alias("base"), shown(F.col("spans")).alias("spans"))
        joined = history.select(*paths, address(F.col("text")).alias("blob")).join(told, "blob", "left")
        return joined.select(*paths, "blob", *[F.coalesce(f"n_{r.kind}", F.lit(0).cast("long")).alias(f"n_{r.kind}") for r in rules], *[F.coalesce(c, F.lit("")).alias(c) for c in ("base", "spans")])


def op12_blob_ledger(spark, sf_dir):
    """doc_id is the path; a new ledger, so every different text is scanned once."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ledger = Ledger(spark, f"{shared_dir(spark).rstrip('/')}/touchline/ledger-{uuid.uuid4().hex}")
    ledger.scan(docs)
    return ledger.report(docs, ["doc_id"]).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def _sql(rule: Rule, n: int) -> str:
    quoted = rule.pattern.replace("'", "''")
    return f"""SELECT row, {n} AS place, '{rule.kind}' AS kind, {rule.least} AS least, unnest(list_transform(regexp_split_to_array(text, '{quoted}'), lambda x: length(x))) AS gap,
        unnest(list_transform(regexp_extract_all(text, '{quoted}', 0), lambda x: length(x))) AS own, unnest(list_transform(regexp_extract_all(text, '{quoted}', {rule.group}), lambda x: length(x))) AS val, generate_subscripts(regexp_split_to_array(text, '{quoted}'), 1) AS i FROM texts WHERE regexp_matches(text, '{quoted}')"""


ORACLE = f"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
pieces AS ({" UNION ALL ".join(_sql(r, n) for n, r in enumerate(RULES))}),
placed AS (SELECT *, sum(gap + coalesce(own, 0)) OVER (PARTITION BY row, place ORDER BY i) AS stop FROM pieces),
spans AS (
    SELECT row, kind, kind IN ('assign', 'access', 'hex') AS base, stop - own AS start, place, kind || ':' || CAST(stop - own AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span
    FROM placed WHERE own IS NOT NULL AND val >= least),
told AS (
    SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(span, ',' ORDER BY start, place) FILTER (base) AS base, string_agg(span, ',' ORDER BY start, place) AS spans
    FROM spans GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN told USING (row)"""
