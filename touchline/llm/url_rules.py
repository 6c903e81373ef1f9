"""URL filter: rules indexed by their rarest literal token.

Every rule names literal tokens that a matching URL must contain. How often each of
those tokens occurs is counted over all URLs; a rule is filed under the rarest. The index is a
table of (token, rule): a URL's own tokens fetch candidate rules by an equi-join, and only
the candidates' regular expressions run. Neither side is broadcast by force, so rules may be as
many as URLs; each different URL is judged once and the verdicts return by a join.

Two kinds of rule:

* host rules ``host/path``: they fit the host and all its subdomains where the URL's
  path starts with the rule's path; among those that fit, the longest wins (equal
  lengths: the smaller text);
* pattern rules: a regular expression over the lower-cased URL. They decide only where no
  host rule fits; of several that fit the longest name decides. No pattern either: allow.

Defined results: a null URL, or one without ``://``, has empty host and path, fits no
host rule and is allowed unless a pattern fits; repeated rows are judged alike; an empty
table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """``name`` is what the result shows. ``regex`` runs against ``host + path`` (host
    rules) or the lower-cased URL (patterns). ``tokens``: literals every match contains."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...] = field(default=())
    kind: str = "host"


def tokens_of(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(t for t in re.split(r"[^a-z0-9]+", text.lower()) if t))


def host_rule(verdict: str, rule: str) -> Rule:
    """From ``host/path``. Tokens cut short by the end of the path are not literal tokens
    of the URL (``/en`` also starts ``/english``), so an unfinished last one is left out."""
    host, slash, rest = rule.partition("/")
    path = slash + rest
    whole = path if not path or not re.search(r"[A-Za-z0-9]$", path) else re.sub(r"[A-Za-z0-9]+$", "", path)
    # the host has no slash, so host + path splits again at its first one
    return Rule(rule, verdict, rf"(?s)^(?:[^/]*\.)?{re.escape(host)}(?![^/]){re.escape(path)}", tokens_of(host) + tokens_of(whole))


def pattern_rule(verdict: str, name: str, regex: str, tokens: tuple[str, ...]) -> Rule:
    return Rule(name, verdict, regex, tokens, "pattern")


#: The host rules of the contract.
HOST_RULES = (host_rule("block", "net/"), host_rule("allow", "example.net/en/"), host_rule("block", "example.com/de/"), host_rule("allow", "org/fr/"))
#: Words of pages that carry no prose, by what they are; each gives the rules of ``FORMS``.
WORDS = {
    "adult": ("camgirl", "escorts", "hardcore", "milf", "nsfw", "porn", "porno", "sexcam", "xxx"),
    "advertising": ("adserver", "adservice", "adsystem", "clickbank", "doubleclick", "popunder", "taboola"),
    "gambling": ("bet365", "betting", "bingo", "blackjack", "casino", "jackpot", "poker", "roulette", "sportsbook"),
    "machinery": ("cgi-bin", "phpmyadmin", "wp-admin", "wp-login", "xmlrpc"),
    "pharmacy": ("cialis", "levitra", "tramadol", "viagra", "xanax"),
    "piracy": ("keygen", "torrent", "warez"),
}
#: Where a word may stand, each between separators.
FORMS = {
    "word": r"(^|[^a-z0-9]){0}([^a-z0-9]|$)",
    "label": r"://([^/?#]*\.)?{0}\.",
    "segment": r"://[^/?#]*/([^?#]*/)?{0}(/|$|[?#.])",
    "parameter": r"[?&]([^#]*[&=])?{0}(=|&|$|#)",
}


def pattern_rules(words: dict[str, tuple[str, ...]] | None = None) -> tuple[Rule, ...]:
    """A blocking rule for each word and form."""
    listed = WORDS if words is None else words
    return tuple(pattern_rule("block", f"{kind} {form} {w}", "(?s)" + at.replace("{0}", re.escape(w)), tokens_of(w)) for kind, group in listed.items() for w in group for form, at in FORMS.items())


PATTERN_RULES = pattern_rules()


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL_PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct runs of a-z and 0-9, lower-cased."""
    return F.array_distinct(F.split(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), "[^a-z0-9]+"))


def rules_table(spark, rules: Iterable[Rule]) -> DataFrame:
    """rule_no, name, verdict, regex, kind, tokens."""
    return spark.createDataFrame([(i, r.name, r.verdict, r.regex, r.kind, list(r.tokens) or [""]) for i, r in enumerate(rules)], "rule_no long, name string, verdict string, regex string, kind string, tokens array<string>")


def rule_index(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """token, rule_no, name, verdict, regex, kind: each rule under the rarest of its tokens over all URLs' ``tokens``
    (url, n: how many there are, token); a rule without tokens is under the empty one, which every URL has."""
    named = rules.select("rule_no", F.explode("tokens").alias("token"))
    counts = tokens.join(named.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.sum("n").alias("urls"))
    rarest = named.join(counts, "token", "left").groupBy("rule_no").agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token")).alias("best"))
    return rules.join(rarest, "rule_no").select("best.token", "rule_no", "name", "verdict", "regex", "kind")


def candidates(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, rule_no, name, verdict, regex, kind: what each different URL's tokens fetch."""
    tokens = urls.where("url is not null").groupBy("url").agg(F.count("*").alias("n")).select("url", "n", F.explode(F.array_union(url_tokens(F.col("url")), F.array(F.lit("")))).alias("token"))
    return tokens.drop("n").join(rule_index(tokens, rules), "token").drop("token")


def judge_urls(pages: DataFrame, rules: Iterable[Rule] | DataFrame = HOST_RULES + PATTERN_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern (the pattern rule that decided, if one did)
    and n_candidates (rules whose expression ran). rules: ``Rule`` objects, or a ``rules_table``."""
    urls = pages.select("page_id", F.col("url").cast("string"))
    listed = rules if isinstance(rules, DataFrame) else rules_table(pages.sparkSession, rules)
    target, lowered = F.concat(host_of(F.col("url")), path_of(F.col("url"))), F.translate("url", UPPER, LOWER)
    fits = F.regexp(F.when(F.col("kind") == "host", target).otherwise(lowered), F.col("regex"))
    tried = candidates(urls, listed).withColumn("fits", fits)
    best = lambda kind: F.min(F.when(F.col("fits") & (F.col("kind") == kind), F.struct((-F.length("name")).alias("size"), "name", "verdict")))
    judged = tried.groupBy("url").agg(best("host").alias("hit"), best("pattern").alias("by_pattern"), F.count("*").cast("int").alias("n_candidates"))
    frame = urls.join(judged, "url", "left")
    return frame.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("hit.name").alias("rule"),
        F.coalesce("hit.verdict", "by_pattern.verdict", F.lit("allow")).alias("verdict"),
        F.when(F.col("hit").isNull(), F.col("by_pattern.name")).alias("pattern"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
    )


#: Every form of a word holds it between separators, so one expression says whether any rule of it fits.
ANY_WORD = "|".join(w for group in WORDS.values() for w in group)
ORACLE = rf"""
WITH u AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
         translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
k AS (
  SELECT u.*, (SELECT min({{'size': -len(rhost || rpath), 'name': rhost || rpath, 'verdict': verdict}}) FROM r
               WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS hit,
         regexp_extract(low, '(^|[^a-z0-9])({ANY_WORD})([^a-z0-9]|$)', 2) AS word
  FROM u)
SELECT page_id, host, path, hit.name AS rule,
       CASE WHEN hit IS NOT NULL THEN hit.verdict WHEN word <> '' THEN 'block' ELSE 'allow' END AS verdict
FROM k
"""


def op7_url_rules(spark, sf_dir):
    from touchline.llm.common import table

    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
