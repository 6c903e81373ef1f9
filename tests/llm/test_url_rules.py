import re

from touchline.llm import url_rules as m

SCHEMA = "page_id long, url string, host string"
URLS = [
    "http://net/", "http://net", "http://NET/a", "http://a.net/b?x#y", "http://planet/", "http://example.net/en/x", "http://w.example.net/en", "http://w.example.net/en/", "https://example.com/de/1", "https://EXAMPLE.com/de",
    "http://x.org/fr/2", "http://org/fr/", "http://x.org/en/", "ftp://a.b.net:80/x", "net/", "", None, "://net/x", "http://a.net?q=/", "http://a://b.net/", "http://a.example.com/de/casino", "http://b.example.com/en/casino-1", "http://b.com/Casino", "http://b.com/casinos",
    "http://x.net/" + "y" * 50_000, "http://é.net/é",
]
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def by_hand(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = re.search(r"[/?#]", rest)
        host = rest[: cut.start()] if cut else rest
        tail = rest[cut.start() :] if cut else ""
        path = re.split(r"[?#]", tail)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    bad = re.search(r"(^|[^a-z0-9])(casino|doubleclick|porn|viagra|xmlrpc)([^a-z0-9]|$)", (url or "").lower())
    return host, path, None, "block" if bad else "allow"


def test_against_rules_by_hand(spark):
    rows = [(i, u, "x") for i, u in enumerate([*URLS, URLS[3]])]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in m.judge_urls(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] for i, *_ in rows] == [by_hand(u) for _, u, _ in rows]


def test_only_candidates_run_and_rarest_token_indexes(spark):
    rules = (m.host_rule("block", "common.rare.net/"), m.host_rule("allow", "common.net/"))
    tokens = spark.createDataFrame([("u", 50, "common"), ("v", 1, "rare"), ("u", 60, "net"), ("w", 39, "net")], "url string, n long, token string")
    index = {r["name"]: r["token"] for r in m.rule_index(tokens, m.rules_table(spark, rules)).collect()}
    assert index == {"common.rare.net/": "rare", "common.net/": "common"}
    docs = spark.createDataFrame([(1, "http://a.com/x", ""), (2, "http://common.net/x", "")], SCHEMA)
    assert {r["page_id"]: r["n_candidates"] for r in m.judge_urls(docs, rules).collect()} == {1: 0, 2: 1}


def test_partial_path_tokens_do_not_index():
    rule = m.host_rule("block", "a.net/en")
    assert "en" not in rule.tokens
    assert re.match(rule.regex, "x.a.net/english") and not re.match(rule.regex, "xa.net/en")
    assert not re.match(m.host_rule("block", "net").regex, "network/x")


def test_empty_table_and_no_rules(spark):
    assert m.judge_urls(spark.createDataFrame([], SCHEMA)).count() == 0
    assert m.judge_urls(spark.createDataFrame([(None, "http://net/", "")], SCHEMA), ()).first()["verdict"] == "allow"


def test_candidates_stay_few_with_many_rules(spark):
    few, many = (tuple(m.host_rule("block", f"site{i}.example{i % 7}.com/") for i in range(n)) for n in (10, 20_000))
    urls = spark.createDataFrame([(i, f"http://www.site{i}.example{i % 7}.com/page", "") for i in range(0, 200, 20)] + [(7, "http://www.site3.example4.com/", "")], SCHEMA)
    for rules in (few, many):
        got = {r["page_id"]: (r["rule"], r["n_candidates"]) for r in m.judge_urls(urls, rules).collect()}
        assert max(n for _, n in got.values()) <= 2  # tokens of equally few URLs
        assert all(name == (f"site{i}.example{i % 7}.com/" if i < len(rules) and i != 7 else None) for i, (name, _) in got.items())


def test_ties_repeats_and_forms(spark):
    rules = (m.host_rule("allow", "b.net/x"), m.host_rule("block", "b.net/"), m.pattern_rule("allow", "z two", "q", ()), m.pattern_rule("block", "a two", "q", ()))
    docs = spark.createDataFrame([(1, "http://a.b.net/x/q", ""), (1, "http://a.b.net/x/q", ""), (2, "http://c.org/q", ""), (3, None, ""), (4, "http://c.org/" + "y" * 300_000 + "/q", "")], SCHEMA)
    got = sorted((r["page_id"], r["rule"], r["verdict"], r["pattern"]) for r in m.judge_urls(docs, rules).where("page_id <> 3").collect())
    assert got == [(1, "b.net/x", "allow", None), (1, "b.net/x", "allow", None), (2, None, "block", "a two"), (4, None, "block", "a two")]
    urls = {"http://x.casino.com/": "label", "http://x.com/a/casino/b": "segment", "http://x.com/?q=casino&b": "parameter", "http://x.com/my-casino-2": "word", "http://x.com/casinos": None}
    rows = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], SCHEMA)
    shown = {r["page_id"]: r["pattern"] for r in m.judge_urls(rows, m.PATTERN_RULES).collect()}
    assert [shown[i] and shown[i].split()[1] for i in range(len(urls))] == list(urls.values())
    assert all(re.search(m.FORMS["word"].replace("{0}", "casino"), u) for u, form in urls.items() if form)
