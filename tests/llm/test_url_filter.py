import re

from sievelake.llm import queries, url_filter

RULES = "host string, path string, verdict string"


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, default, None))
    return host, path, best[2], best[1]


URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "http://WWW.Example.COM/en/x?q=/en/", "https://a.b.example.com/en/1#t", "http://example.com/en", "http://xexample.com/en/",
    "ftp://x.net/es/a://b", "http://x.net?/es/", "http://x.net#/fr/", "http://net/fr/", "http://x.net/fr/" + "y" * 5000, "http://org/", "http://.com/", "http://a..com/x", "http://ü.com/ä\n?b",
]


def test_contract_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(0, URLS[6]), (None, URLS[6])], "page_id bigint, url string")
    out = url_filter.judge_urls(df, spark.createDataFrame(queries.RULES, RULES)).collect()
    assert len(out) == len(URLS) + 2
    for r in out:
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url, queries.RULES), r.url


def test_general_rules_ties_and_clashes(spark):
    rules = [("a.com", "/x", "allow"), ("a.com", "/x", "block"), ("b.a.com", "/", "allow"), ("a.com", "/xyz/q", "allow"), (None, "/", "block"), ("c.com", None, "block")]
    urls = ["http://b.a.com/xyz", "http://a.com/xyz/qq", "http://a.com/", "http://c.com/"]
    df = spark.createDataFrame([(u, "old", 1) for u in urls], "url string, verdict string, rule int")
    out = url_filter.judge_urls(df, spark.createDataFrame(rules, RULES)).collect()
    good = [r for r in rules if None not in r]
    for r in out:
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url, good), r.url
    none = url_filter.judge_urls(df, spark.createDataFrame([], RULES)).collect()
    assert {(r.rule, r.verdict) for r in none} == {(None, "allow")} and len(none) == 4
    assert url_filter.judge_urls(df.limit(0), spark.createDataFrame(rules, RULES)).collect() == []
