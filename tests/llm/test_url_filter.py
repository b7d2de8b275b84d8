import re

from charta.llm import url_filter as U

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "b.org", "/x"), ("allow", "org", "/x/yz"), ("block", "c.org", "/"), ("allow", "c.org", "/"), ("block", None, "/")]


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in RULES if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


URLS = [None, "", "no scheme", "http://EXAMPLE.com", "http://example.com/en/1?x", "https://www.Example.com/en/", "http://a.www.example.com/en/2#t", "http://notexample.com/en/", "ftp://x.net/es/9", "http://net/es/", "http://x.net/es", "http://a.b.org/x/yz", "http://c.org/", "http://..com/", "x://é.com/ü?://net/es/", "http://com", "://com/", "http://example.com:80/en/"]


def test_equals_brute_force(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[3]), (4, "http://x.com/" + "a/" * 3000)]
    pages = spark.createDataFrame([(i, u, "r", 1, "p") for i, u in rows], "page_id long, url string, rule string, row int, prefix string")
    got = U.judged(pages, U.rule_table(spark, RULES)).collect()
    assert sorted(str((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"])) for r in got) == sorted(str((i, *brute(u))) for i, u in rows)


def test_long_rule_lists_join_alike(spark, monkeypatch):
    monkeypatch.setattr(U, "BROADCAST_RULES", 0)
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = U.judged(pages, U.rule_table(spark, RULES)).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == {i: brute(u) for i, u in enumerate(URLS)}


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], "verdict string, rule_host string, rule_path string")
    assert [(r["rule"], r["verdict"]) for r in U.judged(pages, none, "block").collect()] == [(None, "block")]
    assert U.judged(pages.limit(0), U.rule_table(spark, RULES)).collect() == []


def test_hosts_of_very_many_labels(spark):
    long = "http://" + "a." * 100_000 + "example.com/en/x"
    pages = spark.createDataFrame([(1, long), (2, "http://" + "b" * 200_000 + ".net/es/")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in U.judged(pages, U.rule_table(spark, RULES)).collect()}
    assert got == {1: ("example.com/en/", "block"), 2: ("net/es/", "block")}
