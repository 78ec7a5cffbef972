import re

from rankweave.llm import urlfilter as U

SCHEMA = "page_id long, url string, host int, words string, n int"


def table(spark, urls):
    return spark.createDataFrame([(i, u, 1, "x", 2) for i, u in enumerate(urls)], SCHEMA)


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(-len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(min(fit)[1:] if fit else (None, None)))


URLS = ["http://Sub.EXAMPLE.com/en/1?x=/es/", "https://www.example.com/en/2#t", "https://a.www.example.com/en/", "http://x.com",
        "http://x.com/", "http://com/", "http://xcom/", "http://example.com/EN/", "ftp://a.net/es/9", "http://a.net/es", "http://net/fr/",
        "http://a.org/fr/1", "no scheme", "", None, "://", "a://b://c/d", "http://É.net/fr/é", "http://a.org?q=1", "http://a.org#f",
        "http://a.net:80/es/1", "http://a.net/en/\n/x?y"]


def test_rules_and_parts(spark):
    got = sorted(U.filter_urls(table(spark, URLS)).collect(), key=lambda r: r.page_id)
    assert len(got) == len(URLS)
    for r, url in zip(got, URLS):
        host, path, rule, verdict = brute_rule(url)
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_method_splits_and_learns(spark):
    good = [f"http://news{k}.site.org/en/{k}" for k in range(40)]
    bad = ["http://casino-win.site.org/en/1", "http://cheap-pills.site.org/en/2", "http://free-bets.site.org/de/3"] * 4
    new = ["http://cheappills.site.org/en/5", "http://wincasino.site.org/x", "http://newsroom.site.org/en/7", "http://www.site.org/"]
    got = sorted(U.filter_urls(table(spark, good + bad + new)).collect(), key=lambda r: r.page_id)
    assert {r.verdict for r in got[:40]} == {"allow"}
    assert {r.verdict for r in got[40:52]} == {"block"}
    assert [r.verdict for r in got[52:]] == ["block", "block", "allow", "allow"]
    assert got[52].words[:2] == ["cheap", "pills"] and got[53].words[:2] == ["win", "casino"]


def test_segmentation_is_the_best_one():
    counts = {"cheap": 10, "pills": 10, "pill": 4, "heap": 50, "s": 3, "ch": 2}
    assert U.split_label("cheappills", counts, 1000.0) == ["cheap", "pills"]
    assert U.split_label("zzzqqq", counts, 1000.0) == ["zzzqqq"]


def test_edges(spark):
    assert U.filter_urls(table(spark, [])).count() == 0
    only = U.filter_urls(table(spark, [None, None, "x"])).collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in only] == [("", "", None, "allow")] * 3
    long = "http://" + "ab" * 3000 + ".org/" + "x/" * 3000
    assert U.filter_urls(table(spark, [long, long])).count() == 2
