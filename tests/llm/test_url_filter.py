import random
from collections import Counter

import pytest

from lakewright.llm.queries import URL_RULES
from lakewright.llm.url_filter import filter_urls

PAGES, RULES = "page_id long, url string, rule string", "host string, path string, verdict string"


def split(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = ""
    for c in rest:
        if c in "/?#":
            break
        host += c
    path = rest[len(host) :]
    for mark in "?#":
        path = path.split(mark)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute(url, rules):
    host, path = split(url)
    fits = [(len(h) + len(p or ""), len(h), v == "block", h + (p or ""), v) for h, p, v in rules if h and v in ("allow", "block") and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


def check(spark, urls, rules):
    rows = [(i % 7 or None, u, "old") for i, u in enumerate(urls)]
    out = filter_urls(spark.createDataFrame(rows, PAGES), spark.createDataFrame(rules, RULES)).collect()
    got = Counter((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in out)
    assert got == Counter((i, u, *brute(u, rules)) for i, u, _ in rows)


def test_stated_rules(spark):
    urls = ["http://a.com/en/1", "https://x.example.com/en/7", "https://example.com/en/78?q#f", "http://EXAMPLE.net/de/8", "http://net/de/9", "http://m.org/es/", "http://m.org/es", "http://morg/es/1", "http://badexample.com/en/7", "ftp://a.com/EN/1", "http://É.COM/en/é"]
    check(spark, urls, URL_RULES)


def test_edges(spark):
    urls = [None, "", "no scheme", "://", "http://", "http://?x", "http://#", "http:///p", "a://b://c/d", "http://com", "http://com/en/" + "x" * 5000, "http://" + ".".join("a" * 600) + ".com/en/", "http://u:p@h.com:80/en/1", "http://a..com/en/", "http://.com/en/", "x\nhttp://a.com/en/\n1"] * 2
    check(spark, urls, [*URL_RULES, ("com", None, "allow"), (None, "/", "block"), ("", "/", "block"), ("net", "/", "other"), ("COM".lower(), "/en/", "block")])
    check(spark, urls, [])
    assert filter_urls(spark.createDataFrame([], PAGES), spark.createDataFrame(URL_RULES, RULES)).count() == 0


def test_columns_of_other_names_stay(spark):
    rows = [(1, "http://a.com/en/", "r", "h", 3)]
    out = filter_urls(spark.createDataFrame(rows, "page_id long, url string, r string, full string, short int"), spark.createDataFrame(URL_RULES, RULES))
    assert out.columns == ["page_id", "url", "r", "full", "short", "host", "path", "rule", "verdict"] and out.first().r == "r"


@pytest.mark.parametrize("seed", [1])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    host = lambda: ".".join(r.choice(["a", "b", "com", "net", "www"]) for _ in range(r.randint(1, 4)))
    path = lambda: "".join(r.choice(["/", "a", "b", "/x/"]) for _ in range(r.randint(0, 5)))
    rules = [(host(), path(), r.choice(["allow", "block"])) for _ in range(40)]
    urls = [f"http://{host()}/{path()}{r.choice(['', '?q=/a', '#f'])}" for _ in range(300)]
    check(spark, urls, rules)


def test_many_shapes_of_rules(spark):
    r = random.Random(3)
    hosts = [".".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(60)]
    paths = ["/" + "".join(r.choice("xy/") for _ in range(r.randint(0, 60))) for _ in range(60)]
    rules = list({(r.choice(hosts), r.choice(paths)[: r.randint(0, 61)]): r.choice(["allow", "block"]) for _ in range(1500)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [f"http://{r.choice(['', 'a.', 'z.c.'])}{r.choice(hosts)}{r.choice(paths)}{r.choice(['', '?q', '#f'])}" for _ in range(300)] + ["http://" + "a." * 3000 + "b/x", "http:///x"]
    out = filter_urls(spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame(rules, "host string, path string, verdict string"))
    found = 0
    for x in out.collect():
        fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (x.host == h or x.host.endswith("." + h)) and x.path.startswith(p)]
        want = max(fits)[3:] if fits else (None, "allow")
        assert (x.rule, x.verdict) == want, x
        found += bool(fits)
    assert found > 100 and len({(h.count("."), len(p)) for h, p, _ in rules}) > 150
