import random

from graftline.llm import url_filter

PAGES = "page_id long, url string, html string, rule string, host string"


def brute(url, rules, default="allow"):
    url = url or ""
    head, sep, rest = url.partition("://")
    if not sep:
        host = path = ""
    else:
        cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        end = next((i for i, c in enumerate(rest[cut:]) if c in "?#"), len(rest) - cut)
        path = rest[cut : cut + end]
    fit = [(len(h) + 1 + len(p), len(h) + 1, v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, default, None))
    return host, path, best[3], best[2]


def check(spark, urls, rules, **bounds):
    pages = spark.createDataFrame([(i, u, "", "", "") for i, u in enumerate(urls)], PAGES)
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, table, **bounds).collect())
    assert got == [(i, *brute(u, rules)) for i, u in enumerate(urls)]


def test_production_rules(spark):
    urls = [None, "", "no scheme", "HTTP://A.ORG", "http://org/", "http://x.org?y/", "http://EXAMPLE.org/es/1", "https://m.example.org/en/12#t", "http://example.org/en/2", "http://notexample.org/es/", "https://shop.com/fr/1", "https://com/de/", "x://a.com/De/", "a://b.net/fr/", "a://É.org/x://y.com/de/", "a://q.com/de/" + "z" * 50000, "a\nb://q.com/de/", "://org/"]
    check(spark, urls * 2, url_filter.RULES)


def test_nested_rules(spark):
    rng = random.Random(2)
    labels = ["a", "b", "ab", "abcdefgh", "abcdefghij", "com", "x-y"]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(n))
    rules = sorted({(h, p): (v, h, p) for v, h, p in ((rng.choice(["allow", "block"]), host(rng.randrange(1, 5)), rng.choice(["", "/", "/a", "/a/b"])) for _ in range(60))}.values())
    urls = [f"http://{host(rng.randrange(1, 6))}{rng.choice(['', '/', '/a/b/c', '/b', '?a'])}" for _ in range(400)]
    check(spark, urls, rules)
    check(spark, urls, rules, range_hosts=3)


def test_hosts_of_one_domain_are_swept_in_lanes(spark):
    urls = [f"http://n{i}.{'x.' * (i % 3)}blog.example.com/{'fr' if i % 2 else 'de'}/{i}" for i in range(300)]
    check(spark, urls, [*url_filter.RULES, ("block", "blog.example.com", ""), ("allow", "x.blog.example.com", "/de/")], range_hosts=10)


def test_null_parts_and_equal_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "", "", ""), (2, "no url", "", "", "")], PAGES)
    rules = spark.createDataFrame([("allow", "a.org", "/"), ("block", "a.org", "/"), ("block", None, None), ("allow", "a.org", None)], "verdict string, host string, path string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    assert got[1] == ("a.org/", "block") and got[2] == ("", "block")
    same = spark.createDataFrame([("allow", "a.org", "/"), ("block", "A.org", "/")], "verdict string, host string, path string")
    assert {r.page_id: r.verdict for r in url_filter.judge(pages, same).collect()} == {1: "block", 2: "allow"}


def test_no_rows_and_no_rules(spark):
    check(spark, [], url_filter.RULES)
    check(spark, ["http://a.org/"], [])
