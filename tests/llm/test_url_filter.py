from chatlens.llm import url_filter
from chatlens.llm.common import local_table
from chatlens.llm.queries import URL_RULES


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fit = [(len(h + p), len(h), a, h + p) for h, p, a in rules
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, "allow", None))
    return host, path, best[3], best[2]


URLS = [None, "", "no scheme", "http://", "http://COM/", "http://com", "https://a.example.com/en/x?y#z",
        "https://example.com/en/", "https://www.example.com/en/1", "https://x.www.example.com/en/1",
        "https://notexample.com/en/", "http://x.net/es", "http://x.net/es/", "http://x.net?q=/es/",
        "http://x.net/fr/a/b/c/d/e", "http://é.NET/fr/", "http://a.b.c.d.e.f.net/es/x", "a://b://net/es/",
        "http://net#/es/", "http://x.net:80/es/", "http://.net/es/", "http://x.net/es/" + "a/" * 5000,
        "http://" + "a." * 2000 + "net/fr/", "http://x.net//es/"]


def check(spark, rules, urls):
    pages = spark.createDataFrame([(k // 2, u, "h", "c") for k, u in enumerate(urls + urls)],
                                  "page_id long, url string, rule string, copies string")
    got = url_filter.judge(pages, local_table(spark, rules, "host string,path string,action string")).collect()
    want = [(k // 2, *brute(u, rules)) for k, u in enumerate(urls + urls)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_against_brute_force(spark):
    check(spark, list(URL_RULES), URLS)


def test_paths_that_end_inside_a_name_and_ties(spark):
    check(spark, [("net", "/e", "block"), ("net", "", "allow"), ("x.net", "/es/a", "block"),
                  ("x.net", "/es/a", "allow"), ("com", "", "block")], URLS)


def test_no_rules_and_no_pages(spark):
    check(spark, [], URLS[:8])
    check(spark, list(URL_RULES), [])


def test_null_rules_fit_nothing(spark):
    rules = spark.createDataFrame([(None, "/", "block"), ("", "/", "block"), ("net", None, "block")],
                                  "host string, path string, action string")
    pages = spark.createDataFrame([(None, "http://x.net/"), (None, None)], "page_id long, url string")
    got = {r.host: r.verdict for r in url_filter.judge(pages, rules).collect()}
    assert got == {"x.net": "block", "": "allow"}


def test_native(spark):
    pages = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    rules = local_table(spark, list(URL_RULES), "host string,path string,action string")
    plan = url_filter.judge(pages, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
