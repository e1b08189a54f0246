from tallyspark.llm import url_filter

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("example.com", "/de/ok", "allow"), ("b.example.com", "/de", "allow"), ("dup.org", "/", "allow"), ("dup.org", "/", "block"), (None, "/", "block"), ("x.org", None, "block")]
URLS = [None, "", "nothing", "http://", "http://a.NET", "http://a.net/", "HTTP://Sub.Example.NET/en/x?q#f", "https://example.net/e", "http://example.com/de/", "http://example.com/de/okay/y", "http://a.b.example.com/de/zz", "http://notexample.com/de/", "ftp://dup.org/a/b/c", "http://x.org?y", "http://x.org/any", "http://a.b.c.d.e.f.g/1/2/3", "a://b://c.net/z", "http://" + "l." * 500 + "net/" + "p/" * 500, "http://a.net/\nx"]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    best = None
    for h, p, action in RULES:
        p = p or ""
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (), (len(h + p), len(h), h + p, action))
    return host, path, best and best[2], best[3] if best else "allow"


def test_like_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "clash", "x") for i, u in enumerate(URLS)] + [(0, None, "clash", "x"), (None, URLS[6], "clash", "x")], "page_id bigint, url string, host string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    got = sorted(map(tuple, url_filter.judge_urls(pages, rules).collect()), key=str)
    assert got == sorted([(i, *brute(u)) for i, u in [*enumerate(URLS), (0, None), (None, URLS[6])]], key=str)


def test_empty_tables(spark):
    rules = spark.createDataFrame([], "host string, path string, action string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    assert url_filter.judge_urls(pages, rules).collect()[0]["verdict"] == "allow"
    assert url_filter.judge_urls(pages.limit(0), url_filter.rule_table(spark)).count() == 0


def test_shuffled_rules_give_the_same(spark, monkeypatch):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    one = sorted(map(tuple, url_filter.judge_urls(pages, rules).collect()), key=str)
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    assert one == sorted(map(tuple, url_filter.judge_urls(pages, rules).collect()), key=str)
