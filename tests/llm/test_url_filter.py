import random

from pedalgrid.llm import url_filter as U


def expected(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [
        (len(h + p), len(h), h + p, v)
        for h, p, v in rules
        if host and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else U.DEFAULT


def test_equals_brute_force(spark):
    rnd = random.Random(3)
    hosts = ["com", "a.com", "b.a.com", "aa.com", "org", "x.org", "y.x.org"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab", "/a/b/c", "/b"]
    rules = list({(rnd.choice(hosts), rnd.choice(paths)): rnd.choice(["allow", "block"]) for _ in range(30)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [
        f"http://{rnd.choice(['', 'W.', 'm.'])}{rnd.choice(hosts + ['net', 'zcom'])}{rnd.choice(paths)}{rnd.choice(['', 'x', '/b', '?q=/a', '#f'])}"
        for _ in range(600)
    ] + [None, "", "no scheme", "http://", "://a.com/a", "http://a.com://x/a", "http://..com/a", "http://É.com/a"]
    pages = spark.createDataFrame([(i, u, "clash", "c", "c") for i, u in enumerate(urls)], "page_id long, url string, rule string, key string, host string")
    pages = pages.unionByName(pages.limit(5))
    table = spark.createDataFrame(rules + [(None, "/", "block"), ("com", None, "block")], "host string, path string, verdict string")
    got = U.match(pages, table).collect()
    assert len(got) == len(urls) + 5
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == expected(r["url"], rules), r


def test_conflict_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    rules = spark.createDataFrame([("A.com", "/", "allow"), ("a.com", "/", "block")], "host string, path string, verdict string")
    assert U.match(pages, rules).first()["verdict"] == "block"
    assert U.match(pages, rules.limit(0)).first()["verdict"] == U.DEFAULT
    assert U.match(pages.limit(0), rules).count() == 0


def test_columns_with_inner_names(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x", "b", "s", "k", 7), (2, None, "b", "s", "k", 7)], "page_id long, url string, best string, stack string, verdict string, size int")
    rules = spark.createDataFrame([("a.com", "/", "block")], "host string, path string, verdict string")
    rows = {r["page_id"]: r for r in U.match(pages, rules).collect()}
    assert (rows[1]["best"], rows[1]["stack"], rows[1]["size"], rows[1]["verdict"]) == ("b", "s", 7, "block")
    assert (rows[2]["rule"], rows[2]["verdict"]) == (None, U.DEFAULT)
