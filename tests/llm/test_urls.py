import random

from pyspark.sql import functions as F

from inkgrid.llm import urls


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[n:]
    m = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return "".join(c.lower() if c.isascii() else c for c in rest[:n]), path[:m]


def plain(url, rules):
    host, path = split(url)
    best = None
    for h, p, v in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0, 0, "", ""), (len(h + p), len(h), h + p, v))
    return (host, path, best[2], best[3]) if best else (host, path, None, "allow")


def test_random_rules_against_brute_force(spark):
    rng = random.Random(3)
    hosts = ["org", "example.org", "a.example.org", "com", "b.com", "x-y.com", "é.org", "com+x", "com-x"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab", "/é/", "/A"]
    rules = [(h, p, rng.choice(["allow", "block"])) for h in hosts for p in paths if rng.random() < 0.5]
    made = [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(['', 'www.', 'A.'])}{rng.choice([*hosts, 'Example.ORG', 'other.net', 'xorg'])}{rng.choice([*paths, '/a/b/c?q=1#f', '?x', '#y', '/abc'])}" for _ in range(600)]
    made += [None, "", "no scheme/a", "://", "http://", "a://b://c/d", "http://org/\U0010ffff", "http://org/a\U0010ffff"]
    pages = spark.createDataFrame([(i, u, "k", 1) for i, u in enumerate(made)] + [(0, made[0], "k", 1)], "page_id long, url string, key string, row int")
    got = urls.judge(pages, spark.createDataFrame(rules, urls.RULES)).collect()
    assert len(got) == len(made) + 1
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain(made[r["page_id"]], rules), made[r["page_id"]]


def test_no_rules_and_no_pages(spark):
    rules = spark.createDataFrame([], urls.RULES)
    pages = spark.createDataFrame([(1, "http://a.b/c"), (None, None)], "page_id long, url string")
    assert {r["verdict"] for r in urls.judge(pages, rules).collect()} == {"allow"}
    some = spark.createDataFrame([("b", "/", "block"), ("b", "/", "allow"), (None, "/", "block"), ("b", None, "allow")], urls.RULES)
    assert [r["verdict"] for r in urls.judge(pages.where("page_id = 1"), some).collect()] == ["block"]
    assert urls.judge(pages.where("page_id > 5"), some).count() == 0


def test_rows_that_come_from_a_shuffle_and_a_hot_host(spark):
    """Two thirds of the pages have one host, and the input is joined and dealt anew: each verdict stays with its page."""
    rng = random.Random(9)
    rules = [("hot.example.org", f"/p{i % 40}/" + "x" * (i % 3), rng.choice(["allow", "block"])) for i in range(80)] + [("org", "/", "block"), ("EXAMPLE.org", "/p1", "allow")]
    made = {i: f"http://{'hot.example.org' if i % 3 else f'h{i}.example.org'}/p{rng.randrange(50)}/{'x' * rng.randrange(4)}" for i in range(3000)}
    left = spark.createDataFrame(list(made.items()), "page_id long, url string")
    right = spark.createDataFrame([(i, f"v{i}") for i in made], "page_id long, verdict string")
    got = urls.judge(left.repartition(7).join(right, "page_id").orderBy(F.rand()), spark.createDataFrame(rules, urls.RULES)).collect()
    assert len(got) == len(made)
    low = [(h.lower(), p, v) for h, p, v in rules]
    low = [(h, p, max(x[2] for x in low if x[:2] == (h, p))) for h, p, _ in low]
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain(made[r["page_id"]], low), made[r["page_id"]]


def test_odd_urls(spark):
    made = ["http://org", "http://org./", "http://.org/", "http://a..org/", "http://org:80/", "http://u@example.org/", "http:///x", "http://EXAMPLE.ORG", "http://example.org\\x/"]
    rules = [("org", "", "block"), ("example.org", "/", "allow"), ("", "/x", "block")]
    got = urls.judge(spark.createDataFrame(list(enumerate(made)), "page_id long, url string"), spark.createDataFrame(rules, urls.RULES)).collect()
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain(made[r["page_id"]], rules[:2]), made[r["page_id"]]
