import base64
import hashlib

from inkgrid.llm import warc


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


PAGES = [
    (5, "http://www.example.org/a?b=1", "<p>same</p>"), (3, "http://example.org/z", "<p>same</p>"), (9, None, "<p>same</p>"), (4, "http://b.com/\r\nX-Bad: 1", "ünï"), (6, "no scheme", None), (7, "http://b.com/", ""),
    (8, "http://b.com/", "x" * 300_000), (8, "http://b.com/", "x" * 300_000), (None, "http://c.com", "<p>same</p>"),
]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*p, "k", 1) for p in PAGES], "page_id long, url string, html string, key string, offset int")
    path = warc.write_archives(pages)
    got = warc.read_archives(spark, path).collect()
    want = []
    for page, _, html in PAGES:
        same = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        first = min(same) if page is not None else None
        revisit = page is not None and page > first
        want.append((page, len((html or "").encode()), digest(html), "revisit" if revisit else "response", first if revisit else None))
    order = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_least_bytes_and_empty(spark):
    pages = spark.createDataFrame([p for p in PAGES if p[0] is not None], "page_id long, url string, html string")
    got = warc.read_archives(spark, warc.write_archives(pages, least_bytes=1000)).collect()
    assert {r["record_type"] for r in got} == {"response"}
    assert warc.read_archives(spark, warc.write_archives(pages.where("page_id < 0"))).count() == 0


def test_lookup_over_blocks(spark, monkeypatch):
    pages = spark.range(300).selectExpr("id AS page_id", "concat('http://h', id % 37, '.example.com/p', id % 5) AS url", "concat('body', id % 90) AS html")
    path = warc.write_archives(pages)
    urls = spark.createDataFrame([("http://h3.example.com/p2",), ("http://nowhere.net/",), ("http://h36.example.com/p4",)], "url string")
    for block in (3000, 2):
        monkeypatch.setattr(warc, "BLOCK", block)
        got = {(r["url"], r["id"]) for r in warc.lookup(urls, path).collect()}
        want = {(u, i) for (u,) in (tuple(r) for r in urls.collect()) for i in range(300) if f"http://h{i % 37}.example.com/p{i % 5}" == u}
        assert got == want and want


def test_lookup_of_null_and_repeated_urls(spark, monkeypatch):
    """Payloads come with each capture, also those of revisits; null URLs find captures without one."""
    monkeypatch.setattr(warc, "GIVE_BYTES", 100)
    pages = [(i, "http://a.org/x" if i % 2 else None, f"body {i % 6}" * 20) for i in range(24)] + [(3, "http://a.org/x", "body 3" * 20), (30, "http://b.org/", "body 1" * 20)]
    path = warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"))
    urls = spark.createDataFrame([("http://a.org/x",), ("http://A.ORG/x",), (None,), ("http://b.org/",), ("http://none.org/",)], "url string")
    got = {}
    for r in warc.lookup(urls, path).collect():
        got.setdefault(r["url"], []).append((r["id"], None if r["payload"] is None else bytes(r["payload"]).decode()))
    want = lambda url: sorted((i, h) for i, u, h in pages if u == url)
    assert sorted(got["http://a.org/x"]) == sorted(got["http://A.ORG/x"]) == want("http://a.org/x") and sorted(got[None]) == want(None)
    assert got["http://b.org/"] == [(30, None)]  # its response stands under another URL
    assert got.keys() == {"http://a.org/x", "http://A.ORG/x", None, "http://b.org/"}
