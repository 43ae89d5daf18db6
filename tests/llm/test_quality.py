import math
import zlib

import numpy as np

from inkgrid.llm import quality, queries
from inkgrid.llm.langid import remainder


def test_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = [r["predicted"] == r["quality"] for r in got]
    assert np.mean(right) > 0.9 and len(right) > 40
    assert quality.classify(docs, labels).where(remainder("doc_id") == 0).where("not held_out").count() == 0


def test_odd_documents(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 0), (9, 0, 1), (11, 1, 0), (None, 1, 0), (10, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    half = quality.classify(odd, labels.where("doc_id > 99")).collect()
    assert {round(r["score"], 6) for r in half} == {0.5}
    assert quality.classify(none, labels).count() == 0


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(4)
    x = rng.random((4000, len(quality.FEATURES))).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y, rounds=20)
    assert (0, 1) in model.pairs
    assert np.mean((model.score(x) >= 0.5) == y) > 0.95


def plain_features(text):
    """The features one by one, in plain Python over bytes and words."""
    b = (text or "").encode("utf-8", "replace")
    words = b.split()
    if not words:
        return [0.0] * len(quality.FEATURES)
    of = lambda ok: sum(1 for c in b if ok(c))
    upper, lower, high = of(lambda c: 65 <= c <= 90), of(lambda c: 97 <= c <= 122), of(lambda c: c >= 128)
    plain = set(b",.;:'\"!?()-|")
    lines = [x for x in b.split(b"\n") if x.strip()]
    odd = lambda c: (33 <= c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 127) and c not in b".,"
    letters, share = max(upper + lower + high, 1), [b.count(bytes([c])) / len(b) for c in set(b)]
    return [
        math.log1p(len(words)), sum(map(len, words)) / len(words), upper / letters, of(lambda c: 48 <= c <= 57) / len(b),
        of(lambda c: 33 <= c < 127 and not (65 <= c <= 90 or 97 <= c <= 122 or 48 <= c <= 57 or c in plain)) / len(b), b.count(b"|") / len(words), b.count(b"!") / len(words),
        (b.count(b",") + b.count(b".")) / len(words), high / len(b), len(set(words)) / len(words), len(words) / len(lines), 1 - len(set(lines)) / len(lines),
        sum(x.rstrip()[-1:] in b".!?\"')" for x in lines) / len(lines), sum(65 <= w[0] <= 90 for w in words) / len(words), sum(odd(w[-1]) for w in words) / len(words),
        sum(len(w) <= 3 for w in words) / len(words), math.log1p(max(map(len, words))), -sum(s * math.log2(s) for s in share), sum(x == y for x, y in zip(words, words[1:], strict=False)) / len(words),
    ]


def plain_score(model, x):
    """One row, feature by feature: the bin is the number of edges at or below the value."""
    place = lambda edges, v: sum(1 for e in edges if e <= v)
    total = model.intercept + sum(t[place(model.edges[j], x[j])] for j, t in enumerate(model.tables))
    total += sum(t[place(model.coarse[i], x[i])][place(model.coarse[j], x[j])] for (i, j), t in model.pairs.items())
    return 1 / (1 + math.exp(-total))


def test_registered_query_against_a_plain_version(spark):
    """Whole query: features by loops, the fitted model's tables added up bin by bin, held-out rows and the threshold."""
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    table = {i: np.array(plain_features(t), np.float32) for i, t in texts.items()}
    for r in quality.feature_table(docs).collect():
        assert np.allclose([r[f] for f in quality.FEATURES], table[r["id"]], rtol=1e-5, atol=1e-6)
    crc = lambda i: zlib.crc32(str(i).encode()) % 5
    rows = sorted((r["doc_id"], r["quality"]) for r in labels.collect() if crc(r["doc_id"]) and r["quality"] is not None)
    own = {r["id"]: np.array([r[f] for f in quality.FEATURES], np.float32) for r in quality.feature_table(docs).collect()}
    order = sorted((i, *own[i].tolist(), y) for i, y in rows if i in own)
    model = quality.fit(np.array([x[1:-1] for x in order], np.float32), np.array([x[-1] for x in order], float))
    got = {r["doc_id"]: r for r in queries.op9_quality(spark, d).collect()}
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert r["held_out"] == (crc(i) == 0) and abs(r["score"] - plain_score(model, own[i])) < 1e-9 and r["predicted"] == (r["score"] >= 0.3)


def test_bound_on_rows_for_fitting(spark):
    """A label that repeats an id many times doesn't enlarge the sample."""
    docs = spark.createDataFrame([(1, "a b")] * 40 + [(i, f"x {i}") for i in range(2, 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 50 + [(i, i % 2) for i in range(2, 30)], "doc_id long, quality int")
    table = quality.feature_table(docs)
    assert quality.sample(table, labels, "doc_id", "quality", 20_000).count() == 29
