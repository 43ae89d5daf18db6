import random

import pyarrow as pa
import pytest

import corpus_pipeline
from inkgrid.llm import similarity as op


def words(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    a, b = words(a), words(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def groups(docs):
    """Brute force over all pairs."""
    at = {i: i for i in docs}
    for i in docs:
        for j in docs:
            if i < j and at[i] != at[j] and similarity(docs[i], docs[j]) >= 0.8:
                low, high = sorted((at[i], at[j]))
                at = {k: low if v == high else v for k, v in at.items()}
    return at


def planted():
    """40 texts with near copies at 0.8 to 0.95, and pairs that mostly repeat one line."""
    rng, docs = random.Random(5), {}
    for i in range(40):
        text = [f"w{rng.randrange(5000)}" for _ in range(300)]
        docs[i * 10] = " ".join(text)
        for k, edits in enumerate((2, 4, 6, 12), 1):
            copy = list(text)
            for at in rng.sample(range(5, 295), edits):
                copy[at] = f"edit{rng.randrange(10**6)}"
            docs[i * 10 + k] = " ".join(copy)
        own = " ".join(f"own{i}x{k}" for k in range(60))
        docs[i * 10 + 5] = "the same line stands here again and again " * 40 + own
    docs |= {1000: "", 1001: None, 1002: "one", 1003: "one", 1004: "two words"}
    return docs


def test_planted_near_copies_in_the_stage(spark):
    docs = planted()
    near = [(i, j) for i in docs for j in docs if i < j < 1000 and i // 10 == j // 10 and 0.8 <= similarity(docs[i], docs[j]) <= 0.95]
    assert len(near) > 80
    want = groups(docs)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in op.similar_groups(df).collect()} == want
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == sorted(set(want.values()))


def test_given_documents_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["component_id"] for r in op.similar_groups(df).collect()}
    assert got == groups({r["doc_id"]: r["text"] for r in df.collect()})


def test_odd_documents(spark, odd, none):
    assert op.similar_groups(odd).count() == odd.count()
    assert op.similar_groups(none).count() == 0


@pytest.mark.parametrize("batch", [1, 7, 100])
def test_large_buckets_are_passed_on(monkeypatch, batch):
    """Rows of buckets with more rows than the limit come out all, in whatever batches they arrive; of others those with a partner."""
    monkeypatch.setattr(op, "BUCKET", 20)
    rng, rows = random.Random(batch), []
    for bucket, k in enumerate((1, 60, 2, 25, 3, 20, 1, 90)):
        base = rng.getrandbits(62)
        rows += [(bucket, i, 10, base ^ (0 if i % 3 else rng.getrandbits(62)), base, True, 0) for i in range(k)]
    names = ["bucket", "node", "n", "s0", "s1", "probe", "word"]
    table = pa.table({c: [r[i] for r in rows] for i, c in enumerate(names)}, schema=pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32()), strict=True))))
    out = [r for b in op._met(8, 0.8)(table.to_batches(max_chunksize=batch)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    near = lambda a, b: bin(a[3] ^ b[3]).count("1") + bin(a[4] ^ b[4]).count("1") <= 8
    want = [r for r in rows if sum(x[0] == r[0] for x in rows) > 20 or any(x is not r and x[0] == r[0] and near(x, r) for x in rows)]
    assert sorted(out) == sorted(r[:5] + r[6:] for r in want)
