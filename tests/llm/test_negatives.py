import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgrid.llm import negatives as ng

SCHEMA = "vec_id long, embedding array<double>, label int, id string, vec int, w int, leaf long, rank double"


def plain(rows, every, positives=5, negatives=3, low=50, high=95):
    """The same by comparing each anchor with every row, in Python's integers."""
    best = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x * 256) for x in v):
            continue
        one = (label, [math.floor(256 * x) for x in v])
        best[i] = min(best.get(i, one), one)
    out = []
    for a, (label, v) in best.items():
        if a % every:
            continue
        s = sorted((-sum(x * y for x, y in zip(v, u, strict=False)), i, other == label) for i, (other, u) in best.items() if i != a)
        for p, pid, _ in [x for x in s if x[2]][:positives]:
            hard = [x for x in s if not x[2] and low * -p <= 100 * -x[0] <= high * -p][:negatives]
            out += [(a, pid, r, n, -p, -ns) for r, (ns, n, _) in enumerate(hard, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 0.5) for r in rows], SCHEMA)


@pytest.fixture
def small(monkeypatch):
    """Trees of several levels, leaves of several blocks, several blocks of anchors."""
    for name, n in (("ARITY", 4), ("LEAST", 8), ("CHUNK", 16), ("TOGETHER", 3), ("SAMPLE", 150)):
        monkeypatch.setattr(ng, name, n)


def clustered(rng, n, dim=6):
    centres = rng.normal(size=(8, dim)) * 2
    return [(i, (centres[i % 8] + rng.normal(size=dim) * 0.2).tolist(), int(rng.integers(4))) for i in range(n)]


def test_against_every_row(spark, small):
    rng = np.random.default_rng(1)
    rows = clustered(rng, 500) + [(1000 + i, [0.5, 0.25, -1.0, 0.0, 2.0, 1.0], i % 3) for i in range(150)]  # and a vector that many have
    got = ng.hard_negatives(table(spark, rows).repartition(3), F.col("id") % 10 == 0)
    assert [f"{n} {t}" for n, t in got.dtypes] == [x.replace("long", "bigint") for x in ng.RESULT.split(", ")]
    assert sorted(map(tuple, got.collect())) == plain(rows, 10)


def test_other_windows_and_counts(spark, small):
    rows = clustered(np.random.default_rng(2), 200)
    got = ng.hard_negatives(table(spark, rows), F.col("id") % 7 == 0, 2, 9, 10, 120)
    assert sorted(map(tuple, got.collect())) == plain(rows, 7, 2, 9, 10, 120)


def test_odd_and_empty_tables(spark, small):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [1.0, 0.25], 2), (3, [0.75], 2), (4, [], 1), (5, None, 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 2), (8, [1.0, None], 2), (9, [1.0, 0.2], None), (None, [1.0, 0.5], 1),
        (10, [0.9, 0.4], 1), (10, [0.9, 0.4], 1), (10, [0.8, 0.4], 1), (10, [0.8, 0.4], 0), (11, [-1.0, -1.0], 2), (12, [0.0, 0.0], 3), (14, [1.0, 0.25], 3), (None, None, None),
    ]
    assert sorted(map(tuple, ng.hard_negatives(table(spark, rows), F.col("id") % 2 == 0).collect())) == plain(rows, 2)
    for some in ([], rows[5:9], rows[:1], rows[:2]):
        assert ng.hard_negatives(table(spark, some), F.col("id") % 2 == 0).collect() == []
    wide = [(i, [float(1 << 40) * (1 + i % 3), 3.0 + i], i % 2) for i in range(12)] + [(99, [0.1, 0.1], 0)]
    with pytest.raises(Exception, match=r"OverflowError|too large"):
        ng.hard_negatives(table(spark, wide), F.col("id") % 2 == 0).collect()


def test_products():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(-(1 << 30), 1 << 30, (5, 4)).astype(float) for _ in range(2))
    assert ng.products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in b] for u in a]


def test_best():
    rng = np.random.default_rng(4)
    for scale in (1, 1 << 61):
        s = rng.integers(-3, 3, (20, 30)) * scale
        may = rng.random((20, 30)) < 0.3
        for k in (1, 3, 40):
            got = sorted(zip(*map(list, ng.best(s, may, k)), strict=True))
            assert got == sorted((i, j) for i in range(20) for j in sorted(np.flatnonzero(may[i]), key=lambda j, i=i: (-s[i, j], j))[:k])


def test_no_leaf_with_a_row_of_the_window_is_left_out(small):
    """And on clustered rows most leaves are."""
    rng = np.random.default_rng(5)
    v = np.floor(256 * np.array([r[1] for r in clustered(rng, 600)]))
    space = ng.Space(v.shape[1], "<i4", float((v * v).sum(axis=1).max()))
    tree = ng.grow(space.lifted(v[:200]))
    leaf, seen = ng.descend(tree, space.lifted(v))
    ranges = [np.stack([np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf)]) for p in tree.points]
    for node, _, d, near in seen:
        for j in np.unique(near):
            ranges[node][:, :, j] = d[near == j].min(axis=0), d[near == j].max(axis=0)
    a = v[::7]
    s = a @ v.T
    lo, hi = np.quantile(s, 0.95, axis=1).astype(int), np.quantile(s, 0.99, axis=1).astype(int)
    near = (a * a).sum(axis=1) + space.square
    root = lambda x: np.sqrt(np.maximum(near - 2.0 * x, 0))
    may = ng.surviving(tree, ranges, np.hstack([a, np.zeros((len(a), 1))]), root(hi), root(lo), ng.SLACK * (np.sqrt(space.square) + np.sqrt(near.max()) + 1))
    for i in range(len(a)):
        assert may[i, leaf[(s[i] >= lo[i]) & (s[i] <= hi[i])]].all()
    assert may.mean() < 0.6


def test_registered_query(spark):
    from inkgrid.llm.queries import op13_negatives

    d = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op13_negatives(spark, d).collect())) == plain(rows, 50)
