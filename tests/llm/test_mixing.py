import hashlib
import re
from collections import defaultdict

import pytest

from inkgrid.llm import mixing


def water(sizes, weights, most=3.0):
    """Brute force: share by weight, cap, share the rest again."""
    total, full = sum(sizes.values()), {}
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    while True:
        free = [s for s in order if s not in full]
        rest = total - sum(full.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return full | share
        full |= {s: most * sizes[s] for s in over}


def plain(rows, weights=(1, 2, 3), most=3.0, seed=7):
    """rows: (id, source, size), ids all different and none null. Copies by id: whole copies, then documents in the order of their ranks, one after the other."""
    sizes = defaultdict(int)
    for _, source, size in rows:
        sizes[source] += size
    target, out = water(dict(sizes), weights, most), {}
    for source, total in sizes.items():
        ratio = target[source] / total if total else 0.0
        if ratio > most - 1e-9:
            ratio = most
        sure, p = int(ratio), ratio - int(ratio)
        out |= {i: sure for i, s, _ in rows if s == source}
        if p <= 0:
            continue
        u = lambda i: (int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        odds = lambda i: (u(i) / (1 - u(i))) / (p / (1 - p))
        rest, left = sorted((odds(i), str(i), i, size) for i, s, size in rows if s == source and size), target[source] - sure * total
        for _ in range(3):
            gap, later, full = left, [], False
            for x in rest:
                full = full or (x[3] <= gap and x[3] > left)
                if x[3] > gap or full:
                    later.append(x)
                else:
                    out[x[2]] += 1
                    left -= x[3]
            rest = later
        if rest:
            last = min(rest, key=lambda x: (x[3], x[0], x[1]))
            if last[3] < 2 * left:
                out[last[2]] += 1
    return out


def test_against_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in docs.collect()]
    assert {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()} == plain(rows)


def test_a_hot_source(spark):
    """One source has two thirds of all rows: more rows than one run, and near its target all the same."""
    rows = spark.range(30_000).selectExpr("id AS doc_id", "repeat('w ', int(1 + id * 7 % 40)) AS text", "if(id % 3 = 0, concat('s', id % 9), 'hot') AS source")
    out = mixing.mix(rows).collect()
    taken, target = defaultdict(int), {}
    for r in out:
        taken[r["source_size"], r["target"]] += r["taken"]
    assert len(out) == 30_000 and all(abs(v - k[1]) <= 40 for k, v in taken.items())


def test_targets_and_sizes(spark, odd):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count()
    sizes, targets, source = defaultdict(int), {}, {}
    for r in odd.collect():
        source[r["doc_id"]] = r["source"]
        sizes[r["source"]] += len((r["text"] or "").split())
    for r in got:
        targets[source[r["doc_id"]]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    assert targets == pytest.approx(water(dict(sizes), (1, 2, 3)))
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))


def test_near_targets_and_the_same_again(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    b = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(3)).collect()}
    assert {k: v["taken"] for k, v in a.items()} == b
    taken, target = defaultdict(int), {}
    for r in a.values():
        k = (r["source_size"], r["target"])
        taken[k] += r["taken"]
        target[k] = r["target"]
    assert all(abs(taken[k] / target[k] - 1) < 0.03 for k in taken)


def test_empty_table(spark, none):
    assert mixing.mix(none).count() == 0


def test_mixed_rows(spark, odd):
    copies = {(r["doc_id"]): r["copies"] for r in mixing.mix(odd).collect()}
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    n = defaultdict(int)
    for r in out.collect():
        n[r["doc_id"]] += 1
    assert all(n[k] == copies[k] for k in copies if k not in (2, None))


def test_null_ids_are_drawn_each_on_its_own(spark):
    """A third of a source's rows have a null id, some of them are equal, and an id stands twice."""
    words = lambda i: "w " * (20 + i * 7 % 60) + f"t{i % 290}"
    rows = [(None if i % 3 == 0 else i, words(i % 290), "ab"[i % 2]) for i in range(600)] + [(1, words(900), "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    for size in {r["source_size"] for r in out}:
        own = [r for r in out if r["source_size"] == size]
        assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], abs=15)
        null = [r["copies"] for r in own if r["doc_id"] is None]
        assert len(set(null)) == 2
    n = defaultdict(int)
    for r in mixing.mixed(docs).collect():
        n[r["source"]] += len(r["text"].split())
    taken = defaultdict(int)
    for r in out:
        taken[r["source_size"]] += r["taken"]
    assert sorted(n.values()) == sorted(taken.values())
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
