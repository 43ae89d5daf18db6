import re

import numpy as np
import xxhash

from inkgrid.llm import simhash


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(fps, ids, distance=3):
    """Brute force: the smallest id reachable."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance
    label = ids.copy()
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label
        label = new


def test_fingerprints(spark, odd):
    for r in odd.select("doc_id", "text").collect():
        assert simhash.fingerprint(r["text"]) == plain(r["text"])
    assert simhash.fingerprint("A b\x1fc é") == plain("A b\x1fc é")


def test_odd_documents(spark, odd, none):
    got = {(r["doc_id"]): r for r in simhash.near_duplicates(odd).collect()}
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert got[2]["component_id"] == 1 and got[None]["component_id"] in (1, 4)
    assert got[4]["fingerprint"] == got[5]["fingerprint"] == got[6]["fingerprint"] == "0" * 16 and got[6]["component_id"] == 4
    assert got[12]["component_id"] == got[7]["component_id"] == 7
    assert simhash.near_duplicates(none).count() == 0


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = simhash.near_duplicates(docs).toPandas().sort_values("doc_id")
    fps = np.array([int(x, 16) for x in got["fingerprint"]], np.uint64)
    assert (closure(fps, got["doc_id"].to_numpy()) == got["component_id"].to_numpy()).all()


def test_dense_ball_is_split(spark):
    """Many fingerprints around one, with buckets far larger than the limit: all links are kept."""
    rng = np.random.default_rng(5)
    centre = int(rng.integers(1 << 62))
    fps = {centre}
    while len(fps) < 900:
        flips = rng.choice(64, rng.integers(1, 5), replace=False)
        fps.add(centre ^ sum(1 << int(b) for b in flips))
    fps |= {int(x) for x in rng.integers(1 << 62, size=300)}
    u = np.array(sorted(fps), np.uint64)
    s = u.view(np.int64)
    links = simhash.near_links(spark.createDataFrame([(int(x),) for x in s], "fp long"), bucket=60)
    got = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    label = closure(u, np.arange(len(u)))
    groups = {}
    for i, x in enumerate(s):
        groups.setdefault(label[i], []).append(int(x))
    for g in groups.values():
        assert len({got.get(x, x) for x in g}) == 1
    assert len({got.get(int(x), int(x)) for x in s}) == len(groups)


def test_links_that_differ_in_the_sign_bit(spark):
    """Pairs of random fingerprints that differ in the highest bit, alone and with two others."""
    rng = np.random.default_rng(8)
    u = rng.integers(1 << 63, size=200, dtype=np.uint64)
    pairs = [(int(x), int(x) ^ 1 << 63 ^ (0 if i % 2 else (1 << int(i % 60)) | 1 << int(i % 60 + 2))) for i, x in enumerate(u)]
    s = np.array([x for p in pairs for x in p], np.uint64).view(np.int64)
    got = {r["node"]: r["root"] for r in simhash.components(simhash.near_links(spark.createDataFrame([(int(x),) for x in s], "fp long"))).collect()}
    assert all(got[int(s[2 * i])] == got[int(s[2 * i + 1])] for i in range(len(pairs)))


def test_thresholds_cover_all_pairs():
    rng = np.random.default_rng(1)
    fps = rng.integers(-(1 << 62), 1 << 62, 500)
    parts = [list(range(i, 64, 4)) for i in range(4)]
    tables = [[np.full((1 << len(g), 4), 0.01) for g in simhash._groups(p)] for p in parts]
    tables[0][0][:, 0] = 0.9  # a costly partition
    e = simhash.thresholds(fps, parts, tables, 10_000, 3)
    assert ((e + 1).sum(axis=1) == 4).all() and e.min() >= -1


def test_deduplicate(spark, odd):
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and 1 in ids and 2 not in ids and 4 in ids and 5 not in ids
