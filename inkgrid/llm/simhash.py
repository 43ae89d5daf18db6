"""Near duplicates by SimHash: fingerprints, links at a small Hamming distance, and their connected components.

Links are found by the generalised pigeonhole principle. The 64 bits are dealt to m partitions, bits that occur together in
the same one. If thresholds e_i of at least -1 have sum(e_i + 1) = distance + 1, then fingerprints within that distance differ
by at most e_i bits in at least one partition i. Each fingerprint gets its own thresholds, by dynamic programming on the
number of candidates that small histograms lead to expect, and then probes partition i with all values within e_i bits of its
own. Buckets of a partition value that hold too many fingerprints are split again in the same way by the bits that are still
free, so no task gets more than a bounded number of them, and no link is lost.
"""

from __future__ import annotations

import itertools
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.llm.common import forget, in_parts, keep

BITS = 64
#: A bucket of more fingerprints is split by further bits.
BUCKET = 2000
#: Hashes of one text that are counted at once.
CHUNK = 255 * 256


def _ones(hashes: list[int]) -> np.ndarray:
    """How often each of the 64 bits is set."""
    a = np.array(hashes, dtype="<u8")
    bits = np.zeros((-(-len(a) // 255) * 255, BITS), np.uint8)
    bits[: len(a)] = np.unpackbits(a.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of one text, unsigned; zero if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        return digest(b" ".join(words), 42)
    ones = np.zeros(BITS, np.int64)
    grams = zip(*(itertools.islice(words, k, None) for k in range(shingle)))
    while hashes := [digest(b" ".join(g), 42) for g in itertools.islice(grams, CHUNK)]:
        ones += _ones(hashes)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed 64-bit integer. One row for each row of docs."""

    def run(batches):
        for b in in_parts(batches):
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, fp long")


def differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of bits in which signed 64-bit integers differ. (NumPy counts the bits of a negative number's absolute value.)"""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _prints(b: pa.RecordBatch, words: int) -> np.ndarray:
    """(rows, words) of a batch whose first column has the words of a fingerprint."""
    return b.column(0).flatten().to_numpy().reshape(-1, words)


def _together(prints: DataFrame, words: int) -> tuple[np.ndarray, int]:
    """For each word 64 x 64 counts of bits that are set together, over all fingerprints, and the number of these."""

    def run(batches):
        total, n = np.zeros((words, BITS, BITS), np.int64), 0
        for b in in_parts(batches, 1 << 16):
            own = _prints(b, words)
            for w in range(words):
                x = _bits(own[:, w]).astype(np.float32)  # counts exactly to 2**24
                total[w] += (x.T @ x).astype(np.int64)
            n += len(own)
        names = [(w, i) for w in range(words) for i in range(BITS)] + [(0, -1)]
        counts = [*total.reshape(-1, BITS).tolist(), [n] * BITS]
        yield pa.RecordBatch.from_pydict({"w": [x for x, _ in names], "i": [x for _, x in names], "counts": counts}, pa.schema({"w": pa.int32(), "i": pa.int32(), "counts": pa.list_(pa.int64())}))

    sums = [F.sum(F.col("counts")[j]).alias(f"c{j}") for j in range(BITS)]
    rows = {(r[0], r[1]): r[2:] for r in prints.select("words").mapInArrow(run, "w int, i int, counts array<long>").groupBy("w", "i").agg(*sums).collect()}  # 64 rows a word
    return np.array([[rows.get((w, i), (0,) * BITS) for i in range(BITS)] for w in range(words)], dtype=np.float64), int(rows.get((0, -1), (0,))[0])


def _partitions(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """The bits in m partitions of nearly equal size, each grown by the bit that correlates most with those it has."""
    p = np.diag(together) / max(n, 1)
    cov = np.abs(together / max(n, 1) - np.outer(p, p)) / np.sqrt(np.outer(p * (1 - p), p * (1 - p)) + 1e-12)
    free, parts = set(range(BITS)), []
    for k in range(m):
        width = (BITS + k) // m
        rest = sorted(free)
        part = [max(rest, key=lambda b: (cov[b, rest].sum(), -b))]
        free.discard(part[0])
        while len(part) < width:
            part.append(max(sorted(free), key=lambda b: (cov[b, part].sum(), -b)))
            free.discard(part[-1])
        parts.append(sorted(part))
    return parts


def _partition_count(n: int, distance: int) -> int:
    """The m with the lowest cost of a probe if all bits were even: signatures, and a fifth of that for each candidate."""

    def cost(m: int) -> float:
        width, total = BITS // m, 0.0
        for k in range(m):
            e = (distance + 1) // m + (k < (distance + 1) % m) - 1
            near = sum(math.comb(width, d) for d in range(e + 1))
            total += near * (1 + 0.2 * n / 2**width)
        return total

    return min(range(2, distance + 2), key=cost) if distance else 1


def _groups(part: list[int]) -> list[list[int]]:
    """At most 8 bits each: small enough for a full table of distances."""
    k = -(-len(part) // 8)
    return [part[len(part) * i // k : len(part) * (i + 1) // k] for i in range(k)]


def _value(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    u, out = fps.view(np.uint64), np.zeros(len(fps), np.int64)
    for k, b in enumerate(bits):
        out |= ((u >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def _distances(prints: DataFrame, groups: list[list[list[int]]], distance: int) -> list[list[np.ndarray]]:
    """groups: of bits, for each word. For each and each value of its bits: the share of all fingerprints at distance 0, 1, ... in that group."""
    words = len(groups)

    def run(batches):
        counts = [[np.zeros(1 << len(g), np.int64) for g in own] for own in groups]
        for b in in_parts(batches, 1 << 16):
            fps = _prints(b, words)
            for w, own in enumerate(groups):
                for c, g in zip(counts[w], own, strict=True):
                    c += np.bincount(_value(np.ascontiguousarray(fps[:, w]), g), minlength=len(c))
        for w in range(words):
            for i, c in enumerate(counts[w]):
                v = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), w, np.int32)), pa.array(np.full(len(v), i, np.int32)), pa.array(v.astype(np.int32)), pa.array(c[v])], ["w", "g", "v", "n"])

    found = prints.select("words").mapInArrow(run, "w int, g int, v int, n long").groupBy("w", "g", "v").agg(F.sum("n").alias("n")).collect()  # 256 for each of at most 10 groups a word
    n = [[np.zeros(1 << len(g)) for g in own] for own in groups]
    for w, g, v, k in found:
        n[w][g][v] = k
    at = {size: np.bitwise_count(np.arange(size)[:, None] ^ np.arange(size)[None, :]) for size in {len(x) for own in n for x in own}}
    return [[np.stack([(at[len(x)] == d) @ x / max(x.sum(), 1) for d in range(distance + 1)], axis=1) for x in own] for own in n]


def thresholds(fps: np.ndarray, parts: list[list[int]], tables: list[list[np.ndarray]], n: int, distance: int) -> np.ndarray:
    """For each fingerprint and partition the threshold, -1 for none: the cheapest with sum(e + 1) = distance + 1."""
    rows, units = len(fps), distance + 1
    best = np.full((rows, units + 1), np.inf)
    best[:, 0] = 0
    choice = np.zeros((len(parts), rows, units + 1), np.int8)
    for i, part in enumerate(parts):
        near = np.zeros((rows, units))
        near[:, 0] = 1
        for g, table in zip(_groups(part), tables[i], strict=True):  # distances in the groups add up
            own, both = table[_value(fps, g)], np.zeros_like(near)
            for d in range(units):
                for e in range(units - d):
                    both[:, d + e] += near[:, d] * own[:, e]
            near = both
        signatures = np.cumsum([math.comb(len(part), d) for d in range(units)])
        cost = np.concatenate([np.zeros((rows, 1)), signatures + 0.2 * n * np.cumsum(near, axis=1)], axis=1)
        new = np.full_like(best, np.inf)
        for b in range(units + 1):
            for f in range(b + 1):
                total = best[:, b - f] + cost[:, f]
                better = total < new[:, b]
                new[better, b] = total[better]
                choice[i, better, b] = f
        best = new
    out, left, each = np.zeros((rows, len(parts)), np.int8), np.full(rows, units), np.arange(rows)
    for i in reversed(range(len(parts))):
        f = choice[i, each, left]
        out[:, i] = f - 1
        left = left - f
    return out


class Plan(NamedTuple):
    """The partitions of the bits, and what the thresholds are chosen by."""

    parts: list[list[int]]
    tables: list[list[np.ndarray]]
    n: int


def index_plans(prints: DataFrame, words: int, distance: int, m: int | None = None) -> list[Plan]:
    """prints: (words), fingerprints of so many words. For each word m partitions (None: the cheapest number) by correlation, and for each the estimates of candidates."""
    together, n = _together(prints, words)
    parts = [_partitions(t, n, m or _partition_count(n, distance)) for t in together]
    found = [iter(x) for x in _distances(prints, [[g for part in own for g in _groups(part)] for own in parts], distance)]
    return [Plan(own, [[next(f) for _ in _groups(part)] for part in own], n) for own, f in zip(parts, found, strict=True)]


def probes(fps: np.ndarray, plan: Plan, distance: int):
    """(mask, values, places in fps, probe): each fingerprint stands in the bucket of its bits under a partition's mask, and of those that it probes there."""
    parts, tables, n = plan
    masks = [np.int64(np.uint64(sum(1 << b for b in part))) if sum(1 << b for b in part) < 1 << 63 else np.uint64(sum(1 << b for b in part)).astype(np.int64) for part in parts]
    flips = [[np.array([sum(1 << b for b in c) for c in itertools.combinations(part, d)], dtype=np.uint64).view(np.int64) for d in range(distance + 1)] for part in parts]
    e = thresholds(fps, parts, tables, n, distance)
    for i, mask in enumerate(masks):
        yield mask, fps & mask, np.arange(len(fps)), e[:, i] >= 0
        for d in range(1, distance + 1):
            far = np.flatnonzero(e[:, i] >= d)
            for at in range(0, len(far), 4096):
                x = far[at : at + 4096]
                values = (fps[x][:, None] ^ flips[i][d][None, :]) & mask
                if values.size:
                    yield mask, values.ravel(), np.repeat(x, values.shape[1]), np.ones(values.size, bool)


def _probes(distinct: DataFrame, plan: Plan, distance: int) -> DataFrame:
    """(mask, value, fp, probe)."""

    def run(batches):
        for b in in_parts(batches, 10_000):
            fps = b.column(0).to_numpy()
            for mask, values, at, probe in probes(fps, plan, distance):
                yield _bucketed(mask, values, fps[at], probe)

    return distinct.select("fp").mapInArrow(run, "mask long, value long, fp long, probe boolean")


def _bucketed(mask, values, fps, probe) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), mask, np.int64)), pa.array(values), pa.array(fps), pa.array(probe)], ["mask", "value", "fp", "probe"])


def _split(distance: int):
    """Gives each row of a bucket that is too large a row in distance + 1 smaller ones, by the bits that are still free."""

    def run(batches):
        for b in batches:
            mask, value, fps, probe = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for m in np.unique(mask):
                free, own = [k for k in range(BITS) if not (int(m) >> k) & 1], mask == m
                for k in range(distance + 1):
                    sub = np.array([sum(1 << x for x in free[k :: distance + 1])], dtype=np.uint64).view(np.int64)[0]
                    yield _bucketed(m | sub, value[own] | (fps[own] & sub), fps[own], probe[own])

    return run


def _bucket_links(fps: np.ndarray, probe: np.ndarray, distance: int) -> np.ndarray:
    """A spanning forest of the links in one bucket, as rows (a, b)."""
    n = len(fps)
    root, todo, links = np.full(n, -1), list(range(n)), []
    for start in todo:
        if root[start] >= 0:
            continue
        root[start], front = start, [start]
        while front:
            x = front.pop()
            near = np.flatnonzero((root < 0) & (differ(fps, fps[x]) <= distance) & (probe | probe[x]))
            root[near] = start
            front.extend(near.tolist())
            links.append(np.stack([np.full(len(near), fps[x]), fps[near]], axis=1))
    return np.concatenate(links) if links else np.zeros((0, 2), np.int64)


def _verified(distance: int):
    """Links among rows that come sorted by bucket."""

    def links(mask, value, fps, probe):
        out = []
        start = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])])
        size = np.diff(np.r_[start, len(fps)])
        where = np.repeat(np.arange(len(start)), size)
        small = np.repeat(size <= 16, size)
        for shift in range(1, 16):
            a, b = slice(None, -shift), slice(shift, None)
            if shift >= len(fps):
                break
            ok = (where[a] == where[b]) & small[a] & (probe[a] | probe[b]) & (differ(fps[a], fps[b]) <= distance)
            out.append(np.stack([fps[a][ok], fps[b][ok]], axis=1))
        out += [_bucket_links(fps[s : s + k], probe[s : s + k], distance) for s, k in zip(start[size > 16], size[size > 16], strict=True)]
        x = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        x = np.unique(np.sort(x[x[:, 0] != x[:, 1]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])

    def run(batches):
        rest = None
        for b in batches:
            now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if rest is not None:
                now = [np.concatenate(p) for p in zip(rest, now, strict=True)]
            mask, value = now[:2]
            last = np.flatnonzero((mask != mask[-1:]) | (value != value[-1:]))
            cut = last[-1] + 1 if len(last) else 0  # the last bucket may go on in the next batch
            if cut:
                yield links(*(x[:cut] for x in now))
            rest = [x[cut:] for x in now]
        if rest is not None and len(rest[0]):
            yield links(*rest)

    return run


def near_links(distinct: DataFrame, distance: int = 3, bucket: int = BUCKET) -> DataFrame:
    """distinct: (fp), all different. (a, b): links at up to `distance` bits, enough to join all that are linked directly or
    through others (in a bucket of many, a spanning forest of its links). Ends with a written table."""
    (plan,) = index_plans(distinct.select(F.array("fp").alias("words")), 1, distance)
    rows = keep(_probes(distinct, plan, distance), "simhash-probes")
    links, tables_made = None, [rows]
    while True:
        sizes = rows.groupBy("mask", "value").agg(F.count("*").alias("n"), F.max("probe").alias("any"))
        live = rows.join(sizes.where("n > 1 and any"), ["mask", "value"])
        full = (F.col("n") > bucket) & (F.bit_count("mask") < BITS - 11)  # at most 2**11 fingerprints agree in 53 bits
        some = (
            live.where(~full).select("mask", "value", "fp", "probe").repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
            .mapInArrow(_verified(distance), "a long, b long")
        )
        links = some if links is None else links.union(some)
        if sizes.where(full).isEmpty():
            break
        rows = keep(live.where(full).select("mask", "value", "fp", "probe").mapInArrow(_split(distance), "mask long, value long, fp long, probe boolean").distinct(), "simhash-split")
        tables_made.append(rows)
    out = keep(links.distinct(), "simhash-links")
    for t in tables_made:
        forget(t)
    return out


def components(links: DataFrame) -> DataFrame:
    """links: (a, b). (node, root): every node of a link and the smallest node reachable. Alternates large and small stars
    (each node's neighbours move to the smallest of them) until nothing changes; each round is a written table."""
    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = keep(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("x"), "m").where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v"))
        new = keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        forget(edges), forget(large)
        edges, before = new, state
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """(id, fingerprint, component_id), a row for each row of docs; component_id is the smallest id reachable over links of
    fingerprints at `distance` bits or fewer, its own included.

    A null or empty text, or one of white space only, has fingerprint zero and is linked like any other; null ids are kept,
    and count only where a component has no other. Rows that repeat get the same answer each. Further columns are ignored.
    """
    fps = keep(fingerprints(docs, id_col, text_col, shingle), "simhash")
    own = keep(fps.groupBy("fp").agg(F.min("id").alias("own")), "simhash-distinct")
    nodes = components(near_links(own, distance)).withColumnRenamed("node", "fp")
    linked = nodes.join(own, "fp")
    roots = linked.groupBy("root").agg(F.min("own").alias("component_id"))
    where = own.join(linked.select("fp", "root").join(roots, "root"), "fp", "left").select("fp", F.coalesce("component_id", "own").alias("component_id"))
    where = keep(where, "simhash-components")  # then the join below is on its own, and Spark can split a hot fingerprint's rows
    return fps.join(where, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """The rows of docs, with all their columns, that have the smallest id of their group of near duplicates. Of rows that
    repeat an id one stays; rows with a null id stay."""
    return smallest(docs, near_duplicates(docs, id_col, text_col, shingle, distance), id_col)


def smallest(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs that deduplicate() keeps; found: (id, component_id, ...) of near_duplicates()."""
    groups = keep(found.select(F.col(id_col).alias("id"), "component_id"), "simhash-groups")
    drop = keep(groups.where("id <> component_id").select(F.col("id").alias(id_col)).distinct(), "simhash-drop")
    kept = docs.join(drop, id_col, "left_anti")
    repeated = keep(groups.where("id = component_id").groupBy("id").count().where("count > 1").select(F.col("id").alias(id_col)), "simhash-repeated")
    if repeated.isEmpty():
        return kept
    return kept.join(repeated, id_col, "left_anti").unionByName(kept.join(repeated, id_col, "left_semi").dropDuplicates([id_col]))
