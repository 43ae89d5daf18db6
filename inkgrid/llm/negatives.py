"""Hard negatives by a multiway hyperplane tree with distance ranges between siblings (GNAT), exact in its leaves.

Vectors are integers, scores their inner products. With one more component all rows lie on a sphere and a row's distance from an anchor falls as its score rises, so that a window of scores is an
annulus around the anchor. A node has some split points; a row goes on to the nearest. Each split point keeps the nearest and the farthest distance to the rows below every sibling, over
all rows. A sibling whose range doesn't meet the annulus, as the triangle inequality shifts it, has no row of the window. What is left is scored in whole leaves, in blocks of rows and of anchors.

The split points come from a bounded sample; ranges and leaves have every row, so results are exact whatever the sample.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.llm.common import forget, in_parts, keep

#: Split points of a node, candidates for each of them, rows of the sample that a node has at least.
ARITY, CANDIDATES, LEAST = 16, 3, 128
#: Rows of the sample that the split points are chosen from, and its bytes: the one bound of the index.
SAMPLE, SAMPLE_BYTES = 1 << 13, 32 << 20
#: Rows of a leaf's block, about, and anchors that meet it at once.
CHUNK, TOGETHER = 4096, 256
#: Parts of the sphere's radius by which distances may be off in floating point, amply.
SLACK = 1e-5

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_VECTOR = "id long, label long, vec binary, leaf int"
_FOUND = "anchor_id long, w int, id long, score long"


class Space(NamedTuple):
    """What holds for all rows: components (shorter vectors end in zeros), their type, and the sphere's squared radius."""

    dim: int
    kind: str
    square: float

    def lifted(self, v: np.ndarray) -> np.ndarray:
        """Rows on the sphere."""
        return np.hstack([v, np.sqrt(np.maximum(self.square - np.einsum("ij,ij->i", v, v), 0))[:, None]])

    def vectors(self, column: pa.Array) -> np.ndarray:
        """Rows of a binary column, as doubles."""
        if not len(column):
            return np.zeros((0, self.dim))
        return np.frombuffer(b"".join(x.as_buffer() for x in column), self.kind).reshape(len(column), self.dim).astype(np.float64)


class Tree(NamedTuple):
    """Nodes from the root on: split points on the sphere, and where each leads: a node, or ~leaf."""

    points: list[np.ndarray]
    child: list[list[int]]

    @property
    def leaves(self) -> int:
        return sum(c < 0 for node in self.child for c in node)


def grow(sample: np.ndarray) -> Tree:
    """A tree over rows on the sphere. Split points are far from each other, chosen among a few candidates; a node whose rows are all alike isn't split."""
    tree, n = Tree([], []), 0
    todo = [(sample, None)]
    for rows, place in todo:
        some = rows[np.linspace(0, len(rows) - 1, min(len(rows), ARITY * CANDIDATES)).astype(int)]
        chosen, far = [0], np.linalg.norm(some - some[0], axis=1)
        while len(chosen) < ARITY and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(some - some[chosen[-1]], axis=1))
        if place is not None and len(chosen) == 1:
            tree.child[place[0]][place[1]], n = ~n, n + 1
            continue
        if place is not None:
            tree.child[place[0]][place[1]] = len(tree.points)
        me, points = len(tree.points), some[chosen]
        tree.points.append(points)
        tree.child.append([0] * len(chosen))
        near = (rows @ points.T).argmax(axis=1)
        for j in range(len(chosen)):
            own = rows[near == j]
            if LEAST <= len(own) < len(rows):
                todo.append((own, (me, j)))
            else:
                tree.child[me][j], n = ~n, n + 1
    return tree


def distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(np.einsum("ij,ij->i", rows, rows)[:, None] + np.einsum("ij,ij->i", points, points)[None] - 2 * rows @ points.T, 0))


def descend(tree: Tree, rows: np.ndarray):
    """(leaf of each row on the sphere, [(node, rows there, their distances from its points, their child)])."""
    leaf, seen, todo = np.zeros(len(rows), np.int32), [], [(0, np.arange(len(rows)))]
    for node, on in todo:
        if not len(on):
            continue
        d = distances(rows[on], tree.points[node])
        near = d.argmin(axis=1)
        seen.append((node, on, d, near))
        for j, child in enumerate(tree.child[node]):
            own = on[near == j]
            if child < 0:
                leaf[own] = ~child
            else:
                todo.append((child, own))
    return leaf, seen


def surviving(tree: Tree, ranges: list[np.ndarray], anchors: np.ndarray, inner: np.ndarray, outer: np.ndarray, slack: float) -> np.ndarray:
    """(anchors x leaves): leaves that may have rows between the distances inner and outer. ranges: for each node (2, points, children), empty children are (inf, -inf)."""
    out, todo = np.zeros((len(anchors), tree.leaves), bool), [(0, np.flatnonzero(inner <= outer + slack))]
    for node, on in todo:
        if not len(on):
            continue
        d = distances(anchors[on], tree.points[node])[:, :, None]
        near, far = ranges[node][0][None] - slack, ranges[node][1][None] + slack
        r1, r2 = inner[on][:, None, None], outer[on][:, None, None]
        may = ((near <= d + r2) & (far >= d - r2) & (far >= r1 - d)).all(axis=1)
        for j, child in enumerate(tree.child[node]):
            own = on[may[:, j]]
            if child < 0:
                out[own, ~child] = True
            else:
                todo.append((child, own))
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of integers, exact: as doubles where every sum stays below 2^53, else as Python's. OverflowError if one passes 64 bits."""
    if not a.size or not b.size or a.shape[1] * np.abs(a).max() * np.abs(b).max() < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.vectorize(int, otypes=[object])(x)
    return (whole(a) @ whole(b).T).astype(np.int64)


def best(scores: np.ndarray, may: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the first k columns of each row that may be taken: higher scores first, then columns in order."""
    n, low = scores.shape[1], scores.min(initial=0)
    if (int(scores.max(initial=0)) - int(low) + 2) * n < 1 << 62:
        keys = np.where(may, (scores - low + 1) * n - np.arange(n), 0)
        if n > k:
            at = np.argpartition(keys, n - k, axis=1)[:, n - k :]
            row, col = np.nonzero(np.take_along_axis(keys, at, axis=1))
            return row, at[row, col]
        return np.nonzero(keys)
    found = [(i, j) for i in range(len(scores)) for j in sorted(np.flatnonzero(may[i]), key=lambda j, i=i: (-int(scores[i, j]), j))[:k]]
    return tuple(np.array(found, int).reshape(-1, 2).T)


def usable(rows: DataFrame, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """(id, label, vec): integers as doubles. Rows with a null id, label or vector, or a component that is null or not finite (256 times it neither), are left out; of rows with equal ids the one with the smallest label,
    then vector, is kept."""
    c = F.col("vec")
    r = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(F.col(vec_col).cast("array<double>"), lambda x: x * 256).alias("vec"))
    r = r.where(F.col("id").isNotNull() & F.col("label").isNotNull() & c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    whole = F.transform(c, lambda x: F.when(F.abs(x) < 1 << 53, F.floor(x).cast("double")).otherwise(x))
    return r.select("id", "label", whole.alias("vec")).groupBy("id").agg(F.min(F.struct("label", "vec")).alias("one")).select("id", "one.label", "one.vec")


class Index(NamedTuple):
    """blocks: (leaf, chunk, rows), written; chunks: how many of each leaf. The rest is bounded by the sample."""

    space: Space
    tree: Tree
    ranges: list[np.ndarray]
    chunks: np.ndarray
    blocks: DataFrame


def packed(batch_vectors: pa.Array, space: Space) -> np.ndarray:
    """(rows x dim) of a column of lists, zeros behind short ones."""
    out = np.zeros((len(batch_vectors), space.dim))
    flat, off = batch_vectors.flatten().to_numpy(zero_copy_only=False), batch_vectors.offsets.to_numpy()
    size = np.diff(off)
    out[np.arange(space.dim)[None] < size[:, None]] = flat
    return out


def placed(rows: DataFrame, space: Space, tree: Tree) -> DataFrame:
    """_VECTOR: rows of usable() with their leaf."""
    sent = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        for b in in_parts(batches, CHUNK):
            v = packed(b.column(2), space)
            leaf, _ = descend(sent.value, space.lifted(v))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in v.astype(space.kind)], pa.binary()), pa.array(leaf)], ["id", "label", "vec", "leaf"])

    return rows.select("id", "label", "vec").mapInArrow(run, _VECTOR)


def measured(rows: DataFrame, space: Space, tree: Tree) -> tuple[list[np.ndarray], np.ndarray]:
    """(ranges, rows of each leaf) over all rows; each batch sends one row for a node, point and child."""
    sent = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        for b in in_parts(batches, CHUNK):
            _, seen = descend(sent.value, space.lifted(packed(b.column(0), space)))
            for node, _, d, near in seen:
                for j in np.unique(near):
                    own = d[near == j]
                    k = own.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, node)), pa.array(np.arange(k)), pa.array(np.full(k, j)), pa.array(own.min(axis=0)), pa.array(own.max(axis=0)), pa.array(np.full(k, len(own)))], ["node", "i", "j", "lo", "hi", "n"])

    found = rows.select("vec").mapInArrow(run, "node long, i long, j long, lo double, hi double, n long").groupBy("node", "i", "j").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).collect()
    ranges = [np.stack([np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf)]) for p in tree.points]
    counts = np.zeros(tree.leaves, np.int64)
    for r in found:
        ranges[r["node"]][:, r["i"], r["j"]] = r["lo"], r["hi"]
        if (child := tree.child[r["node"]][r["j"]]) < 0:
            counts[~child] = r["n"]
    return ranges, counts


def build(rows: DataFrame) -> Index | None:
    """The index of written rows of usable(); None without rows."""
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    most = F.array_max(F.transform("vec", F.abs))
    n, dim, high, far = rows.agg(F.count("*"), F.max(F.size("vec")), F.max(most), F.max(square)).first()
    if not n:
        return None
    space = Space(max(1, dim), "<i4" if (high or 0) < 1 << 31 else "<f8", far)
    some = rows.orderBy(F.xxhash64("id"), "id").limit(max(2, min(SAMPLE, SAMPLE_BYTES // (8 * space.dim)))).select("vec").toArrow()
    sample = packed(some.column(0).combine_chunks(), space)
    tree = grow(space.lifted(sample))
    ranges, counts = measured(rows, space, tree)
    chunks = np.maximum(1, -(-counts // CHUNK))
    sizes = F.array(*(F.lit(int(c)) for c in chunks))
    blocks = placed(rows, space, tree).withColumn("chunk", F.pmod(F.xxhash64("id"), F.element_at(sizes, F.col("leaf") + 1).cast("long")).cast("int"))
    return Index(space, tree, ranges, chunks, keep(blocks.groupBy("leaf", "chunk").agg(F.sort_array(F.collect_list(F.struct("id", "label", "vec"))).alias("rows")), "negatives-blocks"))


def probe(index: Index, anchors: DataFrame, same: bool, k: int, home: bool) -> DataFrame:
    """_FOUND: the first k rows (of each block) of each anchor's windows, with its own label or (same=False) another. anchors: (id, label, vec, leaf, lo, hi): arrays of windows of scores, ends
    included, null for none. home: in the anchor's own leaf, else in all others that the ranges leave."""
    space, tree, ranges, chunks = index[:4]
    sent = anchors.sparkSession.sparkContext.broadcast((tree, ranges, chunks))
    endless = 1 << 62

    def route(batches):
        tree, ranges, chunks = sent.value
        for b in in_parts(batches, TOGETHER):
            v = space.vectors(b.column(2))
            lo, hi = ([[(z if x is None else x) for x in w] for w in c.to_pylist()] for c, z in ((b.column(4), -endless), (b.column(5), endless)))
            width = max(map(len, lo), default=0)
            lo, hi = (np.array([w + [z] * (width - len(w)) for w in c], np.int64).reshape(len(v), width) for c, z in ((lo, endless), (hi, -endless)))
            open_ = lo <= hi
            own = b.column(3).to_numpy()
            if home:
                may = np.zeros((len(v), tree.leaves), bool)
                may[np.arange(len(v)), own] = open_.any(axis=1)
            else:
                least, most = np.where(open_, lo, endless).min(axis=1, initial=endless), np.where(open_, hi, -endless).max(axis=1, initial=-endless)
                near = np.einsum("ij,ij->i", v, v) + space.square
                outer = np.where(least <= -endless, np.inf, np.sqrt(np.maximum(near - 2.0 * least, 0)))
                inner = np.where(most >= endless, 0, np.sqrt(np.maximum(near - 2.0 * most, 0)))
                outer[~open_.any(axis=1)] = -np.inf
                may = surviving(tree, ranges, np.hstack([v, np.zeros((len(v), 1))]), inner, outer, SLACK * (np.sqrt(space.square) + np.sqrt(near.max(initial=0)) + 1))
                may[np.arange(len(v)), own] = False
            for leaf in np.flatnonzero(may.any(axis=0)):
                at = pa.array(np.flatnonzero(may[:, leaf]))
                some = b.take(at)
                data = [some.column(0).to_numpy().astype("<i8").tobytes(), some.column(1).to_numpy().astype("<i8").tobytes(), b"".join(x.as_buffer() for x in some.column(2)), lo[at].astype("<i8").tobytes(), hi[at].astype("<i8").tobytes()]
                for c in range(chunks[leaf]):
                    yield pa.RecordBatch.from_arrays([pa.array([leaf], pa.int32()), pa.array([c], pa.int32()), *(pa.array([x], pa.binary()) for x in data)], ["leaf", "chunk", "ids", "labels", "vecs", "lo", "hi"])

    def score(batches):
        for b in in_parts(batches, 1):
            rows = b.column(0)[0].values
            ids, labels, vecs = rows.field(0).to_numpy(), rows.field(1).to_numpy(), space.vectors(rows.field(2))
            q_ids, q_labels, lo, hi = (np.frombuffer(b.column(i)[0].as_buffer(), "<i8") for i in (1, 2, 4, 5))
            q = np.frombuffer(b.column(3)[0].as_buffer(), space.kind).reshape(-1, space.dim).astype(np.float64)
            lo, hi = lo.reshape(len(q), -1), hi.reshape(len(q), -1)
            s = products(q, vecs)
            may = ((q_labels[:, None] == labels[None]) == same) & (q_ids[:, None] != ids[None])
            for w in range(lo.shape[1]):
                i, j = best(s, may & (s >= lo[:, w, None]) & (s <= hi[:, w, None]), k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(np.full(len(i), w, np.int32)), pa.array(ids[j]), pa.array(s[i, j])], ["anchor_id", "w", "id", "score"])

    asked = anchors.select("id", "label", "vec", "leaf", "lo", "hi").mapInArrow(route, "leaf int, chunk int, ids binary, labels binary, vecs binary, lo binary, hi binary")
    # by merging: blocks shrink so well on disk that Spark would take them for small enough to be sent whole
    pairs = asked.join(index.blocks.hint("merge"), ["leaf", "chunk"]).select("rows", "ids", "labels", "vecs", "lo", "hi")
    return pairs.mapInArrow(score, _FOUND)


def search(index: Index, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """_FOUND with rank: the first k rows of each window. The anchor's own leaf gives a bound; then the leaves that may have rows within it."""
    order = Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "id")
    first = keep(probe(index, anchors, same, k, True).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "negatives-first")
    bound = first.where(F.col("rank") == k).groupBy(F.col("anchor_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("bound"))
    tighter = F.transform("lo", lambda x, i: F.coalesce(F.col("bound")[i], x))  # within the window, so never below its end
    closer = anchors.join(bound, "id", "left").withColumn("lo", F.when(F.col("bound").isNull(), F.col("lo")).otherwise(tighter)).drop("bound")
    both = first.drop("rank").unionByName(probe(index, closer, same, k, False))
    out = keep(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "negatives-found")
    forget(first)
    return out


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """RESULT: for each row that is an anchor (by its columns id, label, vec) and each of its first `positives` other rows of the same label, the first `negatives` rows of other labels whose
    score is between `low` and `high` percent of the positive's. Components are floor(256 * x), scores inner products; higher ones come first, ties by smaller id.

    Left out are rows with a null id, label, vector or component, and ones that aren't finite; of rows with equal ids the smallest (label, vector) counts. Shorter vectors end in zeros, empty ones score 0. A positive
    without such negatives, also each with a negative score, has no row. Empty tables give none. Scores past 64 bits are an error.
    """
    spark = rows.sparkSession
    own = keep(usable(rows, id_col, label_col, vec_col), "negatives-rows")
    index = build(own)
    if index is None:
        forget(own)
        return spark.createDataFrame([], RESULT)
    ends = lambda c: F.array(F.lit(None).cast("long")).alias(c)
    anchors = keep(placed(own.where(anchor), index.space, index.tree).repartitionByRange("leaf", "id").sortWithinPartitions("leaf", "id"), "negatives-anchors")
    near = search(index, anchors.select("*", ends("lo"), ends("hi")), True, positives)
    wide = lambda c, f: f(F.col(c).cast("decimal(20,0)") * F.lit(low if f is F.ceil else high).cast("decimal(3,0)") / F.lit(100).cast("decimal(3,0)")).cast("long")
    windows = near.select(F.col("anchor_id").alias("id"), F.struct((F.col("rank") - 1).alias("w"), wide("score", F.ceil).alias("lo"), wide("score", F.floor).alias("hi")).alias("x")).groupBy("id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    asked = anchors.join(windows, "id").select("id", "label", "vec", "leaf", F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi"))
    hard = search(index, asked, False, negatives)
    p = near.select("anchor_id", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = keep(hard.join(p, ["anchor_id", "w"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
    forget(own, index.blocks, anchors, near, hard)
    return out
