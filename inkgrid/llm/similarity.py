"""SimHash near duplicates at a similarity of shingle sets: wide fingerprints find candidates, the sets decide.

Texts with the same set of shingles are one node. A node has a fingerprint of several 64-bit words, each by a hash of its own. A pair at similarity s differs in each bit with
probability acos(2 s / (1 + s)) / pi at most. In each word, candidates come from the partitions, thresholds and probes of the generalised pigeonhole principle
(simhash.py). In a bucket, nodes stay only if another one there differs from them in few bits of the first two words; pairs that differ in few bits of all words
are then verified by the Jaccard similarity of their sets.

In a round, a few nodes of each bucket (hubs) are compared with all others of it that aren't known to be in their component, then leave the bucket; a bucket ends
when its nodes are in one component. So each two nodes of a bucket are compared or known to be linked, and a large group of near
copies costs comparisons in proportion to its size. The first rounds take the buckets of one word and of four words, with one hub each, so that large groups are joined by
a few comparisons of each node before the other buckets are looked at; later rounds have 4, 64, ... hubs.
"""

from __future__ import annotations

import functools
import itertools
import math
import operator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.llm import simhash
from inkgrid.llm.common import forget, in_parts, keep

#: Rows up to which a word has so many partitions, and the words of a fingerprint then. A pair at 0.8 agrees in a bit with probability 0.848, so it is a candidate with
#: probability 1 - (1 - 0.848 ** 16) ** 64 = 0.992 with four partitions (0.85: 0.9994, 0.9: 1.0000), and as much with three; wider partitions keep the buckets of more rows small.
WIDTHS = ((1 << 26, 4, 16), (math.inf, 3, 53))
#: Nodes of a bucket of which each is compared with all others at once.
BUCKET = 2048
#: Shingles whose bits are counted at once, and shingles of the texts of a batch of rows.
CHUNK, BATCH = 4096, 1 << 19
#: Candidates that are broadcast at most; more are joined by a shuffle.
NODES = 2_000_000

#: The multipliers of a 64-bit mixing function (splitmix64).
_STEP, _FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """The hashes of a text's different shingles, sorted; of all its words if they are fewer than a shingle has."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    grams = zip(*(itertools.islice(words, k, None) for k in range(min(shingle, len(words)))))
    return np.unique(np.array([digest(b" ".join(g), 42) for g in grams], np.uint64))


def node_of(hashes: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(hashes.tobytes(), 42)], np.uint64).view(np.int64)[0])


def fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """`words` signed 64-bit integers: in each bit, whether over half of the shingles have it set in that word's hash."""
    ones = np.zeros((words, 64), np.int64)
    for at in range(0, len(hashes), CHUNK):
        with np.errstate(over="ignore"):
            z = hashes[None, at : at + CHUNK] + np.arange(1, words + 1, dtype=np.uint64)[:, None] * _STEP
            z = (z ^ (z >> np.uint64(30))) * _FIRST
            z = (z ^ (z >> np.uint64(27))) * _SECOND
            z ^= z >> np.uint64(31)
        ones += np.unpackbits(z.view(np.uint8).reshape(words, -1, 8), axis=2, bitorder="little").sum(axis=1, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), axis=1, bitorder="little").view("<i8").ravel()


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int, words: int) -> DataFrame:
    """(id, text_hash, node, n, words), a row for each row of docs; node is a hash of the set of shingles, n its size, words its fingerprint."""

    def run(batches):
        for b in in_parts(batches):
            sets = [shingles(t.as_py(), shingle) for t in b.column(1)]
            columns = [pa.array([node_of(s) for s in sets]), pa.array([len(s) for s in sets], pa.int32()), pa.array([fingerprint(s, words) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *columns], ["id", "text_hash", "node", "n", "words"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, text_hash long, node long, n int, words array<long>")


def furthest(similarity: float, bits: int = 128) -> int:
    """How many of so many bits a pair at that similarity differs in, but for about one in a hundred thousand."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * p + 4.3 * math.sqrt(bits * p * (1 - p)))


def _met(far: int, similarity: float):
    """Of rows that come sorted by bucket, those that have a partner in theirs, and all of buckets that are too large to compare all."""

    def partners(bucket, n, s0, s1, probe):
        start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        size = np.diff(np.r_[start, len(bucket)])
        where, own = np.repeat(np.arange(len(start)), size), np.repeat(size, size)
        found = own > BUCKET

        def near(a, b):
            fits = np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b])
            return fits & (probe[a] | probe[b]) & (simhash.differ(s0[a], s0[b]).astype(np.int16) + simhash.differ(s1[a], s1[b]) <= far)

        for shift in range(1, min(16, len(bucket))):
            a = np.flatnonzero((where[:-shift] == where[shift:]) & (own[:-shift] <= 16))
            if not len(a):
                break
            a = a[near(a, a + shift)]
            found[a] = found[a + shift] = True
        for s, k in zip(start[(size > 16) & (size <= BUCKET)], size[(size > 16) & (size <= BUCKET)], strict=True):
            at = np.arange(s, s + k)
            for some in np.array_split(at, -(-k * k // 250_000)):
                both = near(np.repeat(some, k), np.tile(at, len(some))).reshape(-1, k)
                both[np.arange(len(some)), some - s] = False
                found[some] = both.any(axis=1)
        return found

    def run(batches):
        rest = large = None  # rows of the last bucket, which may go on; or that bucket, if it is too large to compare all and to be held
        for b in batches:
            now = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            rest, bucket = None, now.column("bucket").to_numpy()
            if large is not None:
                own = int(np.argmax(bucket != large)) if (bucket != large).any() else len(bucket)
                yield from plain(now.slice(0, own))
                now, bucket = now.slice(own), bucket[own:]
                if not len(bucket):
                    continue
                large = None
            last = np.flatnonzero(bucket != bucket[-1:])
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield from chosen(now.slice(0, cut))
            rest = now.slice(cut)
            if rest.num_rows > BUCKET:
                yield from plain(rest)
                rest, large = None, bucket[-1]
        if rest is not None and rest.num_rows:
            yield from chosen(rest)

    def plain(t):
        return t.drop_columns(["probe"]).combine_chunks().to_batches()

    def chosen(t):
        bucket, n, s0, s1, probe = (t.column(c).to_numpy() for c in ("bucket", "n", "s0", "s1", "probe"))
        return plain(t.filter(pa.array(partners(bucket, n, s0, s1, probe))))

    return run


def _placed(nodes: DataFrame, similarity: float, parts: int, words: int) -> DataFrame:
    """(bucket, node, n, s0, s1, word): the nodes in the buckets where they may have a link."""
    plans = simhash.index_plans(nodes, words, parts - 1, parts)

    def run(batches):
        for b in in_parts(batches, 10_000):
            prints = b.column(2).flatten().to_numpy().reshape(-1, words)
            for w, plan in enumerate(plans):
                for mask, value, at, probe in simhash.probes(np.ascontiguousarray(prints[:, w]), plan, parts - 1):
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(_bucket(value, int(mask), w)), b.column(0).take(take), b.column(1).take(take), pa.array(prints[at, 0]), pa.array(prints[at, 1]), pa.array(probe), pa.array(np.full(len(at), w, np.int32))], ["bucket", "node", "n", "s0", "s1", "probe", "word"])

    rows = nodes.select("node", "n", "words").mapInArrow(run, "bucket long, node long, n int, s0 long, s1 long, probe boolean, word int")
    return rows.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("bucket").mapInArrow(_met(furthest(similarity), similarity), "bucket long, node long, n int, s0 long, s1 long, word int")


def _bucket(value: np.ndarray, mask: int, word: int) -> np.ndarray:
    """A hash of a partition of a word and its value."""
    with np.errstate(over="ignore"):
        z = value.view(np.uint64) + np.uint64((mask + word * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * _FIRST
        z = (z ^ (z >> np.uint64(27))) * _SECOND
        return (z ^ (z >> np.uint64(31))).view(np.int64)


def _sets(docs: DataFrame, rows: DataFrame, live: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(node, shingles) of the nodes in `live`, from one text of each."""

    def run(batches):
        for b in in_parts(batches, 200):
            sets = [shingles(t.as_py(), shingle) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets]), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"])

    wanted = keep(rows.join(live.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("text_hash").alias("h")).select("h"), "similarity-texts")
    wanted = F.broadcast(wanted) if wanted.count() <= NODES else wanted
    texts = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")).join(wanted, "h", "left_semi").select("text")
    return texts.mapInArrow(run, "node long, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles"))


def similar_links(docs: DataFrame, rows: DataFrame, text_col: str, shingle: int, similarity: float, parts: int, words: int) -> DataFrame | None:
    """rows: of sketches(). (node, root) for all nodes with a link to another; none if there is no candidate."""
    nodes = keep(rows.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("words").alias("words")), "similarity-nodes")
    met = keep(_placed(nodes, similarity, parts, words), "similarity-met")
    live = keep(met.drop("s0", "s1").join(nodes.select("node", "words"), "node"), "similarity-buckets")
    forget(nodes, met)
    if live.isEmpty():
        forget(live)
        return None
    sets = keep(_sets(docs, rows, live, text_col, shingle), "similarity-sets")
    far = furthest(similarity, 64 * words)  # all words tell pairs near the threshold from others far better than two
    labels = links = tested = None
    for k, upto in itertools.chain(((0, 1), (0, 4)), ((i, words) for i in itertools.count(1, 2))):
        few, use = F.lit(1 << k), live.where(F.col("word") < upto)
        now = use.withColumn("label", F.col("node")) if labels is None else use.join(labels, "node", "left").select(*live.columns, F.coalesce("root", "node").alias("label"))
        open_ = now.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
        now = keep(now.join(open_, "bucket").select(*live.columns, "label"), "similarity-open")
        if now.isEmpty() and upto == words:
            forget(live, sets, now)
            return labels
        by = F.pmod(F.xxhash64("label"), few), F.pmod(F.xxhash64("node", F.lit(1)), few)
        hubs = now.groupBy("bucket", by[0].alias("i"), by[1].alias("j")).agg(F.min(F.struct("node", "label", "n", "words")).alias("hub"))
        hubs = keep(hubs.select("bucket", *(F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("node", "label", "n", "words"))), "similarity-hubs")
        apart = functools.reduce(operator.add, (F.bit_count(F.col("words")[w].bitwiseXOR(F.col("hub_words")[w])) for w in range(words)))
        could = (F.col("label") != F.col("hub_label")) & (F.least("n", "hub_n") / F.greatest("n", "hub_n") >= similarity) & (apart <= far)
        pairs = now.join(hubs, "bucket").where(could).select(F.least("node", "hub_node").alias("a"), F.greatest("node", "hub_node").alias("b")).distinct()
        pairs = keep(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "similarity-pairs")
        a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "ab")
        both = F.size(F.array_intersect("of_a", "of_b"))
        good = keep(pairs.join(a, "a").join(b, "b").where(both / (F.size("of_a") + F.size("of_b") - both) >= similarity).select("a", "b"), "similarity-links")
        if not good.isEmpty():
            links = good if links is None else links.unionByName(good)
            labels = keep(simhash.components(links).distinct(), "similarity-labels")
        tested = pairs if tested is None else tested.unionByName(pairs)
        rest = now.join(hubs.select("bucket", F.col("hub_node").alias("node")), ["bucket", "node"], "left_anti").select(*live.columns)
        rest = keep(rest.unionByName(live.where(F.col("word") >= upto)), "similarity-rest")
        forget(live, now, hubs)
        live = rest


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component_id), a row for each row of docs; component_id is the smallest id reachable over pairs whose sets of shingles have
    a Jaccard similarity of `similarity` or more, its own included.

    Texts without words, null ones too, are copies of each other; null ids are kept, and count only where a component has no other. A pair is missed with
    the probability stated at WIDTHS, unless other pairs link the two. Rows that repeat get the same answer each; an empty table gives an empty result. Further columns are ignored.
    """
    n = docs.count()
    parts, words = next((p, w) for most, p, w in WIDTHS if n <= most)
    rows = keep(sketches(docs, id_col, text_col, shingle, words), "similarity")
    own = rows.groupBy("node").agg(F.min("id").alias("own"))
    labels = similar_links(docs, rows, text_col, shingle, similarity, parts, words)
    if labels is not None:
        linked = keep(own.join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "own"), "similarity-linked")
        roots = linked.groupBy("root").agg(F.min("own").alias("own"))
        own = linked.select("node", "root").join(roots, "root").select("node", "own")
    own = keep(own, "similarity-components")  # then the join below is on its own, and Spark can split a hot node's rows
    out = keep(rows.select("id", "node").join(own, "node").select("id", F.col("own").alias("component_id")), "similarity-groups")
    forget(rows)
    return out.withColumnRenamed("id", id_col)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, that have the smallest id of their group of near duplicates. Of rows that
    repeat an id one stays; rows with a null id stay. Edge cases as in similar_groups()."""
    return simhash.smallest(docs, similar_groups(docs, id_col, text_col, shingle, similarity), id_col)
