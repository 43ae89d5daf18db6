"""Collocations of each language, by suffix subtrees of word prefixes that fit a memory budget (vertical partitioning).

Texts become blocks of word numbers, each with a dictionary of its own. Words that are too rare for any phrase end a suffix; the others get numbers
that hold everywhere. The suffixes of a block, cut at four words, are sorted and counted once. Word prefixes are dealt into groups by their exact frequencies: a
prefix above the budget is extended by a word, and neighbours below it share a group. So a group is a range of prefixes, and the fences between groups are all that executors are
sent. Each group then builds its truncated subtrees on its own, level by level, and the totals at their nodes are the counts of the phrases.
"""

from __future__ import annotations

import itertools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from inkgrid.llm.common import forget, keep

#: Words of a phrase at most.
DEPTH = 4
#: Suffixes of a group, and groups at most (with more of the former than both allow, groups grow): what bounds the fences that are sent.
BUDGET, GROUPS = 1 << 21, 1 << 20
#: Bytes of text of a block, unless one text has more.
BLOCK = 16 << 20

BLOCKS = "block long, lang string, n long, ids binary, words array<string>, counts array<int>"
CODED = "ids binary, first binary"
RESULT = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"

_NONE, _BLANK, _BREAK = 0, 1, 2
_KIND, _LOWER = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_LOWER[0x41:0x5B] += 32
_HIGH = np.uint64(32)


def words_of(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """The words of texts (large_binary, no nulls), and which of them begin a piece."""
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if len(texts) and off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    kind = _KIND[raw]
    inside = kind == _NONE
    cut = np.bincount(off[:-1], minlength=len(raw) + 1)[: len(raw)] if len(texts) else np.zeros(0, np.int64)  # texts that begin at a byte
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (cut[1:] > 0)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | (cut[1:] > 0)
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    piece = np.cumsum(cut + (kind == _BREAK))[start]
    first = np.ones(len(start), bool)
    first[1:] = piece[1:] != piece[:-1]
    places = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=places[1:])
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(places.tobytes()), pa.py_buffer(_LOWER[raw[inside]].tobytes())), first


def _slices(batch: pa.RecordBatch, most: int):
    """The batch in slices of so many bytes of text, each of one row at least."""
    size = np.cumsum(np.nan_to_num(pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def blocks_of(docs: DataFrame, text_col: str, lang_col: str, size: int) -> DataFrame:
    """BLOCKS: words as numbers of the block's dictionary (~number where a piece begins), the dictionary, and each word's count."""

    def run(batches):
        k, n = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for b in _slices(batch, size):
                lang = b.column(0).dictionary_encode()
                for i, name in enumerate(lang.dictionary.to_pylist()):
                    texts = b.column(1).filter(pa.compute.equal(lang.indices, i)).cast(pa.large_binary()).fill_null(b"")
                    words, first = words_of(texts)
                    if not len(words):
                        continue
                    own = words.dictionary_encode()
                    ids = own.indices.to_numpy().astype("<i4")
                    counts = np.bincount(ids, minlength=len(own.dictionary)).astype(np.int32)
                    row = [[k + n], [name], [len(ids)], [np.where(first, ~ids, ids).tobytes()], [own.dictionary], [counts]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32())), strict=True)], BLOCKS.replace(",", "").split()[::2])
                    n += 1

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")).where("text <> ''")
    return rows.mapInArrow(run, BLOCKS)


def numbered(words: DataFrame) -> DataFrame:
    """words: (lang, word, f), written. Adds id: 1, 2, ..., the same whenever it is made; counted within fixed buckets of a hash, and the buckets in one task."""
    w = words.withColumn("bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(4096)))
    before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = w.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", before.alias("base"))
    own = F.row_number().over(Window.partitionBy("bucket").orderBy("lang", "word"))
    return w.withColumn("own", own).join(F.broadcast(base), "bucket").select("lang", "word", "f", (F.col("base") + F.col("own")).alias("id"))


def coded(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """CODED: the blocks with numbers that hold everywhere, 0 for words that have none, and the places (bits) where pieces begin. Dictionaries are joined, not words: a common
    word is one row for each block."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                local = np.frombuffer(b.column(0)[i].as_buffer(), "<i4")
                first = local < 0
                local = np.where(first, ~local, local)
                table = np.zeros(local.max() + 1, "<u4")
                known = b.column(1)[i].values
                table[known.field(0).to_numpy()] = known.field(1).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([table[local].tobytes()]), pa.array([np.packbits(first).tobytes()])], ["ids", "first"])

    known = blocks.select("block", "lang", F.posexplode("words").alias("pos", "word")).join(words, ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("pos", "id")).alias("known"))
    return blocks.select("block", "ids").join(known, "block").select("ids", "known").mapInArrow(run, CODED)


class Level(NamedTuple):
    """How prefixes of one length are dealt. A key is a prefix's number among the heavy ones that are a word shorter, and its last word."""

    fences: np.ndarray  #: first key of each group
    heavy: np.ndarray  #: keys above the budget, which the next level extends


def suffixes(ids: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """For each place the numbers of the DEPTH words from it, 0 from the first on that is rare or of another piece."""
    out, there = [ids], ids > 0
    for k in range(1, DEPTH):
        there = there & np.concatenate([(ids[k:] > 0) & ~first[k:], np.zeros(min(k, len(ids)), bool)])[: len(ids)]
        out.append(np.where(there, np.concatenate([ids[k:], np.zeros(min(k, len(ids)), ids.dtype)])[: len(ids)], 0).astype(ids.dtype))
    return out


def _key(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.uint64) << _HIGH) | low.astype(np.uint64)


def _among(keys: np.ndarray, sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted array, and whether they are there."""
    at = np.searchsorted(sorted_, keys)
    return at, np.append(sorted_, np.uint64(0))[at] == keys if len(sorted_) else np.zeros(len(keys), bool)


def _block(b: pa.RecordBatch, i: int) -> list[np.ndarray]:
    ids = np.frombuffer(b.column(0)[i].as_buffer(), "<u4")
    return suffixes(ids, np.unpackbits(np.frombuffer(b.column(1)[i].as_buffer(), np.uint8), count=len(ids)).astype(bool))


def extended(blocks: DataFrame, levels: list[Level]) -> DataFrame:
    """(h, x, f): exact counts of the heavy prefixes of the last level with one word more. h: the prefix's number among them."""
    sent = blocks.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                s, h = _block(b, i), None
                on = np.flatnonzero(s[0])
                for d, level in enumerate(sent.value):
                    at, there = _among(_key(np.zeros(len(on), np.uint64) if h is None else h, s[d][on]), level.heavy)
                    there &= s[d + 1][on] > 0
                    on, h = on[there], at[there]
                keys, n = np.unique(_key(h, s[len(sent.value)][on]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((keys >> _HIGH).astype(np.int64)), pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n.astype(np.int64))], ["h", "x", "f"])

    return blocks.mapInArrow(run, "h long, x long, f long").groupBy("h", "x").agg(F.sum("f").alias("f"))


def deal(counts: DataFrame, budget: int) -> tuple[Level, dict[int, int]]:
    """The groups of prefixes (h, x, f), and the heavy ones' counts. Neighbours share a group until the budget is full; running sums are made within ranges of 4096 words, and of ranges for each h. What
    comes to the driver is bounded by the sum of counts over the budget."""
    light = F.when(F.col("f") <= budget, F.col("f")).otherwise(0)
    c = counts.withColumns({"range": F.shiftright("x", 12), "light": light})
    ranges = c.groupBy("h", "range").agg(F.sum("light").alias("of"))
    base = F.sum("of").over(Window.partitionBy("h").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("of")
    upto = F.sum("light").over(Window.partitionBy("h", "range").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)) - F.col("light")
    dealt = c.withColumn("upto", upto).join(ranges.withColumn("base", base).drop("of"), ["h", "range"]).where("light > 0")
    fences = dealt.groupBy("h", F.floor((F.col("base") + F.col("upto")) / budget).alias("group")).agg(F.min("x").alias("x")).select("h", "x").collect()
    heavy = {(r["h"] << 32) | r["x"]: r["f"] for r in counts.where(F.col("f") > budget).collect()}
    return Level(np.array(sorted((r["h"] << 32) | r["x"] for r in fences), np.uint64), np.array(sorted(heavy), np.uint64)), heavy


def routed(blocks: DataFrame, levels: list[Level]) -> DataFrame:
    """(level, group, data): the different suffixes of each block with their counts, by group. data: one array after the other, suffix words first."""
    sent = blocks.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                s = _block(b, i)
                on = s[1] > 0
                s = [x[on] for x in s]
                high, low = _key(s[0], s[1]), _key(s[2], s[3])
                order = np.lexsort((low, high))
                high, low = high[order], low[order]
                new = np.ones(len(order), bool)
                new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
                at = np.flatnonzero(new)
                s = [x[order[at]] for x in s] + [np.diff(np.append(at, len(order))).astype("<u4")]
                on, h = np.arange(len(at)), np.zeros(len(at), np.uint64)
                level_of, group_of = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
                for d, level in enumerate(sent.value):
                    keys = _key(h, s[d][on])
                    level_of[on], group_of[on] = d + 1, np.searchsorted(level.fences, keys, "right") - 1
                    place, there = _among(keys, level.heavy)
                    level_of[on[there]] = 0  # until a longer prefix says where to
                    there &= (s[d + 1][on] > 0) if d + 1 < DEPTH else False
                    on, h = on[there], place[there].astype(np.uint64)
                order = np.lexsort((group_of, level_of))
                order = order[level_of[order] > 0]
                key = _key(level_of[order], group_of[order])
                starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
                for x, y in itertools.pairwise([*starts, len(key)]):
                    own = order[x:y]
                    yield pa.RecordBatch.from_arrays([pa.array([level_of[own[0]]], pa.int32()), pa.array([group_of[own[0]]]), pa.array([b"".join(v[own].astype("<u4").tobytes() for v in s)])], ["level", "group", "data"])

    return blocks.mapInArrow(run, "level int, `group` long, data binary")


def subtree(s: list[np.ndarray], n: np.ndarray, least: int, level: int) -> list[tuple[list[np.ndarray], np.ndarray]]:
    """The nodes of a group's subtrees with at least so many leaves' worth of occurrences: (words, counts) for each depth from two words on. s: suffixes, n: how often each occurs. Groups of level 3 are
    parts of two-word prefixes, whose own counts are known: those nodes aren't given."""
    out, code, words = [], s[0].astype(np.uint64), s[:1]
    on = np.arange(len(n))
    for d in range(1, DEPTH):
        live = s[d][on] > 0
        on, code = on[live], code[live]
        keys, first, back = np.unique(_key(code, s[d][on]), return_index=True, return_inverse=True)
        total = np.bincount(back, n[on], minlength=len(keys)).astype(np.int64)
        words = s[: d + 1]
        many = (total >= least) | (d + 1 < level)
        if d + 1 >= level:
            at = on[first[many]]
            out.append(([w[at] for w in words], total[many]))
        live = many[back]
        on, code = on[live], back[live].astype(np.uint64)
    return out


PHRASES = "w1 long, w2 long, w3 long, w4 long, f long"
_W = ["w1", "w2", "w3", "w4"]


def _phrases(nodes: list[tuple[list[np.ndarray], np.ndarray]]):
    for words, f in nodes:
        cols = [pa.array(w.astype(np.int64)) for w in words]
        cols += [pa.array(np.zeros(len(f), np.int64))] * (DEPTH - len(words))
        yield pa.RecordBatch.from_arrays([*cols, pa.array(f)], [*_W, "f"])


def counted(blocks: DataFrame, words: DataFrame, least: int, budget: int) -> DataFrame:
    """PHRASES: all phrases of 2 to DEPTH words with at least so many occurrences. words: (id, f)."""
    spark = blocks.sparkSession
    levels, known, prefixes = [], [], [()]
    counts, temporary, last = words.select(F.lit(0).cast("long").alias("h"), F.col("id").alias("x"), "f"), [], None
    for d in range(1, DEPTH):
        level, heavy = deal(counts, budget)
        prefixes = [(*prefixes[int(k) >> 32], int(k) & 0xFFFFFFFF) for k in level.heavy]  # in the order of their numbers
        if d > 1:
            known += [(*p, *[0] * (DEPTH - d), heavy[int(k)]) for p, k in zip(prefixes, level.heavy, strict=True)]
        levels.append(level)
        if not heavy:
            break
        counts = keep(extended(blocks, levels), "phrase-prefixes")
        temporary.append(counts)
        last = d
    found = spark.createDataFrame(known, PHRASES) if known else None
    if last == DEPTH - 1:  # prefixes of three words above the budget: with one word more they are whole phrases
        own = spark.createDataFrame([(i, *p) for i, p in enumerate(prefixes)], f"h long, {', '.join(f'{w} long' for w in _W[:-1])}")
        whole = counts.where(F.col("f") >= least).join(F.broadcast(own), "h").select(*_W[:-1], F.col("x").alias("w4"), "f")
        found = found.unionByName(whole) if found is not None else whole

    def run(key, table):
        parts = [np.frombuffer(x.as_buffer(), "<u4").reshape(DEPTH + 1, -1) for chunk in table.column("data").chunks for x in chunk]
        s = np.concatenate(parts, axis=1)
        return pa.Table.from_batches(list(_phrases(subtree(list(s[:DEPTH]), s[DEPTH], least, key[0].as_py()))))

    trees = routed(blocks, levels).groupBy("level", "group").applyInArrow(run, PHRASES)
    out = keep(trees if found is None else trees.unionByName(found), "phrases")
    forget(*temporary)
    return out


def _ids(*names: str | None):
    return F.struct(*(F.lit(0).cast("long").alias(w) if n is None else F.col(n).alias(w) for w, n in zip(_W, names, strict=True)))


def scored(phrases: DataFrame, words: DataFrame, cover: int) -> DataFrame:
    """PHRASES with l, r and score of their lowest-scoring cut, without those that a longer one covers. Sums and products are decimals: they may pass 64 bits."""
    every = phrases.unionByName(words.select(F.col("id").alias("w1"), *(F.lit(0).cast("long").alias(w) for w in _W[1:]), "f"))
    of = lambda c: every.select(F.struct(*_W).alias(c), F.col("f").alias(f"{c}_f"))
    a, b, c, d = _W
    cut = lambda k, left, right: F.struct(F.lit(k).alias("k"), left.alias("left"), right.alias("right"))
    cuts = F.array(
        cut(1, _ids(a, None, None, None), _ids(b, c, d, None)),
        F.when(F.col(c) > 0, cut(2, _ids(a, b, None, None), _ids(c, d, None, None))),
        F.when(F.col(d) > 0, cut(3, _ids(a, b, c, None), _ids(d, None, None, None))),
    )
    p = phrases.select(F.struct(*_W).alias("own"), "f", F.explode(F.array_compact(cuts)).alias("cut")).select("own", "f", "cut.*")
    p = p.join(of("left"), "left").join(of("right"), "right")
    wide = lambda x, n: F.col(x).cast(f"decimal({n},0)")
    p = p.withColumn("score", F.expr("(2000000bd * cast(f as decimal(20,0))) div (cast(left_f as decimal(20,0)) + cast(right_f as decimal(20,0)))"))
    best = p.groupBy("own").agg(F.first("f").alias("f"), F.min(F.struct("score", "k", F.col("left_f").alias("l"), F.col("right_f").alias("r"))).alias("best"))
    inner = F.when(F.col(d) > 0, F.array(_ids(a, b, None, None), _ids(b, c, None, None), _ids(c, d, None, None), _ids(a, b, c, None), _ids(b, c, d, None))).otherwise(F.array(_ids(a, b, None, None), _ids(b, c, None, None)))
    longer = phrases.where(F.col(c) > 0).select(F.explode(inner).alias("own"), "f").groupBy("own").agg(F.max("f").alias("longest"))
    kept = best.join(longer, "own", "left").where(F.col("longest").isNull() | (F.lit(100).cast("decimal(3,0)") * wide("longest", 20) < F.lit(cover).cast("decimal(3,0)") * wide("f", 20)))
    return kept.select("own.*", "f", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, cover: int = 80, text_col: str = "text", lang_col: str = "lang", budget: int = BUDGET, block: int = BLOCK) -> DataFrame:
    """RESULT: the best phrases of each language. Texts are lower-cased (A-Z), cut into pieces at `.,;:!?` and line breaks and those into words at blanks and tabs. Candidates are phrases of 2 to 4 words
    that occur at least `least` times in their language; a phrase's score is the lowest of its cuts, and one of which a longer candidate has at least `cover` percent of the occurrences is dropped.

    Null texts have no words; null languages are `und`, as is a language of that name. Rows that repeat count again; ids and further columns don't matter. Equal scores go by count, then by the
    phrase's bytes. Empty tables, and tables without a phrase that is common enough, give no rows. budget: suffixes that a group holds in memory; block: bytes of text that a task cuts into words at once.
    """
    blocks = keep(blocks_of(docs, text_col, lang_col, block), "phrase-blocks", compression="zstd")
    words = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))
    frequent = keep(words.where(F.col("f") >= least), "phrase-words")
    known = keep(numbered(frequent), "phrase-numbers")
    totals = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    n, most = known.agg(F.sum("f"), F.max("id")).first()
    if most is not None and most >= 1 << 32:
        raise ValueError("more than 2^32 - 1 words are frequent: raise `least`")
    codes = keep(coded(blocks, known), "phrase-codes", compression="zstd")
    phrases = counted(codes, known.select("id", "f"), least, max(budget, -(-(n or 0) // GROUPS)))
    out = keep(ranked(scored(phrases, known, cover), known, totals, top), "collocations")
    forget(blocks, frequent, known, codes, phrases)
    return out


#: Shares that a language's phrases are dealt into before they are ranked: the last ranking has so many times the wanted number at most.
SHARES = 256


def ranked(phrases: DataFrame, words: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """RESULT of scored phrases. Each share of a language gives its best, and these are ranked. Only those that may be among them get their words."""
    p = phrases.join(words.select("lang", F.col("id").alias("w1")), "w1").withColumn("share", F.pmod(F.xxhash64(*_W), F.lit(SHARES)))
    best, share = [F.desc("score"), F.desc("f")], Window.partitionBy("lang", "share")
    p = p.withColumn("place", F.rank().over(share.orderBy(*best))).where(F.col("place") <= top)
    spelled = p.select(*_W, F.posexplode(F.array_remove(F.array(*_W), 0)).alias("pos", "id")).join(words.select("id", "word"), "id").groupBy(*_W).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    p = p.join(spelled, _W)
    p = p.withColumn("place", F.row_number().over(share.orderBy(*best, "phrase"))).where(F.col("place") <= top)
    p = p.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best, "phrase")).cast("long")).where(F.col("rank") <= top)
    return p.join(totals, "lang").select("lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
