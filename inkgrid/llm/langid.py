"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary gives the pieces (byte strings; every single byte is one). Each language has a probability for every
piece, and a word's likelihood is the sum over all ways to cut it into pieces of the product of their probabilities: a forward
pass over its bytes. A text's log likelihood is the sum over its words. The probabilities are learned by expectation
maximisation (forward and backward passes) over the words of labelled documents.
"""

from __future__ import annotations

import base64
import functools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.llm.common import forget, in_parts, keep

#: Words that a worker remembers, and their bytes at most; it starts anew beyond that, and scores longer words each time.
KNOWN, KNOWN_BYTES = 250_000, 128
#: Numbers that are held at once for the sums over segmentations.
CELLS = 4_000_000
#: A multiplier for rolling hashes: the 64-bit golden ratio, a fixed value.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Sums below this are scaled up by its inverse, so that words of any length have a likelihood.
TINY = 1e-100


def pieces(path: str) -> list[bytes]:
    """The vocabulary's pieces and all single bytes, in a fixed order."""
    with open(path, "rb") as f:
        own = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
    return sorted({p for p in own if p} | {bytes([b]) for b in range(256)})


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words, each with a blank before it."""
    return [b" " + w for w in (text or "").lower().encode("utf-8", "replace").split()]


class Lattice:
    """All pieces in many words at once. The prefixes of pieces are found by a rolling hash, so a piece is only looked for as long as some piece begins that way."""

    def __init__(self, vocabulary: list[bytes]):
        self.longest = max(map(len, vocabulary))
        self.size = len(vocabulary)
        n, h = np.array([len(p) for p in vocabulary]), np.zeros(len(vocabulary), np.uint64)
        at = np.r_[0, np.cumsum(n)[:-1]]
        flat = np.frombuffer(b"".join(vocabulary), np.uint8).astype(np.uint64)
        keys, piece = [], []
        for k in range(self.longest):
            own = np.flatnonzero(n > k)
            h[own] = self._next(h[own], flat[at[own] + k])
            keys.append(h[own])
            piece.append(np.where(n[own] == k + 1, own, -1))
        keys, piece = np.concatenate(keys), np.concatenate(piece)
        order = np.lexsort((-piece, keys))  # of equal prefixes, the one that is a piece comes first
        first = np.r_[True, keys[order][1:] != keys[order][:-1]]
        keys, piece = keys[order][first], piece[order][first]
        assert len(keys) == len({p[:k] for p in vocabulary for k in range(1, len(p) + 1)}), "two prefixes have the same hash"
        self.bits = 20
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)  # keys are sorted, so slots are
        self.keys, self.ids = keys, piece.astype(np.int32)
        self.first = np.searchsorted(slot, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.deep = int(np.diff(self.first).max())

    @staticmethod
    def _next(h, c):
        with np.errstate(over="ignore"):
            h = (h ^ (c + np.uint64(1))) * MULTIPLIER
            return h ^ (h >> np.uint64(29))

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash among the prefixes, or -1."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        out = np.full(len(h), -1, np.int32)
        for k in range(self.deep):
            live = np.flatnonzero(at + k < end)
            if not len(live):
                break
            hit = live[self.keys[at[live] + k] == h[live]]
            out[hit] = at[hit] + k
        return out

    def edges(self, words: list[bytes]):
        """For each start i, in order: i and a list of (length, rows of words, pieces)."""
        n = np.array([len(w) for w in words])
        wide = int(n.max(initial=0))
        c = np.zeros((len(words), wide), np.uint8)
        c[np.arange(wide)[None, :] < n[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        for i in range(wide):
            rows, found = np.flatnonzero(n > i), []
            h = np.zeros(len(rows), np.uint64)
            for k in range(1, self.longest + 1):
                h = self._next(h, c[rows, i + k - 1].astype(np.uint64))
                place = self._find(h)
                ids = np.where(place >= 0, self.ids[place], -1)
                hit = ids >= 0
                if hit.any():
                    found.append((k, rows[hit], ids[hit]))
                on = (place >= 0) & (n[rows] > i + k)
                rows, h = rows[on], h[on]
                if not len(rows):
                    break
            yield i, found

    def likelihoods(self, words: list[bytes], p: np.ndarray) -> np.ndarray:
        """p: (pieces, languages). The logarithm of the sum over all segmentations of each word, (words, languages)."""
        out = np.zeros((len(words), p.shape[1]))
        for own in _parts(words, p.shape[1], self.longest):
            out[own] = self._band([words[i] for i in own], p)
        return out

    def _band(self, words: list[bytes], p: np.ndarray) -> np.ndarray:
        """A forward pass that holds as many places as the longest piece has bytes."""
        n = np.array([len(w) for w in words])
        size = min(self.longest, int(n.max(initial=0))) + 1
        a, log, out = np.zeros((size, len(words), p.shape[1])), np.zeros((len(words), p.shape[1])), np.zeros((len(words), p.shape[1]))
        a[0] = 1
        for i, found in self.edges(words):
            now = a[i % size]
            small = (now < TINY) & (now > 0)
            if small.any():
                a[:, small] /= TINY
                log[small] += np.log(TINY)
            for k, rows, ids in found:  # rows are all different
                a[(i + k) % size, rows] += now[rows] * p[ids]
            now[:] = 0
            done = n == i + 1
            if done.any():
                out[done] = np.log(np.maximum(a[(i + 1) % size, done], 1e-300)) + log[done]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected counts of pieces, (pieces, languages); counts: (words, languages)."""
        out = np.zeros_like(p)
        for own in _parts(words, p.shape[1], None):
            self._both([words[i] for i in own], counts[own], p, out)
        return out

    def _both(self, words: list[bytes], counts: np.ndarray, p: np.ndarray, out: np.ndarray) -> None:
        """Forward and backward passes. The sums at a place are a x TINY**e and b x TINY**f."""
        n, each = np.array([len(w) for w in words]), np.arange(len(words))
        shape = (int(n.max(initial=0)) + 1, len(words), p.shape[1])
        a, b, e, f = np.zeros(shape), np.zeros(shape), np.zeros(shape, np.int16), np.zeros(shape, np.int16)
        a[0] = 1
        edges = []
        for i, found in self.edges(words):
            small = (a[i] < TINY) & (a[i] > 0)
            if small.any():
                a[i:, small] /= TINY
                e[i:, small] += 1
            for k, rows, ids in found:
                a[i + k, rows] += a[i, rows] * p[ids]
            edges.append((i, found))
        b[n, each] = 1
        z, last = a[n, each], e[n, each]
        share = np.divide(counts, z, out=np.zeros_like(z), where=z > 0)
        for i, found in reversed(edges):
            for k, rows, ids in found:
                step = p[ids] * b[i + k, rows]
                if e.any() or f.any():
                    over = np.clip(e[i, rows] + f[i + k, rows] - last[rows], -3, 3).astype(float)
                    np.add.at(out, ids, a[i, rows] * step * share[rows] * TINY**over)
                    b[i, rows] += step * TINY ** (f[i + k, rows] - f[i, rows]).astype(float)
                else:
                    np.add.at(out, ids, a[i, rows] * step * share[rows])
                    b[i, rows] += step
            small = (b[i] < TINY) & (b[i] > 0)
            if small.any():
                b[: i + 1, small] /= TINY
                f[: i + 1, small] += 1


def _parts(words: list[bytes], langs: int, longest: int | None):
    """Places of words of about the same length, as many as CELLS has room for: the whole word, or as many places as the longest piece has."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and end - at < 8192:
            wide = len(words[order[end]])
            if (min(wide, longest) if longest else wide) * max(langs, 1) * (end - at) > CELLS:
                break
            end += 1
        yield order[at:end]
        at = end


@functools.cache
def lattice_of(path: str) -> Lattice:
    """One for each worker, which keeps it from task to task."""
    return Lattice(pieces(path))


def remainder(id_col: str) -> F.Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


class Model:
    """The languages, and (pieces, languages) probabilities over the vocabulary at `path`."""

    def __init__(self, path: str, langs: list[str], p: np.ndarray, left_out: int = 0):
        self.path, self.langs, self.p, self.left_out = path, langs, p, left_out

    def scorer(self):
        """A function from texts to their (language, score)s. New words of many texts go through the lattice together."""
        lattice, p, langs, known, table = lattice_of(self.path), self.p, self.langs, {}, np.zeros((KNOWN, len(self.langs)), np.float32)

        def some(texts: list[str | None]) -> list[tuple[str, float]]:
            out: list[tuple[str, float]] = []
            todo = [words_of(t) if langs and t and any(map(str.isalpha, t)) else [] for t in texts]
            long = [[w for w in words if len(w) > KNOWN_BYTES] for words in todo]
            short = [[w for w in words if len(w) <= KNOWN_BYTES] if far else words for words, far in zip(todo, long, strict=True)]
            totals = np.zeros((len(texts), len(langs)))
            for i, start in [(i, start) for i, words in enumerate(short) for start in range(0, len(words), KNOWN // 2)]:
                part = short[i][start : start + KNOWN // 2]
                if not known.keys() >= (own := set(part)):
                    ahead = own.union(*(w for w in short[i + 1 :] if len(w) < 10_000)) if len(own) < 10_000 else own
                    new = [*(ahead - known.keys())]
                    if len(known) + len(new) > KNOWN:
                        known.clear()
                        new = [*(ahead if len(ahead) <= KNOWN else own)]
                    table[len(known) : len(known) + len(new)] = lattice.likelihoods(new, p)
                    known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                totals[i] += table[[known[w] for w in part]].sum(axis=0, dtype=np.float64)
            for i, words in enumerate(long):
                if words:
                    totals[i] += lattice.likelihoods(words, p).sum(axis=0)
            for words, total in zip(todo, totals, strict=True):
                best = int(total.argmax()) if words else 0
                out.append((langs[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())) if words else ("und", 0.0))
            return out

        def score(texts: list[str | None]) -> list[tuple[str, float]]:
            out, at = [], 0
            while at < len(texts):  # about two million characters at a time
                end, size = at, 0
                while end < len(texts) and (end == at or size < 2_000_000):
                    size += len(texts[end] or "")
                    end += 1
                out += some(texts[at:end])
                at = end
            return out

        return score


def train(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 1500, max_langs: int = 200, rounds: int = 3) -> Model:
    """Learns from rows with a non-null label. Of each language about `max_docs` documents are taken, chosen by a hash of the id, and
    of the languages the `max_langs` most frequent (the model's left_out says how many labels are not learned): bounds of the sample for fitting; all documents are scored.

    Null texts and null labels teach nothing, repeated rows count each; without labels the model has no language."""
    spark = docs.sparkSession
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = labelled.groupBy("lang").count()
    found, every = counts.orderBy(F.desc("count"), "lang").limit(max_langs).collect(), counts.count()
    langs = sorted(r["lang"] for r in found)
    if not langs:
        return Model(vocabulary, [], np.zeros((1, 0)))
    u = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(1_000_000))
    chosen = None
    for r in found:
        one = (F.col("lang") == r["lang"]) & (u < int(1_000_000 * min(1.0, max_docs / r["count"])) + 1)
        chosen = one if chosen is None else chosen | one

    def count(batches):
        for b in in_parts(batches, 1000):
            seen: dict[str, Counter] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words_of(text))
            rows = [(w, langs.index(k), n) for k, c in seen.items() for w, n in c.items()]
            yield pa.RecordBatch.from_pydict(dict(zip(("word", "k", "n"), map(list, zip(*rows)), strict=True)) if rows else {"word": [], "k": [], "n": []}, pa.schema({"word": pa.binary(), "k": pa.int32(), "n": pa.int64()}))

    types = labelled.where(chosen).select("text", "lang").mapInArrow(count, "word binary, k int, n long").groupBy("word", "k").agg(F.sum("n").alias("n"))
    types = keep(types, "langid-words")
    size = len(pieces(vocabulary))
    p = np.full((size, len(langs)), 1.0 / size)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(p)

        def step(batches, shared=shared):
            p = shared.value
            lattice, total = lattice_of(vocabulary), np.zeros_like(p)
            for b in in_parts(batches, 10_000):
                words, k, n = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).to_numpy()
                counts = np.zeros((len(words), p.shape[1]))
                counts[np.arange(len(words)), k] = n
                total += lattice.expected(words, counts, p)
            piece, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(total[piece, k])], ["piece", "k", "n"])

        sums = types.mapInArrow(step, "piece int, k int, n double").groupBy("piece", "k").agg(F.sum("n").alias("n")).toPandas()  # at most pieces x languages
        counts = np.zeros_like(p)
        counts[sums["piece"], sums["k"]] = sums["n"]
        shared.destroy()
        common = counts.sum(axis=1, keepdims=True) + 0.5
        counts += 20 * common / common.sum()  # pieces that a language lacks get what all languages have, scaled down
        counts += 0.01
        p = counts / counts.sum(axis=0)
    forget(types)
    return Model(vocabulary, langs, p, every - len(langs))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score), a row for each row of docs: the language with the highest likelihood of the whole text, and its share
    of the likelihoods of all.

    A text that is null or has no letter is `und` with score 0, as is every text if the model has no language; ties go to the first
    language by code point. Repeated rows get the same answer each; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.path, model.langs, model.p.astype(np.float32)))  # pieces x languages: fixed by the vocabulary

    def run(batches):
        path, langs, p = shared.value
        score = Model(path, langs, p.astype(np.float64)).scorer()
        for b in in_parts(batches, 1000):
            found = score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["id", "lang_pred", "score"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def accept(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text has a language: not `und`, and a score of at least `least`. Null and empty texts and those without letters are left
    out, as are all rows if the model has no language; repeated rows stay or go together."""
    shared, at = docs.sparkSession.sparkContext.broadcast((model.path, model.langs, model.p.astype(np.float32))), docs.columns.index(text_col)

    def run(batches):
        path, langs, p = shared.value
        score = Model(path, langs, p.astype(np.float64)).scorer()
        for b in in_parts(batches, 1000):
            found = score(b.column(at).to_pylist())
            yield b.filter(pa.array([lang != "und" and x >= least for lang, x in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
