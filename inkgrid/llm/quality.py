"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text (counts over the whole text) is binned. The model is an intercept, a lookup table of scores for each
feature's bins, and tables for pairs of features; a text's score is the logistic function of their sum. Tables are learned by
boosting: in turn, each feature gets a small step of a shallow tree over its bins that fits the current gradient. Pairs that
reduce the remaining error most are boosted after that in the same way, by cuts of both features.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.llm.common import in_parts, keep
from inkgrid.llm.langid import remainder

FEATURES = (
    "log_words", "word_length", "upper", "digit", "other_symbol", "pipe", "exclamation", "comma_dot", "high_byte", "distinct_words",
    "line_words", "repeated_lines", "line_ends", "capital_words", "symbol_ends", "short_words", "longest_word", "byte_entropy", "repeated_words",
)
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_PLAIN = [ord(c) for c in " \n\t\r.,;:'\"!?()-|"]
_ENDS = b".!?\"')"


def features(text: str | None) -> list[float]:
    """The features of one whole text; zeros if it is null or has no words."""
    b = (text or "").encode("utf-8", "replace")
    words = b.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    size, letters = len(b), int(n[_UPPER].sum() + n[_LOWER].sum() + n[128:].sum())
    other = int(n[33:127].sum() - n[_UPPER].sum() - n[_LOWER].sum() - n[_DIGIT].sum() - n[[c for c in _PLAIN if c > 32]].sum())
    lines = [x for x in b.split(b"\n") if x.strip()]
    share = n[n > 0] / size
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    last = np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)
    head = np.frombuffer(b"".join([w[:1] for w in words]), np.uint8)
    odd = ((last >= 33) & (last < 48) | (last >= 58) & (last < 65) | (last >= 91) & (last < 97) | (last >= 123) & (last < 127)) & ~np.isin(last, np.frombuffer(b".,", np.uint8))
    return [
        float(np.log1p(len(words))), float(lengths.mean()), n[_UPPER].sum() / max(letters, 1), n[_DIGIT].sum() / size, other / size, n[124] / len(words), n[33] / len(words),
        (n[44] + n[46]) / len(words), n[128:].sum() / size, len(set(words)) / len(words), len(words) / len(lines), 1 - len(set(lines)) / len(lines),
        sum(x.rstrip()[-1:] in _ENDS for x in lines) / len(lines), float(((head >= 65) & (head < 91)).mean()), float(odd.mean()), float((lengths <= 3).mean()),
        float(np.log1p(lengths.max())), float(-(share * np.log2(share)).sum()), sum(map(bytes.__eq__, words, words[1:])) / len(words),
    ]


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, one float column for each feature), a row for each row of docs."""

    def run(batches):
        for b in in_parts(batches):
            x = np.array([features(t) for t in b.column(1).to_pylist()], dtype=np.float32).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x[:, i]) for i in range(len(FEATURES)))], ["id", *FEATURES])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, " + ", ".join(f"{f} float" for f in FEATURES))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, least: float = 2.0) -> np.ndarray:
    """A step for each bin from a tree of few leaves: cuts of the bins' order with the largest gain. g, h: sums by bin."""
    parts = [(0, len(g))]
    value = lambda a, b: g[a:b].sum() / (h[a:b].sum() + 1.0)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            lg, lh, tg, th = cg[:-1], ch[:-1], cg[-1], ch[-1]
            gain = lg**2 / (lh + 1) + (tg - lg) ** 2 / (th - lh + 1) - tg**2 / (th + 1)
            gain[(lh < least * 0.05) | (th - lh < least * 0.05)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (a, b), a + k + 1)
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = value(a, b)
    return out


class Model:
    """Edges of the bins, an intercept, a table for each feature and one for each pair of features (coarser bins)."""

    def __init__(self, edges: list[np.ndarray], coarse: list[np.ndarray], intercept: float, tables: list[np.ndarray], pairs: dict[tuple[int, int], np.ndarray]):
        self.edges, self.coarse, self.intercept, self.tables, self.pairs = edges, coarse, intercept, tables, pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        """x: (rows, features). Adds up what the bins hold."""
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        low = {j: np.searchsorted(self.coarse[j], x[:, j], side="right") for pair in self.pairs for j in pair}
        for (i, j), table in self.pairs.items():
            total += table[low[i], low[j]]
        return _sigmoid(total)


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 150, rate: float = 0.15, pairs: int = 6, pair_rounds: int = 60) -> Model:
    """x: (rows, features), y: 0 or 1. With no rows, or one label only, the model is its intercept."""
    rows, width = x.shape
    cut = lambda v, n: np.unique(np.quantile(v, np.arange(1, n) / n)).astype(np.float32) if len(v) else np.zeros(0, np.float32)
    edges, coarse = [cut(x[:, j], bins) for j in range(width)], [cut(x[:, j], 8) for j in range(width)]
    base = (y.sum() + 0.5) / (rows + 1)
    model = Model(edges, coarse, float(np.log(base / (1 - base))), [np.zeros(len(e) + 1) for e in edges], {})
    if not rows or y.min() == y.max():
        return model
    fine = [np.searchsorted(edges[j], x[:, j], side="right") for j in range(width)]
    total = np.full(rows, model.intercept)
    for _ in range(rounds):
        for j in range(width):
            p = _sigmoid(total)
            step = rate * _tree(np.bincount(fine[j], y - p, len(edges[j]) + 1), np.bincount(fine[j], p * (1 - p), len(edges[j]) + 1))
            model.tables[j] += step
            total += step[fine[j]]
    low = [np.searchsorted(coarse[j], x[:, j], side="right") for j in range(width)]
    cell = lambda i, j: low[i] * (len(coarse[j]) + 1) + low[j]
    p = _sigmoid(total)

    def gain(i: int, j: int) -> float:
        n = (len(coarse[i]) + 1) * (len(coarse[j]) + 1)
        return float((np.bincount(cell(i, j), y - p, n) ** 2 / (np.bincount(cell(i, j), p * (1 - p), n) + 1)).sum())

    chosen = sorted(((gain(i, j), i, j) for i in range(width) for j in range(i + 1, width)), reverse=True)[:pairs]
    for _, i, j in chosen:
        model.pairs[i, j] = np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))
    for _ in range(pair_rounds):
        for (i, j), table in model.pairs.items():
            p = _sigmoid(total)
            g = np.bincount(cell(i, j), y - p, table.size).reshape(table.shape)
            h = np.bincount(cell(i, j), p * (1 - p), table.size).reshape(table.shape)
            # depth two: one cut of the first feature, then one of the second on either side
            side = _tree(g.sum(1), h.sum(1), 2)
            step = np.zeros_like(table)
            for v in np.unique(side):
                step[side == v] = _tree(g[side == v].sum(0), h[side == v].sum(0), 2)
            model.pairs[i, j] = table + rate * step
            total += rate * step[low[i], low[j]]
    return model


def sample(table: DataFrame, labels: DataFrame, id_col: str, label_col: str, max_rows: int) -> DataFrame:
    """Feature rows with their label, one for each id: about `max_rows`, chosen by a hash of the id. Of rows that repeat an id the smallest stand for it, in both tables."""
    labels = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    labels = labels.groupBy("id").agg(F.min("label").alias("label"))
    n = labels.count()
    u = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1_000_000))
    chosen = labels.where(u < int(1_000_000 * min(1.0, max_rows / max(n, 1))) + 1)
    rows = table.join(chosen, "id").groupBy("id").agg(F.min(F.struct(*FEATURES, "label")).alias("x"))
    return rows.select("id", "x.*")


def train(table: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_rows: int = 20_000) -> Model:
    """Fits on feature rows that have a label, about `max_rows` of them by a hash of the id: a bound of the sample for fitting.
    table: of feature_table(). Null ids and labels other than 0 and 1 teach nothing; without labels the model is one half."""
    rows = sample(table, labels, id_col, label_col, max_rows).orderBy("id").toPandas()
    return fit(rows[[*FEATURES]].to_numpy(np.float32).reshape(-1, len(FEATURES)), rows["label"].to_numpy(np.float64))


def score(table: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(id, score, predicted), a row for each row of the feature table; predicted is 1 from the threshold on.

    Null and empty texts have all features zero and are scored like any other; repeated rows get the same score.
    """

    def run(batches):
        for b in batches:
            x = np.stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(FEATURES))], axis=1)
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    return table.mapInArrow(run, f"id {table.schema['id'].dataType.simpleString()}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted), a row for each row of docs. Learns from labels of rows that aren't held out: those whose
    crc32 of the id as text is not a multiple of 5. Null ids are held out. Further columns are ignored; without labels all scores are one half."""
    table = keep(feature_table(docs, id_col, text_col), "quality-features")
    model = train(table, labels.where(remainder(id_col) != 0), id_col)
    held_out = (remainder("id") == 0).alias("held_out")
    return score(table, model, threshold).select(F.col("id").alias(id_col), held_out, "score", "predicted")
