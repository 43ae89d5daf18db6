"""Benchmark decontamination: an Aho-Corasick automaton over windows of normalised test items scans each text once.

Texts are lower-cased (A-Z) and cut into words of ASCII letters, digits and all characters beyond ASCII; a window is some consecutive
words of an item. Texts and windows are scanned as words between single blanks; hits are mapped back to words, and to
characters of the original.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.llm.common import in_parts, keep

#: Nodes of one automaton at most (a byte of a window makes one, of about a hundred bytes in memory); larger benchmarks are scanned for in several passes.
AUTOMATON_NODES = 3_000_000
_TABLE = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


#: SQL: places of words, sorted, as spans of runs of neighbouring words.
_RUNS = """aggregate(places, struct(cast(array() AS array<struct<start:int,end:int>>) AS runs, -2 AS word, 0 AS start, 0 AS end),
 (s, w) -> if(w.word = s.word + 1, struct(s.runs AS runs, w.word AS word, s.start AS start, w.end AS end), struct(if(s.word >= 0, array_append(s.runs, struct(s.start AS start, s.end AS end)), s.runs) AS runs, w.word AS word, w.start AS start, w.end AS end)),
 s -> if(s.word >= 0, array_append(s.runs, struct(s.start AS start, s.end AS end)), s.runs))"""


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).lower().split()


def windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = 10) -> DataFrame:
    """(window, items): each window as words between single blanks, and the sorted ids (as strings) of the items that have it."""

    def run(batches):
        for b in in_parts(batches, 1000):
            found = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words_of(text)
                found += [(item, b" ".join(w[i : i + width])) for i in range(max(1, len(w) - width + 1)) if w]
            yield pa.RecordBatch.from_pydict({"item": [x for x, _ in found], "window": [x for _, x in found]}, pa.schema({"item": pa.string(), "window": pa.binary()}))

    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).mapInArrow(run, "item string, window binary")
    return rows.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


class Scanner:
    """Finds windows in texts. windows: (window, items) pairs."""

    def __init__(self, windows: list[tuple[bytes, list[str]]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for window, items in windows:
            self.automaton.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, items))
        self.any = len(windows) > 0
        if self.any:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, which of them are hit (indexes), and the items whose windows occur."""
        words = words_of(text)
        if not words or not self.any:
            return len(words), np.zeros(0, np.int64), set()
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")  # a character for each byte
        found = list(self.automaton.iter(line))
        if not found:
            return len(words), np.zeros(0, np.int64), set()
        blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20)
        last = np.searchsorted(blanks, np.array([end for end, _ in found]))  # a window ends with the blank after its last word
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, last - np.array([n for _, (n, _) in found]), 1)
        np.add.at(change, last, -1)
        return len(words), np.flatnonzero(np.cumsum(change[:-1]) > 0), {i for _, (_, items) in found for i in items}


def places(text: str) -> list[tuple[int, int]]:
    """(start, end) of each word in characters of the original text."""
    return [m.span() for m in _WORD.finditer(text)]


def spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as (start, end) in characters of the original text."""
    at = places(text)
    cuts = np.flatnonzero(np.diff(hit) > 1) + 1
    return [(at[run[0]][0], at[run[-1]][1]) for run in np.split(hit, cuts) if len(run)]


def _passes(table: DataFrame) -> tuple[DataFrame, int]:
    """The windows, written so that no pass makes them anew, and how many automata they need."""
    table = keep(table, "decontam-windows")
    nodes = table.agg(F.sum(F.length("window") + 2)).first()[0] or 0
    return table, max(1, -(-int(nodes) // AUTOMATON_NODES))


def _shared(table: DataFrame, passes: int, k: int):
    """A name and the windows of one automaton for all tasks: about AUTOMATON_NODES bytes of windows at most."""
    own = table.where(F.pmod(F.xxhash64("window"), F.lit(passes)) == k) if passes > 1 else table
    return uuid.uuid4().hex, table.sparkSession.sparkContext.broadcast([(bytes(r["window"]), list(r["items"])) for r in own.collect()])


_MADE: dict[str, Scanner] = {}


def scanner(name: str, shared) -> Scanner:
    """A worker makes an automaton once and keeps the last one."""
    if name not in _MADE:
        _MADE.clear()
        _MADE[name] = Scanner(shared.value)
    return _MADE[name]


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10) -> DataFrame:
    """The rows of docs, with all their columns, in which no window occurs. Edge cases as in contamination()."""
    (table, passes), at = _passes(windows(benchmark, item_col, item_text_col, width)), docs.columns.index(text_col)

    def without(rows: DataFrame, k: int) -> DataFrame:
        name, shared = _shared(table, passes, k)

        def run(batches):
            scan = scanner(name, shared)
            for b in in_parts(batches):
                yield b.filter(pa.array([len(scan(t)[1]) == 0 for t in b.column(at).to_pylist()], pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    for k in range(passes):
        docs = without(docs, k)
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10) -> DataFrame:
    """(id, n_words, hit_words, spans, items), a row for each row of docs: its number of words, the indexes of those inside any
    window, their runs as [start, end) in characters of the text, and the sorted ids of items with windows in it.

    Null and empty texts, and texts without words, have nothing; so has every text if the benchmark is empty or null. Items of fewer
    words than `width` are one window. Rows that repeat get the same answer each; further columns are ignored.
    """
    spark = docs.sparkSession
    table, passes = _passes(windows(benchmark, item_col, item_text_col, width))
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, row long, n_words long, hit_words array<int>, spans array<struct<start:int,end:int>>, items array<string>, places array<struct<word:int,start:int,end:int>>"

    def scan(k: int) -> DataFrame:
        name, shared = _shared(table, passes, k)

        def run(batches):
            find = scanner(name, shared)
            for b in in_parts(batches):
                out = {"n_words": [], "hit_words": [], "spans": [], "items": [], "places": []}
                for text in b.column(2).to_pylist():
                    n, hit, items = find(text)
                    out["n_words"].append(n)
                    out["hit_words"].append(hit.astype(np.int32))
                    out["spans"].append([{"start": s, "end": e} for s, e in spans(text, hit)] if len(hit) else [])
                    out["items"].append(sorted(items))
                    at = places(text) if passes > 1 and len(hit) else []
                    out["places"].append([{"word": int(w), "start": at[w][0], "end": at[w][1]} for w in hit] if at else [])
                start_end = {"start": pa.int32(), "end": pa.int32()}
                kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.struct(start_end)), pa.list_(pa.string()), pa.list_(pa.struct({"word": pa.int32()} | start_end)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], ["id", "row", *out])

        return rows.mapInArrow(run, schema)

    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    if passes > 1:
        rows = keep(rows, "decontam-rows")  # all passes must see the same number on a row
    found = scan(0)
    if passes > 1:  # the hit words of all passes are joined, then runs of them
        for k in range(1, passes):
            found = found.unionByName(scan(k))
        both = [F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hit_words", "items", "places")]
        found = found.groupBy("row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), *both).withColumn("spans", F.expr(_RUNS))
    return found.select(F.col("id").alias(id_col), "n_words", "hit_words", "spans", "items")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the contract from those of contamination()."""
    n_hit = F.size("hit_words").cast("long")
    return found.select(
        id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
