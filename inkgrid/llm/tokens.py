"""Token ids as flat binary files, in ascending id order of the documents.

A shard is three files: `<name>.ids` has the token ids of its documents as little-endian unsigned integers without gaps,
`<name>.off` has n + 1 unsigned 64-bit offsets into it, counted in ids, and `<name>.doc` has the n document ids. All can be
mapped into memory. A manifest (Parquet) names the shards in order, with the number of documents and ids before each: prefix
sums, so that a global position is a shard's base plus a local offset.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from inkgrid.llm.common import in_parts, workspace

#: Words that a worker knows, in each of two turns, and their length at most.
KNOWN, KNOWN_LENGTH = 250_000, 64
#: What texts that are cut at each blank and line break may not have: other than visible characters (ASCII or Latin letters, which no kind of white space is) and these
#: two, and these two beside each other.
_OTHER = re.compile("[^\n -~\u00c0-\u024f]")
_BESIDE = ("  ", "\n\n", " \n", "\n ")
#: Elsewhere, where a blank, or a line break, stands alone between visible characters.
_CUT = re.compile("(?<=[!-~\u00c0-\u024f])(?=[ \n][!-~\u00c0-\u024f])|(?<=[!-~\u00c0-\u024f]\n)(?=[!-~\u00c0-\u024f])")
#: A word that the byte-level pre-tokenizer takes as one, and one with a run of marks behind it, which that takes on its own (an apostrophe may start a contraction).
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"
_WORD, _MARKED = re.compile(_LETTERS), re.compile(f"({_LETTERS})([!-&(-/:-@\\[-`{{-~]+)")

SHARD = "shard int, name string, n_docs long, n_ids long"


def byte_order(width: int) -> np.dtype:
    return np.dtype(f"<u{width}")


def _byte_letters() -> dict[int, str]:
    """The letters that a byte-level BPE writes bytes as: printable Latin-1 as itself, the others from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Token ids of whole texts, by the tokenizers library.

    Equal pieces of texts are encoded once, if the loaded tokenizer proves that cutting there changes nothing: it has no normaliser, its pre-tokenizer is the
    byte-level one with its own pattern and without a prefix, and its added tokens take no white space with them. That pattern never joins a blank to
    what stands before it, and takes a line break alone, where visible characters stand on both sides, and it never joins marks to letters before them; so these are the
    only places where a text is cut. Words go straight to the library's model, others through all of it. Texts with an added token in them, and
    all texts of any other tokenizer, go through the library whole.
    """

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), {2: "H", 4: "I"}[width]
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        spec = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.cuts = _may_cut(spec)
        #: Ids of a blank and a word, by the word, and of other pieces as they are. Two turns of the former: the last ones met, and those of the turn before.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, w: str) -> bytes:
        """A blank and a word."""
        found = self.older.get(w)
        if found is None:
            if _WORD.fullmatch(w):
                own = f"\u0120{w}" if w.isascii() else f" {w}".encode().decode("latin-1").translate(self.letters)
                found = array(self.kind, [t.id for t in self.model.tokenize(own)]).tobytes()
            elif m := _MARKED.fullmatch(w):
                found = (self.known.get(m[1]) or self.word(m[1])) + self.piece(m[2])
            else:
                found = self.whole(" " + w)
        if len(w) <= KNOWN_LENGTH:
            if len(self.known) >= KNOWN:
                self.known, self.older = {}, self.known
            self.known[w] = found
        return found

    def piece(self, p: str) -> bytes:
        """A piece as it is."""
        found = self.plain.get(p)
        if found is None:
            found = self.whole(p)
            if len(p) <= KNOWN_LENGTH:
                if len(self.plain) >= KNOWN // 4:
                    self.plain = {}
                self.plain[p] = found
        return found

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.cuts or any(t in text for t in self.added):
            return self.whole(text)
        if _OTHER.search(text) or any(x in text for x in _BESIDE) or text[0] in " \n" or text[-1] in " \n":
            return b"".join([self.piece(p) for p in _CUT.split(text)])
        out, end, word = [], self.piece("\n"), self.word
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            known = self.known.get
            out.append(self.piece(first))
            out += [known(w) or word(w) for w in rest]
            out.append(end)
        return b"".join(out[:-1])


def _may_cut(spec: dict) -> bool:
    """Whether a tokenizer (as its file describes it) gives the same ids for a text and for its pieces as _CUT cuts them."""
    pre, post, model = spec.get("pre_tokenizer") or {}, spec.get("post_processor"), spec["model"]
    return (
        pre.get("type") == "ByteLevel" and pre.get("use_regex") is True and pre.get("add_prefix_space") is False and spec.get("normalizer") is None and (post is None or post["type"] == "ByteLevel")
        and not spec.get("truncation") and not spec.get("padding") and model["type"] == "BPE" and not model.get("dropout") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
    )


@functools.cache
def encoder(path: str, width: int) -> Encoder:
    """One for each worker, which keeps it from task to task."""
    return Encoder(path, width)


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", out: str | None = None, width: int = 2) -> str:
    """Writes all documents, each followed by end_id, and returns the folder. width: bytes of an id, 2 for vocabularies of up to
    65,536 entries, else 4.

    Null and empty texts have the end id alone. Rows that repeat are written as often; of equal ids the order is that of a hash
    of the text; null ids come first and are stored as the smallest 64-bit integer. An empty table gives a manifest without rows.
    A task names its files anew at each attempt, and the manifest has those of the attempts that Spark committed.
    """
    spark = docs.sparkSession
    out = out or workspace(spark, "tokens")

    def run(batches):
        k, name = TaskContext.get().partitionId(), f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        batches = in_parts(batches)
        if (first := next(batches, None)) is None:
            return
        encode, end = encoder(tokenizer_path, width), np.array([end_id], byte_order(width)).tobytes()
        fs, root = pafs.FileSystem.from_uri(out)
        fs.create_dir(f"{root}/data", recursive=True)
        n = total = 0
        with fs.open_output_stream(f"{root}/data/{name}.ids") as ids, fs.open_output_stream(f"{root}/data/{name}.off") as off, fs.open_output_stream(f"{root}/data/{name}.doc") as doc:
            off.write(np.zeros(1, "<u8").tobytes())
            for b in itertools.chain([first], batches):
                sizes = []
                for i in range(b.num_rows):
                    got = encode(b.column(1)[i].as_py()) + end
                    ids.write(got)
                    sizes.append(len(got) // width)
                off.write((total + np.cumsum(sizes)).astype("<u8").tobytes())
                doc.write(b.column(0).fill_null(-(1 << 63)).to_numpy().astype("<i8").tobytes())
                n, total = n + len(sizes), total + sum(sizes)
        yield pa.RecordBatch.from_pydict({"shard": [k], "name": [name], "n_docs": [n], "n_ids": [total]}, pa.schema({"shard": pa.int32(), "name": pa.string(), "n_docs": pa.int64(), "n_ids": pa.int64()}))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, "id", "h").sortWithinPartitions("id", "h").select("id", "text").mapInArrow(run, SHARD).write.parquet(f"{out}/shards")
    up = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = spark.read.schema(SHARD).parquet(f"{out}/shards")
    bases = [F.coalesce(F.sum(c).over(up), F.lit(0)).cast("long").alias(b) for c, b in (("n_docs", "doc_base"), ("n_ids", "id_base"))]
    shards.select("*", *bases, F.lit(width).alias("width")).coalesce(1).write.parquet(f"{out}/manifest")
    return out


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")


def open_shard(path: str, name: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, offsets, token ids) of one shard: mapped into memory where the files are local, else read."""
    fs, root = pafs.FileSystem.from_uri(path)
    found = []
    for end, kind in (("doc", "<i8"), ("off", "<u8"), ("ids", byte_order(width))):
        file = f"{root}/data/{name}.{end}"
        if isinstance(fs, pafs.LocalFileSystem):
            found.append(np.memmap(file, kind, "r") if fs.get_file_info(file).size else np.zeros(0, kind))
        else:
            with fs.open_input_file(file) as f:
                found.append(np.frombuffer(f.read(), kind))
    return tuple(found)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), a row for each document, from the files: start is the number of ids before it in the
    whole set; the checksum is over its ids as little-endian unsigned 32-bit integers.

    Rows written with a null id come back with one, rows that were repeated as often as they were written; a set of an empty table has no rows."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                docs, off, ids = open_shard(path, r["name"], r["width"])
                for at in range(0, len(docs), 10_000):
                    own = off[at : min(len(docs), at + 10_000) + 1].astype(np.int64)
                    crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in itertools.pairwise(own)]
                    d = docs[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.asarray(d), mask=np.asarray(d) == -(1 << 63)), pa.array(own[:-1] + r["id_base"]), pa.array(np.diff(own)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                    )

    shards = manifest(spark, path)
    return shards.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
