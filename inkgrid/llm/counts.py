"""Token counts of whole texts, by the whole-token shortcut.

Which strings are one token is proved once, before any text is read: each entry of the vocabulary is encoded alone by the library, and kept if that gives
this entry and nothing else. A text is then cut into the pieces that the tokenizer's own pre-tokenizer makes; those that are proved count as one, and only the
others go through the library's merges.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.llm.common import in_parts
from inkgrid.llm.tokens import _byte_letters, _may_cut

COUNTS = "doc_id long, n_bytes long, n_tokens long"
#: Pieces beside the proved ones that a worker remembers, and their length at most.
KNOWN, KNOWN_LENGTH = 250_000, 64
#: The letters and other visible characters that texts mostly have. All other characters are asked for at the library.
_L, _SEEN = "A-Za-zÀ-ÖØ-öø-ɏ", "\n\r\t -~À-ɏ"
_UNSEEN = re.compile(f"[^{_SEEN}]")
#: The byte-level pre-tokenizer's pattern (fixed by the format), over that alphabet.
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^ \t\n\r0-9{_L}]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
#: What stands for the characters of a kind outside that alphabet: letter, digit, mark, white space.
_KINDS = "a1!\t"


def prove(path: str) -> dict[str, int]:
    """The strings of a byte-level vocabulary that encode alone as one token, each with 1: {} if the tokenizer isn't of that kind, or may join what its
    pre-tokenizer has cut. At most as many as the vocabulary has entries."""
    if not path.endswith(".json"):
        return {}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    if not _may_cut(json.loads(t.to_str())):
        return {}
    of, found = {letter: b for b, letter in _byte_letters().items()}, {}
    for entry, i in t.get_vocab(with_added_tokens=False).items():
        if all(c in of for c in entry):
            try:
                found[bytes(of[c] for c in entry).decode()] = i
            except UnicodeDecodeError:
                continue  # part of a character: never a whole piece
    texts = list(found)
    return {s: 1 for s, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True) if e.ids == [found[s]]}


class Pieces(dict):
    """Number of tokens of a piece: of the proved ones at hand, of others by the library's merges. What is remembered beside the former is bounded."""

    def __init__(self, tokenizer, proved: dict[str, int]):
        super().__init__(proved)
        self.proved, self.model, self.letters = proved, tokenizer.model, _byte_letters()

    def __missing__(self, piece: str) -> int:
        n = len(self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters)))
        if len(piece) <= KNOWN_LENGTH:
            if len(self) >= len(self.proved) + KNOWN:
                self.clear()
                self.update(self.proved)
            self[piece] = n
        return n


class Counter:
    """n_tokens of texts as the library gives them: tokenizers for .json, sentencepiece for .model. Without proved strings, and for texts with an added token in
    them, by the library itself."""

    def __init__(self, path: str, proved: dict[str, int]):
        if path.endswith(".model"):
            import sentencepiece

            self.spm, self.pieces = sentencepiece.SentencePieceProcessor(model_file=path), None
            return
        from tokenizers import Tokenizer

        self.spm, self.tokenizer = None, Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t["content"] for t in json.loads(self.tokenizer.to_str())["added_tokens"]]
        self.pieces, self.kinds = Pieces(self.tokenizer, proved) if proved else None, {}

    def kind(self, c: str) -> str:
        """What stands for c: the library says with what its pre-tokenizer joins it."""
        if (k := self.kinds.get(c)) is None:
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
            k = self.kinds[c] = next((x for x in _KINDS[:3] if len(cut(x + c + x)) == 1), _KINDS[3])
        return k

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self.spm:
            return len(self.spm.encode(text, num_threads=1))
        if self.pieces is None or any(t in text for t in self.added):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if not _UNSEEN.search(text):
            return sum(map(self.pieces.__getitem__, _PIECES.findall(text)))
        seen = text.translate({ord(c): self.kind(c) for c in set(_UNSEEN.findall(text))})
        return sum(self.pieces[text[m.start() : m.end()]] for m in _PIECES.finditer(seen))


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row: bytes of the text in UTF-8 and its tokens, without begin, end or added special tokens; strings of special tokens in a text count as
    the library counts them by default.

    Null and empty texts have none of either. Rows that repeat, also with null ids, are counted as often; an empty table gives none; further columns are left out.
    Sent to executors is the list of proved strings: no more than the vocabulary has. Texts are counted one by one, whatever their length.
    """
    proved = docs.sparkSession.sparkContext.broadcast(tuple(prove(tokenizer_path)))

    def run(batches):
        n_tokens = own(tokenizer_path, proved)
        for b in in_parts(batches):
            found = [n_tokens(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, COUNTS)


_OWN: dict[str, Counter] = {}


def own(path: str, proved) -> Counter:
    """One for each worker and tokenizer, which keeps it from task to task."""
    if path not in _OWN:
        _OWN[path] = Counter(path, dict.fromkeys(proved.value, 1))
    return _OWN[path]
