import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkgrid.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)


PARTS = [" ", "  ", "\n", "\n\n", "\t", "\u0085", "\x1c", "\u00a0", "word", "Äpfel", "é", "it's", "'", "don't", ",", ".", "!!", "x%%", "Ö&&.", "×", "12", "<|endoftext|>", "<|", "日本", "e\u0301", " a", "B\n", "ǀ"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_any_text(text):
    for width in (2, 4):
        got = np.frombuffer(tokens.encoder(PATH, width)(text), tokens.byte_order(width)).tolist()
        assert got == WHOLE.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("space", ["", " ", "\n", "\n\n", "\n\n\n", " \n", "\n ", "\t", "  "])
def test_white_space_around_added_tokens(space):
    for text in (f"a{space}<|endoftext|>b", f"a<|endoftext|>{space}b", f"a{space}<|endoftext|>{space}<|endoftext|>", f"{space}<|endoftext|>"):
        assert np.frombuffer(tokens.encoder(PATH, 2)(text), "<u2").tolist() == WHOLE.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokens.encoder(PATH, 2)("a\n\n<|endoftext|>b"), "<u2").tolist() == [64, 628, 50256, 65]


def test_another_tokenizer_gets_whole_texts():
    """This one has a normaliser and other pre-tokenizers: no text is cut."""
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, e = Tokenizer.from_file(path), tokens.Encoder(path, 2)
    assert not e.cuts and tokens.Encoder(PATH, 2).cuts
    rng = random.Random(2)
    for text in ["", "Hello, World  again\n\nnow", *("".join(rng.choice(PARTS) for _ in range(9)) for _ in range(300))]:
        assert np.frombuffer(e(text), "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_small_tables_and_long_texts(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN", 8)
    e = tokens.Encoder(PATH, 2)
    for text in (" ".join(f"w{i % 20}x," for i in range(500)), "a  b " * 60_000, " ".join("abcdefghij"[i % 7 :] + "!" * (i % 3) for i in range(300))):
        assert np.frombuffer(e(text), "<u2").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_round_trip(spark, odd, none):
    path = tokens.write_tokens(odd, PATH)
    got = tokens.read_tokens(spark, path).orderBy("start").collect()
    assert len(got) == odd.count()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: -1 if x is None else x)
    want = sorted((r["doc_id"] or -1, len(x := [*WHOLE.encode(r["text"] or "", add_special_tokens=False).ids, 0]), zlib.crc32(np.array(x, "<u4").tobytes())) for r in odd.collect())
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    empty = tokens.write_tokens(none, PATH)
    assert tokens.read_tokens(spark, empty).count() == 0


@pytest.mark.parametrize("width", [2, 4])
def test_files(spark, width):
    docs = spark.createDataFrame([(3, "a b"), (1, "c"), (2, None)], "doc_id long, text string")
    path = tokens.write_tokens(docs, PATH, end_id=0, width=width)
    at = 0
    for r in tokens.manifest(spark, path).orderBy("shard").collect():
        doc, off, ids = tokens.open_shard(path, r["name"], width)
        assert r["id_base"] == at and off[0] == 0 and off[-1] == len(ids) == r["n_ids"] and len(doc) == r["n_docs"] == len(off) - 1
        at += len(ids)
