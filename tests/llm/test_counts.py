import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkgrid.llm import counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
PROVED = counts.prove(PATH)
PARTS = [
    " ", "  ", "\n", "\t", "\r", "\u0085", "\x1c", " ", "　", " ", "​", "word", "Äpfel", "é", "é", "it's", "'", "don't", "'LL", "'ll", "’s", ",", ".", "!!", "12", "²", "٣", "½", "<|endoftext|>", "<|",
    "日本", "ǀ", "ᾎ", "😀", "\U0001e900", "\x00", "\x7f", "͸", "×", "÷",
]


@settings(max_examples=800, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.characters(exclude_categories=("Cs",))), max_size=14).map("".join))
def test_any_text(text):
    assert counter()(text) == len(WHOLE.encode(text, add_special_tokens=False).ids)


_COUNTER = []


def counter():
    if not _COUNTER:
        _COUNTER.append(counts.Counter(PATH, PROVED))
    return _COUNTER[0]


def test_proof():
    """What is proved is one token, and the shortcut decides most pieces of common text."""
    assert len(PROVED) > 40_000
    some = random.Random(3).sample(sorted(PROVED), 2000)
    assert all(len(e.ids) == 1 for e in WHOLE.encode_batch(some, add_special_tokens=False))
    assert "<|endoftext|>" not in PROVED and counts.prove(public_tokenizers.path("word_bpe_49k.json")) == {} == counts.prove(public_tokenizers.path("piece_bpe_32k.model"))
    merged = []
    c = counts.Counter(PATH, PROVED)
    c.pieces.model = type("Model", (), {"tokenize": lambda _, x, own=WHOLE.model: merged.append(x) or own.tokenize(x)})()
    assert c("The cat sat on the mat, and it was 1999.") == len(WHOLE.encode("The cat sat on the mat, and it was 1999.", add_special_tokens=False).ids)
    assert merged == []


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(counts, "KNOWN", 5)
    c = counts.Counter(PATH, PROVED)
    text = " ".join(f"zq{i}xv" for i in range(200)) + " " + "y" * 500
    assert c(text) == len(WHOLE.encode(text, add_special_tokens=False).ids) and len(c.pieces) <= len(PROVED) + 6


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_tables(spark, odd, none, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        spm = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lambda t: len(spm.encode(t))
    else:
        whole = Tokenizer.from_file(path)
        n = lambda t: len(whole.encode(t, add_special_tokens=False).ids)
    key = lambda r: (r[0] or -1, *r[1:])
    want = sorted((key((r["doc_id"], len((r["text"] or "").encode()), n(r["text"] or ""))) for r in odd.collect()))
    assert sorted(key(tuple(r)) for r in counts.count_tokens(odd, path).collect()) == want
    assert counts.count_tokens(none, path).collect() == []


def test_registered_query(spark):
    from inkgrid.llm.queries import op12_counts

    d = "/root/testdata/sf0.001"
    want = {r["doc_id"]: (len(r["text"].encode()), n := len(WHOLE.encode(r["text"], add_special_tokens=False).ids), n > 1024) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in op12_counts(spark, d).collect()} == want
