import itertools

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from inkgrid.llm import langid

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def segmentations(word, vocabulary):
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        ends = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        parts = [word[a:b] for a, b in itertools.pairwise(ends)]
        if all(p in vocabulary for p in parts):
            yield parts


def test_forward_and_counts_against_all_segmentations():
    vocabulary = langid.pieces(PATH)
    at = {p: i for i, p in enumerate(vocabulary)}
    rng = np.random.default_rng(2)
    p = rng.random((len(vocabulary), 2)) * 0.01
    words = [b" hello", b"x", " Äpfel".encode(), b" then"]
    lattice = langid.lattice_of(PATH)
    z = np.exp(lattice.likelihoods(words, p))
    counts = rng.integers(1, 5, (len(words), 2)).astype(float)
    want = np.zeros_like(p)
    for i, w in enumerate(words):
        all_ = [(s, np.prod([p[at[x]] for x in s], axis=0)) for s in segmentations(w, at)]
        total = sum(v for _, v in all_)
        assert z[i] == pytest.approx(total)
        for s, v in all_:
            for x in s:
                want[at[x]] += v / total * counts[i]
    assert lattice.expected(words, counts, p) == pytest.approx(want)


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, held = docs.where(langid.remainder("doc_id") != 0), docs.where(langid.remainder("doc_id") == 0)
    got = langid.predict(held, langid.train(train, PATH)).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_documents(spark, odd, none):
    model = langid.train(odd, PATH)
    got = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert {got[i]["lang_pred"] for i in (4, 5, 6, 9)} == {"und"} and got[4]["score"] == 0
    assert {got[i]["lang_pred"] for i in (1, 8, 10, 11)} <= {"de", "en"}
    assert langid.predict(odd, model).count() == odd.count() and langid.predict(none, model).count() == 0
    nothing = langid.train(none, PATH)
    assert {r["lang_pred"] for r in langid.predict(odd, nothing).collect()} == {"und"}
    kept = langid.accept(odd, model)
    assert kept.columns == odd.columns and kept.where(F.col("doc_id").isin(4, 5, 6, 9)).count() == 0


def test_small_tables_give_the_same(monkeypatch):
    rng = np.random.default_rng(1)
    model = langid.Model(PATH, ["a", "b"], rng.random((len(langid.pieces(PATH)), 2)) / 50_000)
    texts = ["hello world " * 50, None, "x" * 500 + " abc", " ".join(f"w{i}" for i in range(3000))]
    want = model.scorer()(texts)
    monkeypatch.setattr(langid, "KNOWN", 500)
    assert model.scorer()(texts) == want


def test_long_words_against_sums_of_logarithms(monkeypatch):
    """Words far longer than 48 bytes, some without blanks in them, with pieces of over 12 bytes; sums far below the smallest float."""
    vocabulary = langid.pieces(PATH)
    assert max(map(len, vocabulary)) > 12
    rng = np.random.default_rng(5)
    p = rng.random((len(vocabulary), 2)) * 1e-4
    at = {v: i for i, v in enumerate(vocabulary)}
    longest = max(map(len, vocabulary))
    words = [b" " + "今日は良い天気ですね".encode() * 40, b" " + bytes(rng.integers(33, 127, 700).tolist()), b" " + b"internationalisation" * 30, b" x", b" " + b"-" * 300]
    lattice = langid.lattice_of(PATH)

    def plain(w):
        total = [np.full(2, -np.inf) for _ in range(len(w) + 1)]
        total[0] = np.zeros(2)
        for i in range(len(w)):
            for k in range(1, min(longest, len(w) - i) + 1):
                if w[i : i + k] in at:
                    total[i + k] = np.logaddexp(total[i + k], total[i] + np.log(p[at[w[i : i + k]]]))
        return total[-1]

    want = [plain(w) for w in words]
    assert min(x.min() for x in want) < -3000
    assert np.allclose(lattice.likelihoods(words, p), want)
    # each byte of a word is in one piece, so expected counts times lengths add up to the words' lengths
    counts = np.array([[1.0, 0.0], [0.0, 2.0], [1.0, 1.0], [3.0, 0.0], [0.0, 1.0]])
    got = lattice.expected(words, counts, p)
    size = np.array([len(v) for v in vocabulary])
    assert size @ got == pytest.approx(np.array([len(w) for w in words]) @ counts)
    monkeypatch.setattr(langid, "CELLS", 50)
    assert np.allclose(lattice.likelihoods(words, p), want) and np.allclose(lattice.expected(words, counts, p), got)


def test_predictions_against_a_plain_version(spark):
    """predict() over whole texts against sums of logarithms over the words of each."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs.where(langid.remainder("doc_id") != 0), PATH)
    p = model.p.astype(np.float32).astype(np.float64)
    lattice, n = langid.lattice_of(PATH), 0
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in langid.predict(docs, model).collect():
        words = langid.words_of(texts[r["doc_id"]])
        if not any(map(str.isalpha, texts[r["doc_id"]] or "")):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        total = lattice.likelihoods(words, p).sum(axis=0)
        assert r["lang_pred"] == model.langs[int(total.argmax())]
        assert r["score"] == pytest.approx(1 / np.exp(total - total.max()).sum(), abs=1e-3)
        n += 1
    assert n > 150
