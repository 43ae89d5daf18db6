import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkgrid.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top=2000, cover=80):
    """The same from all phrases of all texts, held in memory."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            for m in range(1, 5):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in cands.items():
            for inner in {p[i : i + m] for m in range(2, len(p)) for i in range(len(p) - m + 1)}:
                longest[inner] = max(longest[inner], a)
        found = []
        for p, a in cands.items():
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            if 100 * longest[p] < cover * a or not longest[p]:
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def corpus(seed, n=300):
    rng = np.random.default_rng(seed)
    vocabulary = [*"abcdefgh", "Über", "ß", "日本", "x-y", "it's"]
    p = 1 / np.arange(1, len(vocabulary) + 1) ** 1.2
    line = "The same line of words again"
    out = []
    for i in range(n):
        words = rng.choice(vocabulary, size=rng.integers(0, 40), p=p / p.sum())
        seps = rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " \x1c", " "], size=len(words))
        text = "".join(w + s for w, s in zip(words, seps, strict=True)) + (line if i % 3 == 0 else "")
        out.append((text, [None, "en", "und", "fr"][i % 4]))
    return out


@pytest.mark.parametrize(("budget", "least", "top", "block"), [(5, 3, 2000, 2000), (60, 2, 7, 1 << 20), (1 << 21, 3, 2000, 3000)])
def test_against_all_phrases(spark, budget, least, top, block):
    """Small budgets make heavy prefixes of one, two and three words, and groups of a few suffixes."""
    rows = corpus(budget)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    assert sorted(map(tuple, phrases.collocations(docs, least, top, budget=budget, block=block).collect())) == plain(rows, least, top)


def test_one_line_repeated(spark):
    """A third of all rows, and more, are one line: one suffix for each block."""
    rows = [("the very same line of text", "en")] * 400 + [(f"own words {i} are here", "en") for i in range(200)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, phrases.collocations(docs, 5, budget=50).collect())) == plain(rows, 5)


def test_odd_and_empty_tables(spark, odd, none):
    rows = [(r["text"], r["lang"]) for r in odd.collect()]
    got = phrases.collocations(odd, 2)
    assert [f"{n} {t}" for n, t in got.dtypes] == [x.replace("long", "bigint") for x in phrases.RESULT.split(", ")]
    assert sorted(map(tuple, got.collect())) == plain(rows, 2)
    assert phrases.collocations(none, 2).collect() == []
    assert phrases.collocations(odd, 1_000_000).collect() == []


def test_registered_query(spark):
    from inkgrid.llm.queries import op11_phrases

    d = "/root/testdata/sf0.001"
    rows = [(r["text"], r["lang"]) for r in spark.read.parquet(f"{d}/documents.parquet").select("text", "lang").collect()]
    assert sorted(map(tuple, op11_phrases(spark, d).collect())) == plain(rows, 30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="Aa é.\n\t日!x", max_size=12), max_size=6))
def test_words(texts):
    got, first = phrases.words_of(pa.array([t.encode() for t in texts], pa.large_binary()))
    want = [[x for x in re.split("[ \t]", p) if x] for t in texts for p in re.split("[.,;:!?\n-\r]", t.translate(LOWER))]
    assert got.to_pylist() == [w for p in want for w in p]
    assert first.tolist() == [i == 0 for p in want for i in range(len(p))]


def test_scores_past_64_bits(spark):
    big = 3_000_000_000_000_000
    p = spark.createDataFrame([(1, 2, 0, 0, big)], phrases.PHRASES)
    w = spark.createDataFrame([("en", "a", big + 1, 1), ("en", "b", big + 5, 2)], "lang string, word string, f long, id long")
    r = phrases.scored(p, w, 80).first()
    assert (r["score"], r["l"], r["r"]) == (2_000_000 * big // (2 * big + 6), big + 1, big + 5)
