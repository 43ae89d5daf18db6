import re
from collections import Counter

import pytest

import corpus_pipeline
from inkgrid.llm import tokens
from test_decontam import plain as leaks
from test_mixing import plain
from test_similarity import groups
from test_tokens import WHOLE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for _, f in corpus_pipeline.STAGES:
        out.append(f(spark, out[-1], SF).cache())
    return out


def test_columns_and_shrinking(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])
    assert stages[0].count() >= stages[1].count() >= stages[2].count() >= stages[3].count() > 0


def test_language_keeps_documents_with_letters(stages):
    kept = {r["doc_id"] for r in stages[1].collect()}
    assert all(r["doc_id"] in kept for r in stages[0].collect() if sum(map(str.isalpha, r["text"])) > 100)


def test_one_of_each_group(stages):
    """Against the similarity of all pairs."""
    want = groups({r["doc_id"]: r["text"] for r in stages[1].collect()})
    assert Counter(r["doc_id"] for r in stages[2].collect()) == Counter(set(want.values()))


def test_no_benchmark_passages(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {r["doc_id"] for r in stages[2].collect() if not leaks(r["text"], items)[-1]}
    assert {r["doc_id"] for r in stages[3].collect()} == clean


def test_mixture(stages):
    """Against a version that takes one document after the other."""
    rows = [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))) for r in stages[3].collect()]
    want = {i: n for i, n in plain(rows).items() if n}
    assert Counter(r["doc_id"] for r in stages[4].collect()) == Counter(want)


def test_odd_tables(spark, odd, none):
    """Nulls, empty and long texts, repeated rows and further columns go through each stage; so does an empty table."""
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out, empty = stage(spark, odd, SF), stage(spark, none, SF)
        assert empty.count() == 0
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == odd.columns == empty.columns
            ids = Counter(r["doc_id"] for r in out.collect())
        if i == 0:
            assert not set(ids) & {4, 5, 6, 9} and ids[1] == 1 and ids[2] == 2
        elif i == 1:  # 1, 2 and 2 are equal and 3 has one shingle more; 4, 5 and 6 have no words; both rows without an id stay
            assert ids == {1: 1, 4: 1, 7: 1, 8: 1, 9: 1, 10: 1, 11: 1, None: 2}
        elif i == 2:
            assert ids[4] == 1 and ids[5] == 1 and ids[2] == 2 and ids[None] == 2
        elif i == 4:
            assert out.count() == odd.count() and out.where("n_tokens = 1").count() == 3


def test_tokens(spark, stages):
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    got = stages[5].orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in stages[4].select("doc_id").collect())
    assert all(r["n_tokens"] == len(WHOLE.encode(texts[r["doc_id"]], add_special_tokens=False).ids) + 1 for r in got)
    assert tokens.SHARD and corpus_pipeline.ORACLE_SQL is None
