import hashlib
import re

from inkgrid.llm import decontam


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, items, width=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        for win in [x[i : i + width] for i in range(max(1, len(x) - width + 1)) if x]:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def check(spark, docs, bench):
    got = decontam.digest(decontam.contamination(docs, bench)).collect()
    items, texts = [tuple(r) for r in bench.select("item_id", "text").collect()], {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r["doc_id"], []).append(plain(r["text"], items))
    assert len(got) == docs.count()
    for r in got:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) in texts[r["doc_id"]]


BENCH = [(1, "Quick, brown FOX jumps over the lazy dog and runs away; from here"), (2, "one"), (3, None), (4, "!!"), (10, "over the lazy dog and runs away from here to there"), (10, "word word word word word word word word word word word"), (5, "Äpfel und öl")]


def test_odd_documents(spark, odd, none):
    bench = spark.createDataFrame([(*b, 1) for b in BENCH], "item_id long, text string, row int")
    check(spark, odd.where("doc_id is null or doc_id <> 8"), bench)
    long = decontam.digest(decontam.contamination(odd.where("doc_id = 8"), bench)).first()
    assert long["n_hit"] == long["n_words"] == 30_000
    check(spark, odd.where("doc_id < 8"), bench.where("item_id < 0"))
    assert decontam.contamination(none, bench).count() == 0


def test_several_automata_give_the_same(spark, odd, monkeypatch):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    few = odd.where("doc_id < 8")
    want = sorted(map(str, decontam.contamination(few, bench).collect()))
    clean = sorted(r["doc_id"] for r in decontam.clean(few, bench).collect())
    monkeypatch.setattr(decontam, "AUTOMATON_NODES", 150)
    assert sorted(map(str, decontam.contamination(few, bench).collect())) == want
    assert sorted(r["doc_id"] for r in decontam.clean(few, bench).collect()) == clean
    assert clean == [4, 5, 6]


def test_spans_are_of_the_original(spark, odd):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    docs = spark.createDataFrame([(1, "Zzz ÄPFEL Äpfel -- und Öl. x"), (2, "Say:  Äpfel, und  öl!")], "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in decontam.contamination(docs, bench).collect()}
    assert got[2] == [(6, 20)] and got[1] == []
