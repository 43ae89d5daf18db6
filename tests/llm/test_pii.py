import hashlib
import random
import re

from inkgrid.llm import pii


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= len(d := re.sub("[^0-9]", "", v)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= len(re.sub("[^0-9]", "", v)) <= 15),
]


def plain(text):
    return [(s, k, e) for s, _, k, e in sorted((m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(BASE) for m in re.finditer(p, text or "") if ok(m[0]))]


def base(spark, texts):
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, base int, spans string, id string")
    return {r["doc_id"]: r for r in pii.find_pii(docs).collect()}


def test_base_spans_of_random_texts(spark):
    rng = random.Random(7)
    parts = ["a", "b.c", "@", "@x", ".", ".co", "-", "_", "%", "+", "1", "12", "255", "256", "007", "4111111111111111", "4111-1111 1111 1111", "3782 822463 10005", " ", "  ", "+1 (555) 123-4567", "(", ")", "é", "😀", "1.2.3.4", "99999999999999999999", "x@y.zz"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(3000)] + [None, "", "1 " * 20_000, "a." * 20_000 + "b@" + "c." * 20_000 + "d", "7" * 30_000]
    got = base(spark, texts)
    for i, t in enumerate(texts):
        assert [(s["start"], s["kind"], s["end"]) for s in got[i]["base"]] == plain(t), t[:100]


def test_credentials_and_words(spark):
    rng = random.Random(1)
    code = lambda n, s: "".join(rng.choice(s) for _ in range(n))
    texts = [f'le token = "{code(40, "0123456789abcdef")}" es' for _ in range(40)] + [f"and AKIA{code(16, 'ABCDEFGHIJKLMNOP234567')} so" for _ in range(40)]
    texts += [f"is password={code(18, '0123456789abcdef')} on" for _ in range(40)] + [f"the internationalisation{i % 3} and thblentherword" for i in range(120)] + ["mail a.verylongname0123456789@example.com"]
    got = base(spark, texts)
    found = [any(s["kind"] == "secret" for s in got[i]["spans"]) for i in range(len(texts))]
    assert all(found[:40]) and sum(found[40:80]) >= 36 and all(found[80:120]) and not any(found[120:])
    assert [s["kind"] for s in got[len(texts) - 1]["spans"]] == ["email"]


def test_digest_and_odd_documents(spark, odd, none):
    docs = spark.createDataFrame([(1, "x +1 (555) 123-4567, a@b.cc 1.2.3.4"), (2, None), (2, None), (None, "a@b.cc")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.digest(pii.find_pii(docs)).collect()}
    text = ",".join(f"{k}:{s}:{e}" for s, k, e in plain("x +1 (555) 123-4567, a@b.cc 1.2.3.4"))
    assert got[1]["spans"] == text and got[1]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert (got[1]["n_email"], got[1]["n_ip"], got[1]["n_card"], got[1]["n_phone"]) == (1, 1, 0, 1)
    assert got[2]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.find_pii(odd).count() == odd.count() and pii.find_pii(none).count() == 0


def test_reliabilities():
    rng = random.Random(2)
    counts, truth = {}, {}
    for _ in range(4000):
        t = rng.random() < 0.3
        v = tuple((1 if t else -1) if rng.random() < q else rng.choice((-1, 0, 1)) for q in (0.9, 0.7, 0.5))
        counts[v] = counts.get(v, 0) + 1
        truth.setdefault(v, []).append(t)
    prior, chance, post = pii.reliabilities(counts)
    assert abs(prior - 0.3) < 0.05 and chance[0][1][2] > chance[2][1][2]
    assert all((post[v] > 0.5) == (sum(t) > len(t) / 2) for v, t in truth.items() if len(t) > 80 and abs(sum(t) / len(t) - 0.5) > 0.2)


def test_planted_credentials_of_documents(spark):
    """Recall of the added spans on the given documents: assignments of long codes to words that name a credential."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = re.compile(r"\b(?:token|secret|password|api_key|key)\s?[=:]\s?\"?([A-Za-z0-9_+-]{16,})")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    want = {i: {m.span(1) for m in planted.finditer(t) if re.search("[0-9]", m[1]) and re.search("[A-Za-z]", m[1])} for i, t in texts.items()}
    got = {r["doc_id"]: {(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "secret"} for r in pii.find_pii(docs).collect()}
    n = sum(map(len, want.values()))
    assert n >= 5 and sum(len(want[i] & got[i]) for i in want) >= 0.9 * n
    # words alone are no credentials
    plain_ = [i for i, t in texts.items() if not re.search("[0-9]", t)]
    assert len(plain_) > 300 and not any(got[i] for i in plain_)
