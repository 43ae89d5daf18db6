"""Personal data by weak supervision. DataFrame and SQL functions only.

Base spans (e-mail addresses, IP addresses, card and phone numbers) come from fixed patterns and stay as they are. Beyond them,
the operator looks for credentials (kind `secret`): every token of at least 16 letters, digits, _, + and - with both a letter and a digit
is a candidate. Labelers vote on a candidate for, against, or not at all: shapes (regex), words before it (a gazetteer of
words that stand before credentials), and the characters around it (context). Expectation maximisation over the counts of vote
combinations, of all candidates, estimates each labeler's reliability without labels. The posteriors then train the final span
classifier, a naive Bayes model over features of the candidate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.llm.common import keep

#: The base patterns of the contract, in forms that don't backtrack. A local part or a number is tried only from its start, or from the
#: end of the match before; separators are taken one character at a time, if what must follow does.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.(?=[A-Za-z0-9-])(?:(?!\.(?![A-Za-z0-9-]))[A-Za-z0-9.-])*+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:(?!\x20(?![0-9])|-(?![0-9]))[0-9\x20-]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<![A-Za-z0-9_+-])(?=[A-Za-z_+-]*+[0-9])(?=[0-9_+-]*+[A-Za-z])[A-Za-z0-9_+-]{16,}+"
#: Kinds, in the order of spans that start together.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Words that stand before credentials.
GAZETTEER = ("token", "key", "apikey", "secret", "password", "passwd", "pwd", "auth", "credential", "bearer", "access_key", "api_key")
#: Beginnings of keys that providers issue.
ISSUED = r"^(AKIA|ASIA|gh[pousr]_|sk-|pk-|xox[abp]-|AIza)"

_FOUND = "struct<start:int,end:int,value:string,before:string,after:string>"


def _spans(pattern: str) -> Column:
    """(start, end, value, before, after) of the pattern's matches in `text`, places in characters: what stands between the matches
    and the matches themselves add up to them."""
    at = "s.at + char_length(element_at(s.gaps, s.k))"
    return F.expr(
        f"CASE WHEN rlike(text, r'{pattern}') THEN aggregate(regexp_extract_all(text, r'{pattern}', 0),"
        f" struct(split(text, r'{pattern}') AS gaps, 0 AS at, 1 AS k, cast(array() AS array<{_FOUND}>) AS out),"
        f" (s, m) -> struct(s.gaps AS gaps, {at} + char_length(m) AS at, s.k + 1 AS k, array_append(s.out, struct({at} AS start, {at} + char_length(m) AS end, m AS value,"
        " right(element_at(s.gaps, s.k), 24) AS before, left(element_at(s.gaps, s.k + 1), 1) AS after)) AS out),"
        f" s -> s.out) ELSE cast(array() AS array<{_FOUND}>) END"
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _is_ip(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))


def _is_card(value: Column) -> Column:
    d = _digits(value)
    each = F.transform(F.reverse(F.split(d, "(?<=.)(?=.)")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10))
    return F.length(d).between(14, 19) & (F.when(F.length(d) <= 19, F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10).otherwise(1) == 0)


def _is_phone(value: Column) -> Column:
    return F.length(_digits(value)).between(10, 15)


def spans_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, base, candidates): valid base spans as (start, k, end), k the place in KINDS, and candidates for credentials, those inside
    an e-mail address left out."""
    t = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    valid = (("email", EMAIL, lambda v: F.lit(True)), ("ip", IP, _is_ip), ("card", CARD, _is_card), ("phone", PHONE, _is_phone))
    t = t.select("id", *(_spans(p).alias(k) for k, p, _ in valid), _spans(TOKEN).alias("candidates"))

    def placed(i: int, kind: str, ok) -> Column:
        return F.transform(F.filter(kind, lambda x: ok(x["value"])), lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("k"), x["end"].alias("end")))

    base = [placed(i, kind, ok) for i, (kind, _, ok) in enumerate(valid)]
    free = F.filter("candidates", lambda c: ~F.exists("email", lambda e: (e["start"] < c["end"]) & (c["start"] < e["end"])))
    return t.select("id", F.array_sort(F.concat(*base)).alias("base"), free.alias("candidates"))


def _labelers(c: Column) -> list[Column]:
    """A vote each, 1 for, -1 against, 0 none, on a candidate (value, before, after)."""
    v, before, after = c["value"], c["before"], c["after"]
    digits = F.length(_digits(v)) / F.length(v)
    changes = F.length(F.regexp_replace(F.regexp_replace(v, r"[A-Za-z_+-]+", "a"), r"[0-9]+", "0"))
    word = F.lower(F.regexp_extract(before, r"([A-Za-z_]+)[^A-Za-z_]{0,4}$", 1))
    return [
        F.when(v.rlike(r"^([0-9a-f]+|[0-9A-F]+)$"), 1).when(v.rlike(r"[G-Zg-z].*[G-Zg-z].*[G-Zg-z].*[G-Zg-z]") & (digits < 0.1), -1).otherwise(0),
        F.when(v.rlike(ISSUED), 1).otherwise(0),
        F.when(changes >= 6, 1).when(changes <= 2, -1).otherwise(0),
        F.when(word.isin(*GAZETTEER), 1).otherwise(0),
        F.when(before.rlike(r"[=:][\s\"']{0,2}$"), 1).when((after == "@") | before.rlike(r"[@/]$"), -1).otherwise(0),
        F.when(v.rlike(r"[a-z]{8}") | v.rlike(r"^[A-Z]?[a-z]+[-_][a-z]"), -1).when(digits.between(0.1, 0.9), 1).otherwise(0),
    ]


def _features(c: Column) -> list[Column]:
    """Categories of a candidate, as text."""
    v, before = c["value"], c["before"]
    case = F.when(v.rlike("[a-z]") & v.rlike("[A-Z]"), "mixed").when(v.rlike("[A-Z]"), "upper").otherwise("lower")
    letters = F.regexp_replace(v, "[^A-Za-z]", "")
    hexes = F.when(letters.rlike("^[a-fA-F]+$"), "hex").otherwise("any")
    changes = F.length(F.regexp_replace(F.regexp_replace(v, r"[A-Za-z_+-]+", "a"), r"[0-9]+", "0"))
    word = F.lower(F.regexp_extract(before, r"([A-Za-z_]+)[^A-Za-z_]{0,4}$", 1))
    named = {
        "case": case, "hex": hexes, "length": F.least(F.floor(F.length(v) / 4), F.lit(12)).cast("string"), "digits": F.floor(F.length(_digits(v)) * 8 / F.length(v)).cast("string"),
        "changes": F.least(F.floor(changes / 2), F.lit(8)).cast("string"), "word": F.when(word.isin(*GAZETTEER), "listed").otherwise("other"), "issued": v.rlike(ISSUED).cast("string"),
        "before": F.when(before.rlike(r"[=:][\s\"']{0,2}$"), "assigned").when(before.rlike(r"\s$"), "blank").when(before == "", "none").otherwise("other"),
    }
    return [F.concat(F.lit(f"{k}="), x) for k, x in named.items()]


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[float, list[list[list[float]]], dict[tuple[int, ...], float]]:
    """Expectation maximisation for a yes/no truth behind votes of -1, 0 and 1. counts: rows of each combination. Gives the share of
    yes, for each labeler and truth the chances of its three votes, and the posterior of each combination."""
    if not counts:
        return 0.5, [], {}
    width = len(next(iter(counts)))
    prior, chance = 0.5, [[[0.5, 0.4, 0.1], [0.1, 0.4, 0.5]] for _ in range(width)]
    post: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for votes in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(chance[j][1][v + 1] / chance[j][0][v + 1]) for j, v in enumerate(votes))
            post[votes] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        total = sum(counts.values())
        prior = (sum(n * post[v] for v, n in counts.items()) + 1) / (total + 2)
        for j in range(width):
            for truth in (0, 1):
                n = [sum(k * (post[v] if truth else 1 - post[v]) for v, k in counts.items() if v[j] + 1 == x) for x in range(3)]
                start = (0.5, 0.4, 0.1) if not truth else (0.1, 0.4, 0.5)
                chance[j][truth] = [(n[x] + 10 * start[x]) / (sum(n) + 10) for x in range(3)]
    return prior, chance, post


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, base, spans), a row for each row of docs: arrays of (start, kind, end), sorted by start and the order of KINDS; places count
    characters, the end is exclusive. base: by the patterns; spans: these and the credentials that the model finds.

    A null text counts as empty and has no spans. Repeated rows get the same answer each; an empty table gives an empty result. If no
    row has a candidate, no credential is found. Further columns are ignored.
    """
    found = keep(spans_of(docs, id_col, text_col), "pii")
    each = found.select(F.explode("candidates").alias("c"))
    votes = each.select(F.array(*_labelers(F.col("c"))).alias("votes"), F.array(*_features(F.col("c"))).alias("features"))
    counts = {tuple(r["votes"]): r["count"] for r in votes.groupBy("votes").count().collect()}  # at most 3 to the power 6
    prior, _, post = reliabilities(counts)
    score = F.lit(0.0)
    if post:
        belief = F.create_map(*(x for v, p in post.items() for x in (F.lit(",".join(map(str, v))), F.lit(p))))
        yes = belief[F.array_join("votes", ",")].alias("yes")
        sums = votes.select(yes, F.explode("features").alias("f")).groupBy("f").agg(F.sum("yes").alias("yes"), F.sum(1 - F.col("yes")).alias("no")).collect()  # a row for each category
        total = [sum(counts[v] * p for v, p in post.items()), sum(counts[v] * (1 - p) for v, p in post.items())]
        weight = {r["f"]: math.log((r["yes"] + 0.5) / (total[0] + 2)) - math.log((r["no"] + 0.5) / (total[1] + 2)) for r in sums}
        table = F.create_map(*(x for f, w in weight.items() for x in (F.lit(f), F.lit(w))))
        odds = lambda c: F.aggregate(F.array(*_features(c)), F.lit(math.log(prior / (1 - prior))), lambda a, f: a + F.coalesce(table[f], F.lit(0.0)))
        chosen = F.filter("candidates", lambda c: 1 / (1 + F.exp(-odds(c))) >= threshold)
    else:
        chosen = F.filter("candidates", lambda c: score > 1)
    added = F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("secret")).alias("k"), c["end"].alias("end")))
    named = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.element_at(F.array(*map(F.lit, KINDS)), s["k"] + 1).alias("kind"), s["end"].alias("end")))
    return found.select(F.col("id").alias(id_col), named("base").alias("base"), named(F.array_sort(F.concat("base", added))).alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the contract from those of find_pii()."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select(id_col, *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
