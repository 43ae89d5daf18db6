"""The registered queries of this subpackage, thin over its operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of `documents` by SimHash: three-word shingles, at most three bits apart (simhash.py)."""
    from inkgrid.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` mixed to the contract's target weights (mixing.py)."""
    from inkgrid.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as token files by byte_bpe_50k.json, end id 0, read back (tokens.py)."""
    import public_tokenizers

    from inkgrid.llm.tokens import read_tokens, write_tokens

    return read_tokens(spark, write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


#: The rules of the contract: (host, path, verdict).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's URL rules on every row of `pages` (urls.py)."""
    from inkgrid.llm.urls import RULES, judge

    return judge(_table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, RULES))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record for every row of `pages`, written and read back (warc.py)."""
    from inkgrid.llm.warc import read_archives, write_archives

    return read_archives(spark, write_archives(_table(spark, sf_dir, "pages"))).withColumnRenamed("id", "page_id")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out (langid.py)."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from inkgrid.llm.langid import predict, remainder, train

    docs = _table(spark, sf_dir, "documents")
    model = train(docs.where(remainder("doc_id") != 0), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return predict(docs, model).select("doc_id", (remainder("doc_id") == 0).alias("held_out"), "lang_pred", F.col("score"))


def op7_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten documents by BM25 for each document whose id is divisible by 20 (search.py)."""
    from pyspark.sql import functions as F

    from inkgrid.llm.search import top_k

    return top_k(_table(spark, sf_dir, "documents"), F.col("doc_id") % 20 == 0).withColumn("score", F.round("score", 6))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document has of `benchmark` (decontam.py)."""
    from inkgrid.llm.decontam import contamination, digest

    return digest(contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from `labels` that aren't held out (quality.py)."""
    from inkgrid.llm.quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document (pii.py)."""
    from inkgrid.llm.pii import digest, find_pii

    return digest(find_pii(_table(spark, sf_dir, "documents")))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of `documents` by language, with the contract's least count, cut and first 2000 (phrases.py)."""
    from inkgrid.llm.phrases import collocations

    return collocations(_table(spark, sf_dir, "documents"))


def op12_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document by byte_bpe_50k.json (counts.py)."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from inkgrid.llm.counts import count_tokens

    counts = count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the `embeddings` whose id is divisible by 50, with the contract's change of labels (negatives.py)."""
    from pyspark.sql import functions as F

    from inkgrid.llm.negatives import hard_negatives

    i = F.col("vec_id")
    rows = _table(spark, sf_dir, "embeddings").withColumn("label", F.when(i % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash, op2_mixing, op3_tokens, op4_urls, op5_warc, op6_langid, op7_search, op8_decontam, op9_quality, op10_pii, op11_phrases, op12_counts, op13_negatives)}

_URLS = r"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(h, p, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict FROM q JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM q LEFT JOIN m USING (page_id)
"""

_FILL = """
, a{k} AS (SELECT *, NOT taken{j} AND size > 0 AND size <= left{j} AS may FROM f{j}),
b{k} AS (SELECT *, may AND sum(CASE WHEN may THEN size ELSE 0 END) OVER (PARTITION BY g ORDER BY rank, doc_id ROWS UNBOUNDED PRECEDING) <= left{j} AS new FROM a{k}),
f{k} AS (SELECT g, doc_id, size, rank, taken{j} OR new AS taken{k}, left{j} - sum(CASE WHEN new THEN size ELSE 0 END) OVER (PARTITION BY g) AS left{k} FROM b{k})"""

_MIX = (
    r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS g FROM s0),
s2 AS (SELECT *, ((g - 1) % 3 + 1)::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
s4 AS (SELECT *, level * w >= cap AS is_full, arg_min(level, cap / w) FILTER (level * w < cap) OVER () AS water FROM s3),
s5 AS (SELECT *, CASE WHEN is_full OR water IS NULL THEN cap ELSE water * w END AS target FROM s4),
s AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio, floor(ratio)::INT AS sure, ratio - floor(ratio) AS p FROM s5),
e AS (SELECT s.*, doc_id, size, ((('0x' || substr(md5('7:' || doc_id), 1, 13))::BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
f0 AS (SELECT g, doc_id, size, (u / (1 - u)) / (p / (1 - p)) AS rank, false AS taken0, target - sure * source_size AS left0 FROM e WHERE p > 0)"""
    + "".join(_FILL.format(k=k + 1, j=k) for k in range(3))
    + """
, l AS (SELECT g, arg_min(doc_id, (size, rank, doc_id)) AS best FROM f3 WHERE NOT taken3 AND size > 0 GROUP BY g),
t AS (SELECT doc_id, (taken3 OR (coalesce(doc_id = best, false) AND size < 2 * left3))::INT AS more FROM f3 LEFT JOIN l USING (g))
SELECT e.doc_id, e.size, source_size, target, (sure + coalesce(more, 0))::INT AS copies, ((sure + coalesce(more, 0)) * e.size)::BIGINT AS taken FROM e LEFT JOIN t USING (doc_id)
"""
)

#: Windows by their number of words; documents are cut at each number that occurs.
_DECONTAM = r"""
WITH i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
x AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n)),
m AS (SELECT doc_id, x.n, k, item FROM x JOIN v ON x.win = v.win),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

#: DuckDB has no base32: eight digits of five bits for each of the four parts of a SHA-1.
_WARC = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS h FROM p),
x AS (SELECT page_id, payload_bytes, h, list_reduce(list_transform(range(0, 4), lambda i: list_reduce(list_transform(range(0, 8), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + i * 10, 10))::BIGINT >> (35 - 5 * j)) & 31)::INT, 1)), lambda a, c: a || c)), lambda a, c: a || c) AS payload_digest FROM d),
f AS (SELECT h, min(page_id) AS lead FROM d GROUP BY h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > lead THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > lead THEN lead END AS refers_to FROM x JOIN f USING (h)
"""

_SEARCH = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents),
t AS (SELECT doc_id, word, count(*) AS tf FROM w GROUP BY ALL),
l AS (SELECT d.doc_id, coalesce(sum(tf), 0)::DOUBLE AS dl FROM documents d LEFT JOIN t USING (doc_id) GROUP BY d.doc_id),
g AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM l),
f AS (SELECT word, count(*)::DOUBLE AS df, ln(1 + ((SELECT n FROM g) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM t GROUP BY word),
q AS (SELECT doc_id AS query_id, word, idf FROM t JOIN f USING (word) WHERE doc_id % 20 = 0),
s AS (SELECT query_id, t.doc_id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT avgdl FROM g)))), 9) AS score FROM q JOIN t USING (word) JOIN l ON l.doc_id = t.doc_id GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, round(score, 6) AS score FROM s QUALIFY rank <= 10
"""

_PHRASES = r"""
WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
x AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM x, range(1, 5) r(m) WHERE i + m - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS s FROM f WHERE m > 1),
k AS (SELECT c.*, unnest(range(1, m)) AS k FROM c),
j AS (SELECT k.lang, k.m, k.phrase, a, k.k, l.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (l.f + r.f))::BIGINT AS score FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.s[1:k.k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.s[k.k + 1:k.m], ' ')),
b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(s[u:u + v - 1], ' ') AS phrase, max(a) AS longest FROM (SELECT lang, s, a, m, v, unnest(range(1, m - v + 2)) AS u FROM c, range(2, 4) q(v) WHERE v < m) GROUP BY ALL),
d AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase))::BIGINT AS rank, phrase, a, l, r, n, score FROM d JOIN n USING (lang) QUALIFY rank <= 2000
"""

_NEGATIVES = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INT AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score QUALIFY rank <= 3
"""

ORACLE_SQL: dict[str, str] = {"op2_mixing": _MIX, "op4_urls": _URLS, "op5_warc": _WARC, "op7_search": _SEARCH, "op8_decontam": _DECONTAM, "op11_phrases": _PHRASES, "op13_negatives": _NEGATIVES}
