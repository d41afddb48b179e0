"""Queries of the text operators over the driver tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard, lines, packing, phrases, quality, repetition, search, sharding, substrings, suffixes, token_files, urls

RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), RULES)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(_table(spark, sf_dir, "documents"))


def op6_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge(_table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.split(_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(_table(spark, sf_dir, "documents"))


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(_table(spark, sf_dir, "documents")).drop("kept")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(search.index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pack, op2_substrings, op3_urls, op4_quality, op5_lines, op6_repetition, op7_token_files, op8_decontaminate, op9_jaccard, op10_shards, op11_collocations, op12_suffixes, op13_search)}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, k, hash(array_to_string(w[k:k + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS k FROM d WHERE len(w) >= 35)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, k + j AS pos FROM win JOIN rep USING (h), generate_series(0, 34) AS s(j)),
word AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS pos FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n FROM word ANTI JOIN hit USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

_HOST = "translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RULES = ", ".join(f"({i}, '{v}', '{h}', '{p}')" for i, (v, h, p) in enumerate(RULES))
# The pages hold no redirects and no canonical links, so what no rule fits is allowed.
OP3 = f"""
WITH r(i, v, h, p) AS (VALUES {_RULES}),
u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN {_HOST} ELSE '' END AS host,
  CASE WHEN contains(coalesce(url, ''), '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
fit AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM u JOIN r ON (host = h OR suffix(host, '.' || h)) AND prefix(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN fit USING (page_id)"""

OP5 = """
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS r, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS k FROM documents),
l AS (SELECT doc_id, k, regexp_extract_all(r, '[^ \\t\\r\\x0B\\f]+') AS w FROM raw WHERE regexp_matches(r, '[^ \\t\\r\\x0B\\f]')),
f AS (SELECT w, min((doc_id, k)) AS o FROM l GROUP BY w),
v AS (SELECT o, j, list_concat(w[1:j], w[j + 2:]) AS d FROM (SELECT o, w, unnest(generate_series(0, len(w) - 1)) AS j FROM f WHERE len(w) >= 10)),
fuzzy AS (
  SELECT a.o FROM v a JOIN (SELECT j, d, min(o) AS o FROM v GROUP BY j, d) b ON a.j = b.j AND a.d = b.d AND b.o < a.o
  UNION SELECT a.o FROM f a JOIN v b ON a.w = b.d AND b.o < a.o WHERE len(a.w) >= 10
  UNION SELECT b.o FROM f a JOIN v b ON a.w = b.d AND a.o < b.o WHERE len(a.w) >= 10),
gone AS (SELECT l.doc_id, l.k FROM l JOIN f USING (w) WHERE (l.doc_id, l.k) <> f.o OR f.o IN (SELECT o FROM fuzzy))
SELECT doc_id, coalesce(n, 0) AS n_lines, coalesce(m, 0) AS n_removed, coalesce(removed, '') AS removed FROM documents
LEFT JOIN (SELECT doc_id, count(*) AS n FROM l GROUP BY 1) USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS m, string_agg(k, ',' ORDER BY k) AS removed FROM gone GROUP BY 1) USING (doc_id)"""

OP9 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(generate_series(1, len(w) - 2), lambda k: array_to_string(w[k:k + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
m AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, m.b FROM r JOIN m ON r.y = m.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(y) FROM r WHERE r.x = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS s FROM documents),
w AS (SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4)) AS o(k) WHERE len(w) >= k) GROUP BY ALL HAVING count(*) >= 30),
c AS MATERIALIZED (SELECT lang, phrase, f AS a, k, string_split(phrase, ' ') AS w FROM g WHERE k >= 2),
inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM c, (VALUES (2), (3)) AS o(m), (VALUES (1), (2), (3)) AS s(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
parts AS MATERIALIZED (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS tail FROM c, (VALUES (1), (2), (3)) AS s(j) WHERE j < k),
cuts AS (SELECT p.lang, p.phrase, a, j, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score FROM parts p JOIN g x ON x.lang = p.lang AND x.phrase = p.head JOIN g y ON y.lang = p.lang AND y.phrase = p.tail),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, encode(best.phrase)) AS rank FROM best LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""

OP12 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, k, hash(substr(h, 2 * k - 1, 100)) AS s FROM (SELECT doc_id, h, unnest(generate_series(1, length(h) // 2 - 49)) AS k FROM d WHERE length(h) >= 100)),
least AS (SELECT s, min(doc_id) AS o FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT DISTINCT doc_id, k FROM win JOIN least USING (s) WHERE o < doc_id),
run AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS e FROM (SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM (SELECT doc_id, k, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) <= 50 THEN 0 ELSE 1 END AS new FROM hit)) GROUP BY doc_id, g),
part AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 1) AS b FROM run),
kept AS (SELECT doc_id, sum(e - a) AS n, count(*) AS m, string_agg(substr(h, 2 * b - 1, 2 * (a - b)), '' ORDER BY a) || substr(any_value(h), 2 * max(e) - 1) AS t FROM part JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h)::BIGINT // 2 AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(m, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13 = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS i, doc_id, {_TERMS} AS t FROM documents),
c AS (SELECT count(*) AS n, sum(len(t)) AS l FROM d WHERE len(t) > 0),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
tf AS MATERIALIZED (SELECT i, term, count(*) AS tf FROM (SELECT i, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, c GROUP BY term, n),
s AS (SELECT item_id, tf.i, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(t) * n) // l))))::BIGINT AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN d ON d.i = tf.i, c GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s JOIN d USING (i) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op2_substrings": OP2, "op3_urls": OP3, "op5_lines": OP5, "op9_jaccard": OP9, "op11_collocations": OP11, "op12_suffixes": OP12, "op13_search": OP13}
