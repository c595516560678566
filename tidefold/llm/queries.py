"""Queries of the text operators over whole tables, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidefold.llm import collocations, exact_dedup, language_id, lattice_lm, mixing, ngram_join, packing, quality, quality_rules, secret_scan, token_files, toxicity, turn_repair
from tidefold.llm.common import read


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"), digest=True)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_query(read(spark, sf_dir, "documents"))


def op9_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.lattice_query(read(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_query(read(spark, sf_dir, "documents"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_damaged(read(spark, sf_dir, "conversations"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_secret_scan, op3_toxicity, op4_exact_dedup, op5_packing, op6_mixing, op7_quality_rules, op8_language_id, op9_lattice_lm, op10_quality, op11_token_planes, op12_turn_repair, op13_collocations)}

_SECRETS = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, owner, 0 AS rank, 8 AS least, regexp_split_to_array(t, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS gaps,
    regexp_extract_all(t, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS whole,
    regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS secret FROM d
  UNION ALL SELECT doc_id, owner, 1, 16, regexp_split_to_array(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT doc_id, owner, 2, 32, regexp_split_to_array(t, '[0-9a-f]{32,}'), regexp_extract_all(t, '[0-9a-f]{32,}'), regexp_extract_all(t, '[0-9a-f]{32,}') FROM d
  UNION ALL SELECT doc_id, owner, 3, 20, regexp_split_to_array(t, '[A-Za-z0-9+/_=-]+'), regexp_extract_all(t, '[A-Za-z0-9+/_=-]+'), regexp_extract_all(t, '[A-Za-z0-9+/_=-]+') FROM d),
u AS (SELECT doc_id, owner, rank, least, gaps, whole, secret, unnest(range(1, len(whole) + 1)) AS i FROM m WHERE rank < 3 OR len(list_filter(whole, lambda w: length(w) >= 20)) > 0),
p AS (SELECT doc_id, owner, rank, secret[i] AS secret, whole[i] AS w, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM u WHERE length(secret[i]) >= least AND (rank < 3 OR (regexp_matches(secret[i], '[0-9]') AND regexp_matches(secret[i], '[A-Za-z]')))),
q AS (SELECT doc_id, owner, rank, secret, s, s + length(w) AS e FROM p),
c AS (SELECT * FROM q WHERE rank < 3 OR NOT EXISTS (SELECT 1 FROM q b WHERE b.doc_id = q.doc_id AND b.rank < 3 AND b.s < q.e AND q.s < b.e)),
f AS (SELECT secret, count(DISTINCT owner) <= 2 AND count(DISTINCT (owner, doc_id)) <= greatest(25, 0.01 * (SELECT count(*) FROM documents)) AS live FROM c GROUP BY secret),
j AS (SELECT doc_id, rank, s, e, live, (['assign', 'access', 'hex', 'owned'])[rank + 1] || ':' || s || ':' || e AS span FROM c JOIN f USING (secret)),
g AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    string_agg(span, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY s, rank) FILTER (rank < 3 OR live) AS spans,
    count(*) FILTER (rank = 3 AND live) AS n_owned, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""

_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

# crc32 byte by byte, over a table made by its rule; then the same states turn by turn, a cost of twelve digits before each audit.
def _added(m: re.Match) -> str:
    """<state,cost,letter>: the state's key with the cost and the letter added."""
    state, cost, letter = m[1], m[2], m[3]
    return f"(lpad(CAST(least(CAST({state}[1:6] AS BIGINT) + {cost}, 999999) AS VARCHAR), 6, '0') || {state}[7:] || '{letter}')"


_REPAIR = re.sub(r"<(\w+),([^,<>]+),(\w)>", _added, r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, n)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
hashed AS (SELECT k.*, xor(list_reduce(list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT)), lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1]), 4294967295), 4294967295) % 20 AS d FROM keyed k, tab),
rows AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE d <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again FROM rows),
faulty AS (SELECT *, role[1] AS i, coalesce(lag(role[1]) OVER (PARTITION BY conv_id ORDER BY place) || role[1] NOT IN ('su', 'ua', 'au'), false) AS bad,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM placed),
f AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 500000 WHEN fault = 'truncated' THEN 5 ELSE 0 END AS kept FROM faulty),
w AS (SELECT conv_id, CAST(0 AS BIGINT) AS place, '000000' AS e, '900000' AS s, '900000' AS u, '900000' AS a FROM f GROUP BY conv_id
  UNION ALL
  SELECT conv_id, place, <e,2,D>, least(<s,2,D>, CASE WHEN i = 's' THEN <e,kept,K> ELSE '999999' END),
    least(<iu,2,D>, CASE WHEN i = 'u' THEN <top,kept,K> ELSE <top,kept + 1,R> END), least(<ia,2,D>, CASE WHEN i = 'a' THEN <iu,kept,K> ELSE <iu,kept + 1,R> END)
  FROM (SELECT *, least(e, s, ia) AS top FROM (SELECT w.conv_id, f.place, f.i, f.kept, e, s, least(u, <e,5,I>, <s,5,I>, <a,5,I>) AS iu, least(a, <u,5,I>) AS ia FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.place = w.place + 1))),
best AS (SELECT conv_id, least(e, a, <u,5,I>) AS b FROM w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) = 1),
tokens AS (SELECT conv_id, CAST(b[1:6] AS BIGINT) AS cost, b[7:] AS audit, regexp_extract_all(b[7:], 'I*[KRD]') AS parts FROM best),
letters AS (SELECT t.conv_id, place, x, CASE WHEN x = 'I' THEN '' ELSE f.role END AS role, CASE WHEN x = 'I' THEN '' ELSE f.text END AS text, n FROM tokens t JOIN f ON f.conv_id IS NOT DISTINCT FROM t.conv_id, (SELECT unnest(range(1, 9)) AS n) k, (SELECT unnest(['I', 'K', 'R']) AS x) l WHERE parts[place][n] = x
  UNION ALL SELECT conv_id, 1 + len(parts), 'I', '', '', 1 FROM tokens WHERE audit LIKE '%I' ),
stay AS (SELECT *, row_number() OVER o - 1 AS j, first_value(x = 'K' AND role[1] = 's') OVER o AS lead FROM letters WINDOW o AS (PARTITION BY conv_id ORDER BY place, n)),
digest AS (SELECT conv_id, string_agg(CASE WHEN x = 'K' THEN role WHEN (j - CAST(lead AS INTEGER)) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS body FROM stay GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN tokens t ON t.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN digest g ON g.conv_id IS NOT DISTINCT FROM c.conv_id
""")

_COLLOCATIONS = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (SELECT unnest(range(1, 5)) AS m) ms)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL),
t AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= 30),
i AS (SELECT lang, array_to_string(w[s:s + k - 1], ' ') AS phrase, max(a) AS around FROM (SELECT lang, w, m, a, k, unnest(range(1, m - k + 2)) AS s FROM c, (SELECT unnest(range(2, 4)) AS k) ks WHERE k < m) GROUP BY ALL),
k AS (SELECT c.*, unnest(range(1, m)) AS cut FROM c LEFT JOIN i USING (lang, phrase) WHERE around IS NULL OR 100 * CAST(around AS HUGEINT) < 80 * CAST(a AS HUGEINT)),
s AS (SELECT k.lang, k.phrase, k.a, k.cut, x.a AS l, y.a AS r, CAST((2000000 * CAST(k.a AS HUGEINT)) // (x.a + y.a) AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1:cut], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b JOIN t USING (lang) QUALIFY rank <= 2000
"""

SQL = {"op2_secret_scan": _SECRETS, "op4_exact_dedup": _DEDUP, "op12_turn_repair": _REPAIR, "op13_collocations": _COLLOCATIONS}
