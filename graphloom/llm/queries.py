"""The thin queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, jaccard_join, katz_lm, line_dedup, quality_rules, secret_scan, sentencepiece_codec, sharding, simhash_dedup, suffix_dedup, token_store, vector_codes
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.components(table(spark, sf_dir, "documents"))


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", F.round("similarity", 6).alias("similarity"))


ORACLES["op2_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, w, len(w) AS n FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents)
),
i AS (
  SELECT item_id, w, len(w) AS size, least(5, len(w)) AS k FROM (
    SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark)
  WHERE len(w) > 0
),
s AS (SELECT item_id, size, k, q, array_to_string(w[q + 1:q + k], ' ') AS s FROM (SELECT *, unnest(range(0, size - k + 1)) AS q FROM i)),
t AS (SELECT doc_id, n, k, p, array_to_string(w[p + 1:p + k], ' ') AS s FROM (SELECT *, unnest(range(0, n - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM i))),
a AS (
  SELECT DISTINCT doc_id, item_id, k, n_words, unnest(range(greatest(0, p - n_words + k), least(p, n - n_words) + 1)) AS start
  FROM (SELECT DISTINCT doc_id, item_id, k, n, p, least(size, n) AS n_words FROM t JOIN s USING (k, s))
),
v AS (
  SELECT doc_id, item_id, start, n_words, x AS s, count(*) AS c
  FROM (SELECT a.*, t.s AS x FROM a JOIN t ON t.doc_id = a.doc_id AND t.k = a.k AND t.p BETWEEN a.start AND a.start + a.n_words - a.k) GROUP BY ALL
),
u AS (SELECT item_id, s, count(*) AS c FROM s GROUP BY ALL),
z AS (SELECT item_id, sum(c) AS total FROM u GROUP BY ALL),
m AS (
  SELECT doc_id, item_id, start, n_words, sum(least(v.c, coalesce(u.c, 0))) AS common, sum(v.c) AS own FROM v LEFT JOIN u USING (item_id, s) GROUP BY ALL
),
j AS (SELECT doc_id, item_id, start, n_words, common / (own + total - common) AS similarity FROM m JOIN z USING (item_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS rank FROM j WHERE similarity >= 0.8)
SELECT doc_id, item_id, start::BIGINT AS start, n_words::BIGINT AS n_words, round(similarity, 6) AS similarity FROM b WHERE rank = 1
"""


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


ORACLES["op4_line_dedup"] = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (
  SELECT doc_id, p, array_to_string(lines[p + 1:p + 3], chr(10)) AS win
  FROM (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS p FROM d WHERE len(lines) > 2)
),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS k FROM w WHERE regexp_matches(win, '[^\x20\x09-\x0D]')),
c AS (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS p FROM f WHERE k > 1),
r AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE before IS NULL OR before < p - 1) AS n_spans
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM c) GROUP BY doc_id
),
l AS (SELECT doc_id, unnest(range(0, len(lines))) AS p, unnest(lines) AS line FROM d),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS text FROM l ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(d.lines)::BIGINT AS n_lines, coalesce(r.n_removed, 0)::BIGINT AS n_removed, coalesce(r.n_spans, 0)::BIGINT AS n_spans,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")), "prose-1")
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return found.select(*first, "failures")


ORACLES["op8_quality_rules"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
),
g AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) > 2)),
h AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM h WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, length(regexp_replace(t, '[^0-9]', '', 'g'))::BIGINT AS n_digits,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]')))::BIGINT AS n_bullet_lines,
         len(list_filter(l, lambda x: ends_with(x, '...') OR ends_with(x, '…')))::BIGINT AS n_ellipsis_lines, length(regexp_replace(t, '[^{}]', '', 'g'))::BIGINT AS n_braces
  FROM d LEFT JOIN r USING (doc_id)
),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END | CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    | CASE WHEN 4 * n_symbols > n_words THEN 4 ELSE 0 END | CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END
    | CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END | CASE WHEN n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines THEN 32 ELSE 0 END
    | CASE WHEN 5 * n_digits > word_chars THEN 64 ELSE 0 END | CASE WHEN 100 * n_bullet_lines > 90 * n_lines THEN 128 ELSE 0 END
    | CASE WHEN 100 * n_ellipsis_lines > 30 * n_lines THEN 256 ELSE 0 END | CASE WHEN n_words > 100000 THEN 512 ELSE 0 END
    | CASE WHEN n_braces > 0 THEN 1024 ELSE 0 END)::BIGINT AS failures
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed, (failures & 511) = 0 AS kept, failures FROM b
"""


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_table(table(spark, sf_dir, "documents"))


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(table(spark, sf_dir, "documents"), byte_bpe(), end_id=2)


def piece_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_table(table(spark, sf_dir, "documents"), piece_bpe())


@query
def op6_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_lm.score_table(table(spark, sf_dir, "documents"))


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_table(table(spark, sf_dir, "embeddings"))


def _code_rounds(rounds: int) -> str:
    """CTEs of so many rounds: a<r> assigns parts to the entries of b<r-1>, b<r> are the entries after it."""
    nearest = "SELECT p.vec_id, p.k, any_value(p.y) AS y, min(256 * list_sum(list_transform(list_zip(p.y, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT + b.e) AS best FROM p JOIN b{} b USING (k) GROUP BY ALL"
    out = []
    for r in range(1, rounds + 2):
        out.append(f"a{r} AS MATERIALIZED (SELECT vec_id, k, y, best % 256 AS e, best // 256 AS d FROM ({nearest.format(r - 1)}))")
        means = f"SELECT k, e, list(m ORDER BY i) AS y FROM (SELECT k, e, i, floor(sum(x) / count(*))::BIGINT AS m FROM (SELECT k, e, unnest(y) AS x, unnest(range(len(y))) AS i FROM a{r}) GROUP BY ALL) GROUP BY ALL"
        out.append(f"b{r} AS MATERIALIZED (SELECT b.k, b.e, coalesce(m.y, b.y) AS y FROM b{r - 1} b LEFT JOIN ({means}) m USING (k, e))")
    return ", ".join(out[:-1])


ORACLES["op11_vector_codes"] = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, k, x[k * (len(x) // 4) + 1:(k + 1) * (len(x) // 4)] AS y FROM v, range(4) r(k)),
b0 AS MATERIALIZED (SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS e, y FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 256)),
{_code_rounds(4)},
c AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY k) AS code, sum(d)::BIGINT AS error FROM a5 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY k, e, i)) AS digest FROM (SELECT k, e, unnest(y) AS x, unnest(range(len(y))) AS i FROM b4))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256 FROM c JOIN v USING (vec_id), h
"""


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_damaged(table(spark, sf_dir, "conversations"))


@query
def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"))


ORACLES["op13_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) > 2 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM d),
n AS MATERIALIZED (SELECT min(doc_id) AS node, g, len(g) AS k FROM s WHERE len(g) > 0 GROUP BY g),
x AS MATERIALIZED (SELECT node, k, unnest(g) AS h FROM n),
p AS (SELECT a.node AS a, b.node AS b, a.k AS ka, b.k AS kb, count(*) AS c FROM x a JOIN x b ON a.h = b.h AND a.node <> b.node AND 10 * least(a.k, b.k) >= 9 * greatest(a.k, b.k) GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * c >= 90 * (ka + kb - c)),
r(id, root) AS (SELECT node, node FROM n UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
m AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT doc_id, coalesce(len(s.g), 0)::BIGINT AS n_shingles, coalesce(m.root, doc_id) AS component_id FROM s LEFT JOIN n ON n.g = s.g LEFT JOIN m ON m.id = n.node
"""
