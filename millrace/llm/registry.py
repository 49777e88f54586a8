"""The operators as registered queries, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import fingerprints, hard_negatives, html_text, mixing, near_vectors, periodic_runs, pieces, quality, sharding, simhash, suffix_dedup, token_files, toxicity
from millrace.llm.common import documents, embeddings


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(documents(spark, sf_dir)).drop("rejected_by")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(documents(spark, sf_dir))
    return plan.taken().select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "first_slot")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    place, order = token_files.write_token_files(documents(spark, sf_dir), vocabulary, end_id=2)
    return token_files.read_token_files(spark, place, order)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign_shards(documents(spark, sf_dir), shards=40)
    return rows.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, lexicon)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), shingle=4, radius=4).drop("fp")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(documents(spark, sf_dir))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), length=50)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(embeddings(spark, sf_dir).withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(embeddings(spark, sf_dir), threshold=0.98)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = periodic_runs.with_planted_periods(documents(spark, sf_dir))
    return periodic_runs.run_digests(periodic_runs.periodic_runs(planted, least_length=6, least_exponent=4))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_source_mixing": op2_source_mixing,
    "op3_token_files": op3_token_files,
    "op4_sharding": op4_sharding,
    "op5_toxicity": op5_toxicity,
    "op6_simhash": op6_simhash,
    "op7_fingerprints": op7_fingerprints,
    "op8_html_text": op8_html_text,
    "op9_pieces": op9_pieces,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_near_vectors": op12_near_vectors,
    "op13_runs": op13_runs,
}

ORACLE: dict[str, str] = {
    "op1_quality_rules": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
win AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, h) AS n
  FROM (SELECT r, i, md5(array_to_string(w[i:i + 4], ' ')) AS h
        FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5))),
rep AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM win WHERE n > 1) GROUP BY r),
lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
s AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(regexp_extract_all(t, '\p{Lu}')) AS n_upper, len(regexp_extract_all(t, '\p{L}')) AS n_letters
  FROM d LEFT JOIN rep USING (r) LEFT JOIN lines USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > n_words OR word_chars < 2 * n_words OR word_chars > 25 * n_words
            OR n_dup_lines * 2 > n_lines OR n_upper * 2 > word_chars OR n_letters * 2 < word_chars) AS kept
FROM b""",
    "op2_source_mixing": r"""
WITH d AS (
  SELECT doc_id, source, md5('mix' || coalesce(doc_id::VARCHAR, '')) AS h,
         md5(coalesce(text, '')) AS text_key,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS weight
  FROM d GROUP BY source),
f AS (
  SELECT *, 2 * source_size AS cap, row_number() OVER (ORDER BY 2 * source_size / weight, source NULLS LAST) AS i FROM s),
g AS (
  SELECT *, 3 * sum(source_size) OVER () - 2 * coalesce(sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left2,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free
  FROM f),
e AS (SELECT left2 AS l, free AS w FROM g WHERE left2 * weight <= 2 * cap * free ORDER BY i LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN left2 * weight <= 2 * cap * free THEN (l * weight)::DOUBLE / (2 * w)::DOUBLE ELSE cap::DOUBLE END AS target
  FROM g, e),
u AS (
  SELECT *, greatest(ceil(source_size / b), 1)::BIGINT AS block, round(target)::BIGINT AS want
  FROM (SELECT *, greatest(ceil(source_size / 4096), least(source_size, 64), 1) AS b FROM t)),
v AS (SELECT *, ceil(want / block)::BIGINT AS slots FROM u),
i AS (SELECT *, sum(slots) OVER (ORDER BY source NULLS LAST)::BIGINT AS hi, sum(slots) OVER ()::BIGINT AS every FROM v),
n AS (
  SELECT k, list_sum(list_transform(range(0, 40), lambda e: ((k >> e) & 1) << (39 - e))) * every / 1099511627776.0 AS point
  FROM (SELECT DISTINCT every, unnest(range(0, (2 ** ceil(log2(2 * every)))::BIGINT)) AS k FROM i WHERE every > 0)),
r AS (
  SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY k) - 1 AS nth
  FROM n JOIN i ON point >= hi - slots AND point < hi),
p AS (
  SELECT d.doc_id, d.size, t.source, t.source_size, t.target, want, block,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id, text_key ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
  FROM d JOIN i AS t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT *, greatest(0, least(upto, want) - (upto - size)) + greatest(0, least(upto, want - source_size) - (upto - size)) AS taken
  FROM p)
SELECT doc_id, size, source_size, target, taken, k AS first_slot
FROM q LEFT JOIN r ON taken > 0 AND nth = (upto - size) // block AND q.source IS NOT DISTINCT FROM r.source""",
    # The text of an article, which every page of the tables has; differencing has no part in it.
    "op8_html_text": r"""
WITH a AS (
  SELECT row_number() OVER () AS r, page_id, url,
         regexp_extract(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<(script|style)\b.*?</(script|style)>', '', 'g'), '(?is)<article\b[^>]*>(.*?)(</article>|$)', 1) AS h
  FROM pages),
b AS (
  SELECT r, unnest(range(0, len(l))) AS i, unnest(l) AS t
  FROM (SELECT r, string_split_regex(h, '(?i)</?(p|h[1-6]|div|section|ul|ol|li|blockquote|pre|table|tr|td|th|hr)\b[^>]*>') AS l FROM a)),
c AS (
  SELECT r, i, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(
           regexp_replace(regexp_replace(t, '(?i)<br\b[^>]*>', ' ', 'g'), '<[^>]*>?', '', 'g'),
           '&quot;?', '"', 'g'), '&lt;', '<'), '&gt;', '>'), '&#39;', chr(39)), '&copy;', chr(169)), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS t
  FROM b),
x AS (SELECT r, string_agg(t, chr(10) || chr(10) ORDER BY i) AS text FROM c WHERE t <> '' GROUP BY r)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM a LEFT JOIN x USING (r)""",
    "op10_suffix_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, doc_id, unnest(range(0, len(h) // 2)) AS i, h FROM d),
w AS (SELECT r, doc_id, i, CASE WHEN len(h) >= 2 * i + 100 THEN substr(h, 2 * i + 1, 100) END AS s, substr(h, 2 * i + 1, 2) AS byte FROM p),
f AS (SELECT r, i, byte, s IS NOT NULL AND min(doc_id) OVER (PARTITION BY s) < doc_id AS hit FROM w),
g AS (SELECT r, i, byte, coalesce(i - max(CASE WHEN hit THEN i END) OVER (PARTITION BY r ORDER BY i) < 50, false) AS gone FROM f),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS begins FROM g),
k AS (SELECT r, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY r)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN k USING (r)""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT DISTINCT a.vec_id AS anchor_id, b.vec_id AS row_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v AS a JOIN v AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) AS i FROM s WHERE same) WHERE i <= 5),
n AS (
  SELECT anchor_id, p.row_id AS positive_id, s.row_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         (row_number() OVER (PARTITION BY anchor_id, p.row_id ORDER BY s.score DESC, s.row_id))::INTEGER AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
    "op12_near_vectors": """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (
  SELECT * FROM v
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e)
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.r AS a, b.r AS b FROM u AS a JOIN u AS b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT r AS s, r AS t FROM v UNION SELECT reach.s, l.b FROM reach JOIN l ON reach.t = l.a),
c AS (SELECT reach.s, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.t GROUP BY reach.s),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(v.vec_id = component_id, false) AS kept
FROM v JOIN c ON c.s = v.r LEFT JOIN n ON n.a = v.r""",
}
