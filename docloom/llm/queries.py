"""Queries opN_<name> over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import line_dedup, mixing, packing, quality_classifier, quality_rules, simhash_dedup, substring_dedup, token_counts, topk_search, toxicity
from docloom.llm.common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(*(table(spark, sf_dir, t) for t in ("documents", "labels", "pages")))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_topk_search, op2_line_dedup, op3_token_counts, op4_quality_rules, op5_substring_dedup, op6_quality_classifier, op7_source_mix, op8_simhash_dedup, op9_packing, op10_toxicity)}


LINE_DEDUP_SQL = r"""
WITH docs AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), pos AS (
  SELECT doc_id, unnest(range(len(lines))) AS i, unnest(lines) AS line FROM docs
), keyed AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM pos
), firsts AS (
  SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k
), judged AS (
  SELECT y.doc_id, y.i, y.line, f.owner IS NOT NULL AND f.owner <> y.doc_id AS dropped FROM keyed y LEFT JOIN firsts f ON y.k = f.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

SOURCE_MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS weight,
    row_number() OVER (ORDER BY source NULLS LAST) AS r, 3 * source_size AS cap FROM per
), running AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
    coalesce(sum(cap) OVER w, 0) AS cap_before, coalesce(sum(weight) OVER w, 0) AS weight_before
  FROM ranked WINDOW w AS (ORDER BY CAST(cap AS DOUBLE) / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), flagged AS (
  SELECT *, (total - cap_before) * weight >= cap * (all_weight - weight_before) AS capped FROM running
), levels AS (
  SELECT *, total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0) AS rest,
    all_weight - coalesce(sum(CASE WHEN capped THEN weight END) OVER (), 0) AS rest_weight FROM flagged
), targets AS (
  SELECT source AS of_source, source_size,
    CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(weight AS DOUBLE) * CAST(rest AS DOUBLE) / CAST(rest_weight AS DOUBLE) END AS target FROM levels
), rated AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
    coalesce(t.target / CASE WHEN t.source_size > 0 THEN CAST(t.source_size AS DOUBLE) END, 0.0) AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.of_source
), drawn AS (
  SELECT *, unnest(range(64)) AS seed FROM rated
), taken AS (
  SELECT *, size * CAST(floor(rate) + CASE WHEN CAST(CAST('0x' || substr(sha256(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(seed // 8 AS VARCHAR)), CAST(8 * (seed % 8) + 1 AS BIGINT), 8) AS BIGINT) AS DOUBLE)
    < (rate - floor(rate)) * 4294967296.0 THEN 1 ELSE 0 END AS BIGINT) AS taken FROM drawn
), best AS (
  SELECT source, arg_min(seed, (off, seed)) AS seed FROM (
    SELECT source, seed, abs(CAST(sum(taken) AS DOUBLE) - max(target)) AS off FROM taken GROUP BY source, seed) GROUP BY source
)
SELECT t.doc_id, t.size, t.source_size, t.target, t.taken
FROM taken t JOIN best b ON t.source IS NOT DISTINCT FROM b.source AND t.seed = b.seed
"""


TOPK_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, q.x, c.vec_id, CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0) q JOIN v c ON q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id, x ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": TOPK_SQL, "op2_line_dedup": LINE_DEDUP_SQL, "op7_source_mix": SOURCE_MIX_SQL}
