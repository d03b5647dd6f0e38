"""The operators of this subpackage as queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, embeddings, langid, lines, mixing, quality, sharding, simhash, tokens, warc
from .durable import durable, remove, scratch

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_plan(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op3_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_slots(_table(spark, sf_dir, "documents"), [1.0] * 8, [1.0] * 9)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_embedding_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), path)
    out = durable(warc.summary(spark, path))
    remove(spark, path)
    return out


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs.filter(~langid.held_out(F.col("doc_id")))))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokenizer's file is that of the session's setting tablewright.tokenizer, if it has one."""
    path, ids_path = scratch(spark, "tokens"), scratch(spark, "token-ids")
    ids, eod = tokens.write_flat(_table(spark, sf_dir, "documents"), path, spark.conf.get("tablewright.tokenizer", tokens.TOKENIZER))
    ids.write.parquet(ids_path)
    if spark.read.parquet(ids_path).isEmpty():
        return spark.createDataFrame([], "doc_id long, n_tokens long")
    out = durable(tokens.counts(tokens.scan(tokens.flat_blocks(spark, path), eod), spark.read.parquet(ids_path)))
    remove(spark, path)
    remove(spark, ids_path)
    return out


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, sf_dir, "documents"))


def op10_line_dedup_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op10, but lines of fewer than 16 characters link with their exact copies and longer lines only."""
    return lines.dedup_lines(_table(spark, sf_dir, "documents"), {2: 16})


def queries() -> dict[str, Query]:
    return {
        "op1_quality_cotraining": op1_quality_cotraining,
        "op2_source_mixing": op2_source_mixing,
        "op3_rendezvous_sharding": op3_rendezvous_sharding,
        "op4_simhash": op4_simhash,
        "op5_embedding_caps": op5_embedding_caps,
        "op6_decontamination": op6_decontamination,
        "op7_warc": op7_warc,
        "op8_language_id": op8_language_id,
        "op9_token_counts": op9_token_counts,
        "op10_line_dedup": op10_line_dedup,
        "op10_line_dedup_whole": op10_line_dedup_whole,
    }


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0 AS u
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight,
    2.0::DOUBLE * source_size AS cap FROM s),
f AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size)::DOUBLE FROM s)
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / ((SELECT sum(weight) FROM w)
      - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS share
  FROM w),
t AS (
  SELECT source, source_size, CASE WHEN cap <= weight * share THEN cap
      ELSE weight * (SELECT max(share) FROM f WHERE NOT cap <= weight * share) END AS target FROM f),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM t),
c AS (
  SELECT source, source_size, target, floor(ratio) AS whole, target - floor(ratio) * source_size AS rest FROM r),
h AS (
  SELECT source, size, CAST(count(*) AS BIGINT) AS n FROM d WHERE size > 0 GROUP BY ALL),
g AS (
  SELECT h.source, size, (rest - coalesce(sum(size * n) OVER (PARTITION BY h.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) AS words,
    sum(size * size * n) OVER (PARTITION BY h.source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE AS squares
  FROM h JOIN c ON h.source IS NOT DISTINCT FROM c.source WHERE rest > 0),
k AS (
  SELECT source, coalesce(max(size) FILTER (words / squares * size < 1), 0) AS sure,
    arg_max(words / squares, size) FILTER (words / squares * size < 1) AS rate,
    arg_max(words, size) FILTER (words / squares * size < 1) AS words FROM g GROUP BY source),
o AS (
  SELECT d.*, c.source_size, c.target, c.whole, k.sure, k.words, rate * size AS p FROM d
  JOIN c ON d.source IS NOT DISTINCT FROM c.source LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source),
q AS (
  SELECT *, CASE WHEN size > 0 AND size <= sure THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM o),
z AS (
  SELECT *, sum(size) FILTER (q IS NOT NULL) OVER (PARTITION BY source, q IS NULL ORDER BY q / (1 + q) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(size) OVER (PARTITION BY source, q / (1 + q)) AS tied
  FROM q)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN size > sure OR (q IS NOT NULL AND (upto <= words OR (upto - tied < words AND upto - words < words - (upto - tied)))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM z
"""


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (
  SELECT a AS vec_id, b AS other FROM l
  UNION
  SELECT r.vec_id, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT vec_id, min(other) AS other FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(c.other, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(c.other, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""

OP6_SQL = r"""
WITH t AS (
  SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS pos,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, row_number() OVER (),
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
s AS (
  SELECT DISTINCT side, id, pos, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS x
  FROM t WHERE len(w) > 0),
n AS (SELECT pos, count(*) AS total FROM s WHERE side = 'i' GROUP BY pos),
p AS (
  SELECT d.id AS doc_id, d.pos AS d_pos, i.id AS item_id, i.pos AS i_pos, count(*) AS shared
  FROM s d JOIN s i ON d.x = i.x AND d.side = 'd' AND i.side = 'i' GROUP BY ALL)
SELECT doc_id, item_id, shared, total, shared / total AS containment
FROM p JOIN n ON n.pos = p.i_pos WHERE shared >= 0.8::DOUBLE * total
"""

OP7_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mixing": OP2_SQL, "op5_embedding_caps": OP5_SQL, "op6_decontamination": OP6_SQL, "op7_warc": OP7_SQL}
