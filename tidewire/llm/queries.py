"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import ann, conversations, embed_dedup, lines, manifest, mixing, packing, pii, quality, simhash, sql, token_counts, token_store, toxicity
from tidewire.llm.common import table


def op1_ann_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where("vec_id % 20 = 0"), k=20)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_huffman_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(table(spark, sf_dir, "documents"))


def op6_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_token_count_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.restored(table(spark, sf_dir, "documents"))


def op10_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired_summaries(table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.kept_digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_ann_adaptive_scan, op2_embedding_near_dedup, op3_best_fit_packing, op4_source_mixing, op5_huffman_token_store,
    op6_pii_bootstrap, op7_toxicity_ordinal, op8_simhash_near_dedup, op9_token_count_rollups, op10_quality_discriminant,
    op11_conversation_repair, op12_merkle_manifest, op13_line_dedup,
)}

#: The mixture: the same hash places, one running sum instead of nested histograms.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 9) AS BIGINT) AS place
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0 * CAST(sum(size) AS DOUBLE) AS cap FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
             sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_,
             CAST(sum(source_size) OVER () AS DOUBLE) AS everything FROM w),
l AS (SELECT *, (1.5 * everything - full_) / open_ AS level FROM o),
m AS (SELECT *, max(CASE WHEN level * weight <= cap THEN level END) OVER () AS below FROM l),
t AS (SELECT source, source_size, least(cap, coalesce(below * weight, cap)) AS target FROM m),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT *, target - whole * source_size AS rest FROM g),
p AS (SELECT source, place, sum(size) AS size FROM d GROUP BY source, place),
c AS (SELECT p.*, sum(size) OVER (PARTITION BY source ORDER BY place) AS upto FROM p),
e AS (SELECT c.source, min(CASE WHEN upto > rest THEN c.place + CASE WHEN c.size < 2 * (rest - upto + c.size) THEN 1 ELSE 0 END END) AS edge
      FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source GROUP BY c.source)
SELECT doc_id, size, r.source_size, r.target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE size * (whole + CASE WHEN rest > 0 AND (edge IS NULL OR place < edge) THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""

SQL = {"op4_source_mixing": MIX_SQL, "op11_conversation_repair": sql.CONVERSATIONS, "op12_merkle_manifest": sql.MANIFEST, "op13_line_dedup": sql.LINES}
