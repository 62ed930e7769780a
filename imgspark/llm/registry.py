"""The queries of this subpackage: opN_<name> and the pipeline, with SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from imgspark.llm import bpe, centroids, importance, licences, mixing, pages, quality, spans, trie, urlglob, webp, whitening
from imgspark.llm.partenum import jaccard_components


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lossless_webp(spark, sf_dir):
    return webp.media_digests(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark, sf_dir):
    return jaccard_components(_table(spark, sf_dir, "documents"), k=3, percent=90)


def op10_source_mixing(spark, sf_dir):
    plan = mixing.mix_plan(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), (F.col("_mix_copies") * F.col("_mix_size")).alias("taken"))


OP10_SQL = r"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), g AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS i FROM s GROUP BY source
), w AS (
  SELECT *, CASE i % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, (source_size * 3)::DOUBLE AS cap FROM g
), lv AS (
  SELECT *, ((SELECT sum(source_size) FROM g)::DOUBLE - coalesce(sum(cap) OVER before, 0)) / ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER before, 0)) AS level
  FROM w WINDOW before AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, (SELECT arg_min(level, cap / w) FROM lv WHERE level * w <= cap) * w) AS target FROM lv
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0 END AS rate FROM t
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM s JOIN r ON s.source IS NOT DISTINCT FROM r.source
"""


def op3_sentence_spans(spark, sf_dir):
    return spans.span_report(_table(spark, sf_dir, "documents"))


def op4_importance_resampling(spark, sf_dir):
    return importance.importance_sample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_token_counts(spark, sf_dir, vocabulary=None):
    """vocabulary: path of the piece file, the same on every machine."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    return trie.token_counts(_table(spark, sf_dir, "documents"), vocabulary)


def op7_licence_scan(spark, sf_dir):
    return licences.licence_report(_table(spark, sf_dir, "documents"))


def op5_url_filters(spark, sf_dir):
    return urlglob.judge(_table(spark, sf_dir, "pages"))


def op8_quality_rules(spark, sf_dir):
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op9_bpe_encoding(spark, sf_dir, vocabulary=None):
    """vocabulary: path of the tokenizer file, the same on every machine."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encoded_digests(_table(spark, sf_dir, "documents"), vocabulary)


def op11_embedding_whitening(spark, sf_dir):
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_centroid_clustering(spark, sf_dir):
    return centroids.cluster_report(_table(spark, sf_dir, "embeddings"))


def op13_html_extraction(spark, sf_dir):
    return pages.extract(_table(spark, sf_dir, "pages"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    ops = [op1_lossless_webp, op2_ngram_jaccard_join, op3_sentence_spans, op4_importance_resampling, op5_url_filters, op6_token_counts, op7_licence_scan, op8_quality_rules, op9_bpe_encoding, op10_source_mixing, op11_embedding_whitening, op12_centroid_clustering, op13_html_extraction]
    return {"pipeline": pipeline} | {f.__name__: f for f in ops}


def oracle_sql():
    return {"op5_url_filters": urlglob.SQL, "op8_quality_rules": quality.sql(), "op10_source_mixing": OP10_SQL, "op12_centroid_clustering": centroids.SQL}
