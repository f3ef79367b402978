"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from shelflight.llm import (
    attention_lm,
    chunk_dedup,
    decontamination,
    exact_dedup,
    hard_negatives,
    mixing,
    packing,
    quality,
    simhash,
    spelling,
    token_count,
    token_files,
    url_filter,
)


def _run(
    query: Callable[[SparkSession, str], DataFrame], spark: SparkSession, sf_dir: str
) -> DataFrame:
    """Run a query with this tree on the Python workers' path, as the driver has it.

    Where workers do not see the driver's folders, ship the package to them instead.
    """
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if root not in paths:
        paths = [root, *filter(None, paths)]
        spark.sparkContext.environment["PYTHONPATH"] = ":".join(paths)
    return query(spark, sf_dir)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_distribution_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"))


def op2_heap_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_table(spark, sf_dir, "documents"))


def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.passages(_table(spark, sf_dir, "documents"))


def op4_url_model_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), sample=None)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))
    return found.drop("chars", "text_key")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op7_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op9_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.lm_scores(_table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_wu_manber_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return decontamination.contamination(documents, _table(spark, sf_dir, "benchmark"))


def op13_strassen_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


_PLANS = {
    "op1_distribution_quality": op1_distribution_quality,
    "op2_heap_token_counts": op2_heap_token_counts,
    "op3_chunk_dedup": op3_chunk_dedup,
    "op4_url_model_ratio": op4_url_model_ratio,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_huffman_token_files": op7_huffman_token_files,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_attention_scores": op9_attention_scores,
    "op10_source_mixing": op10_source_mixing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_wu_manber_contamination": op12_wu_manber_contamination,
    "op13_strassen_hard_negatives": op13_strassen_hard_negatives,
    "pipeline": corpus_pipeline.run,
}

QUERIES = {name: partial(_run, plan) for name, plan in _PLANS.items()}

ORACLES = {
    "op5_exact_dedup": r"""
WITH read AS (
  SELECT doc_id, coalesce(length(text), 0) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), ranked AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (
           PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM read
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
""",
    "op10_source_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, md5('7:' || CAST(doc_id AS VARCHAR)) AS place,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE
           AS weight
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST) AS nth
  FROM sources
), levels AS (
  SELECT *, (1.5 * (SELECT sum(source_size) FROM sources)
             - coalesce(sum(2.0 * source_size) OVER (
                 ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
            AS level
  FROM ordered
), level AS (
  SELECT coalesce(min_by(level, nth), 1e300) AS level
  FROM levels WHERE weight * level < 2.0 * source_size
), planned AS (
  SELECT source, source_size, round(least(2.0 * source_size, weight * level.level), 6) AS target
  FROM ordered, level
), split AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs
  FROM planned
), running AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, s.epochs,
         s.target - s.epochs * s.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id
                          ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized d JOIN split s ON d.source IS NOT DISTINCT FROM s.source
), counted AS (
  SELECT *, CAST(epochs AS BIGINT)
            + CASE WHEN rest > 0 AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END AS copies
  FROM running
)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, copies
FROM counted
""",
    "op12_wu_manber_contamination": r"""
WITH items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), cut AS (
  SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS place
  FROM items WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS size,
         array_to_string(w[place:place + 9], ' ') AS passage
  FROM cut
), docs AS (
  SELECT row_number() OVER () AS nth, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), sizes AS (
  SELECT DISTINCT size FROM windows
), starts AS (
  SELECT nth, size, w, unnest(generate_series(1, len(w) - size + 1)) AS place
  FROM docs, sizes WHERE len(w) >= size
), passages AS (
  SELECT nth, size, place, array_to_string(w[place:place + size - 1], ' ') AS passage FROM starts
), found AS (
  SELECT p.nth, p.place, p.size, i.item FROM passages p JOIN windows i USING (passage, size)
), hits AS (
  SELECT nth, count(DISTINCT word) AS n_hit FROM (
    SELECT nth, unnest(generate_series(place, place + size - 1)) AS word
    FROM (SELECT DISTINCT nth, place, size FROM found)
  ) GROUP BY nth
), listed AS (
  SELECT nth, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT nth, item FROM found) GROUP BY nth
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (nth) LEFT JOIN listed USING (nth)
""",
    "op13_strassen_hard_negatives": r"""
WITH rows AS (
  SELECT DISTINCT vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS alike,
         CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM rows a JOIN rows c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT)
         AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
""",
}
