"""One query an operator, over its whole table, in the columns its contract names."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlake.llm import (bpe, collocations, fingerprints, lm, negatives, neighbours, packing, quality, repeats,
                            secrets, sharding, simhash, slack)
from basketlake.llm.common import documents, table

SHARDS = 40
QUALITY_LEAST = 0.3


def _remainder(modulus: int) -> Column:
    """crc32 of the id as text, modulo a number; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def byte_encoder():
    """Ids of the public byte-level vocabulary: its rank file, and the added tokens of its JSON file."""
    return packing.rank_file_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                                     packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


def op1_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score_documents(documents(spark, folder), _remainder(10) == 0)


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(documents(spark, folder), byte_encoder())


def op3_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.near_vectors(table(spark, folder, "embeddings"))


def op4_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_documents(documents(spark, folder))


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Law ``key``: the document id and the number of shards decide; a 41st shard only takes rows."""
    rows = sharding.shard_documents(documents(spark, folder), sharding.regular_tree(SHARDS),
                                    sharding.regular_tree(SHARDS + 1))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    model = quality.train(docs, table(spark, folder, "labels"), _remainder(5) != 0)
    return quality.scored(docs, model).select(
        "doc_id", (_remainder(5) == 0).alias("held_out"), "score",
        (F.col("score") >= QUALITY_LEAST).cast("int").alias("predicted"))


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.repeated_words(documents(spark, folder))


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, folder))


def op9_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = simhash.near_duplicates(documents(spark, folder))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, folder),
                                public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_min_slack_packing(spark: SparkSession, folder: str) -> DataFrame:
    return slack.pack_documents(documents(spark, folder), byte_encoder())


def op12_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(documents(spark, folder))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of every seventh id are moved on by one; every hundredth id is an anchor."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, folder, "embeddings"), label, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_document_fingerprints": op4_document_fingerprints,
    "op5_sharding": op5_sharding,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_min_slack_packing": op11_min_slack_packing,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_hard_negatives": op13_hard_negatives,
}

OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM lists),
runs AS (SELECT lang, ws, i, unnest([1, 2, 3, 4]) AS k FROM starts),
grams AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM runs WHERE i + k - 1 <= len(ws) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM grams WHERE k > 1 AND f >= 30),
inner_places AS (
  SELECT lang, a, k, ws, unnest(range(1, k + 1)) AS i FROM candidates),
inner_phrases AS (
  SELECT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest([2, 3]) AS m FROM inner_places) WHERE m < k AND i + m - 1 <= k),
longest AS (SELECT lang, phrase, max(a) AS longer FROM inner_phrases GROUP BY ALL),
kept AS (
  SELECT c.* FROM candidates c LEFT JOIN longest USING (lang, phrase)
  WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * c.a::HUGEINT),
cuts AS (
  SELECT lang, phrase, a, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS j FROM kept)),
parts AS (
  SELECT c.lang, c.phrase, c.a, c.j, h.f AS l, t.f AS r, ((2000000 * c.a::HUGEINT) // (h.f + t.f)::HUGEINT)::BIGINT AS score
  FROM cuts c JOIN grams h ON h.lang = c.lang AND h.phrase = c.head AND h.k = c.j
  JOIN grams t ON t.lang = c.lang AND t.phrase = c.tail AND t.k = len(string_split(c.tail, ' '))),
least AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
best AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score
FROM best JOIN totals USING (lang) WHERE rank <= 2000
"""

OP13_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         list_inner_product(a.v, b.v)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
negatives AS (
  SELECT p.anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
  WHERE 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 5
"""

ORACLES: dict[str, str] = {
    "op12_phrase_collocations": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
