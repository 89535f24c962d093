"""Training-data pipeline over ``documents``: five operators, one stage each.

Stages talk through Parquet tables. Null and empty texts, null and repeated ids, repeated rows and columns
of any other names pass through them as any row does; an empty table stays empty. All but the last return the columns of the documents; the last
returns the token sequences that the kept texts are packed into.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlake.llm import packing, quality, repeats, secrets, simhash
from basketlake.llm.common import carried, documents, table, written

QUALITY_LEAST = 0.3


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is such a column, follows the changed text."""
    if "n_chars" not in docs.columns:
        return docs
    size = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return docs.withColumn("n_chars", F.coalesce(size, F.col("n_chars")))


def quality_classifier(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keeps documents that the classifier, trained on the labels of most of them, does not reject."""
    learnable = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 0
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    model = quality.train(own, table(spark, folder, "labels"), learnable)
    packed, back = carried(docs)
    return back(quality.scored(packed, model).where(F.col("score") >= QUALITY_LEAST))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    return simhash.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Removes words of passages that occur earlier; a text without them stays as it is."""
    return _counted(repeats.without_repeats(docs))


def secret_scans(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Replaces secrets in the texts; every document stays."""
    return _counted(secrets.redact_secrets(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Packs the texts' token ids into sequences of at most 1024."""
    special = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = packing.rank_file_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special)
    return packing.pack_documents(docs, encoder)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

# SQL cannot express the trained classifier, the tokenizer or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
