"""A training corpus from documents: filtered, deduplicated, decontaminated, tokenized.

Each stage takes all that its predecessor kept and returns the columns of
documents; the last one returns tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillframe.llm import bpe, decontaminate, language, minhash, quality
from quillframe.llm.queries import PREDICTED_FROM, TOKENIZER, language_model, quality_model, table
from quillframe.scratch import written
from quillframe.session import bound_batches

#: Python workers go from stage to stage and keep what memory the largest batch took,
#: so texts travel in smaller batches here than in a query of one operator.
BATCH_BYTES = 6 << 20


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a text, go."""
    bound_batches(spark, BATCH_BYTES)
    found = language.identify(docs, language_model(docs))
    return found.where(F.col("lang_pred") != language.UNDETERMINED).select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a low predicted quality go."""
    bound_batches(spark, BATCH_BYTES)
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).where(F.col("quality_score") >= PREDICTED_FROM).select(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays."""
    bound_batches(spark, BATCH_BYTES)
    return minhash.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    bound_batches(spark, BATCH_BYTES)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document, and the digest of what they decode to."""
    bound_batches(spark, BATCH_BYTES)
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), TOKENIZER).drop("text")
    return bpe.decode(encoded, TOKENIZER).select(
        "doc_id", "lang", "source", "n_tokens", "token_ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_tokens", bpe_tokens),
]

#: SQL can't express the learned stages; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
