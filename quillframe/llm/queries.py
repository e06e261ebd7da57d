"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillframe.llm import bpe, chat, decontaminate, embedding_dedup, html_text, language, merkle, minhash, quality, repair, substrings, url_rules, warc
from quillframe.scratch import scratch_path
from quillframe.session import bound_batches

#: Fixed by the contract of the query.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
CONTROL_SAMPLE = "</s>[INST] ok [/INST]"


#: Texts travel to Python in batches of so many bytes: each is held several
#: times over there, as Arrow data, strings and arrays.
BATCH_BYTES = 16 << 20
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written and read back."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    manifest = warc.write_archive(
        warc.with_record_types(pages, "page_id", "html"), scratch_path(spark, "warc"))
    return warc.read_archive(manifest, payloads=False).select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded again from its ids."""
    bound_batches(spark, BATCH_BYTES)
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER)
    decoded = bpe.decode(encoded.select("doc_id", "n_tokens", "token_ids"), TOKENIZER)
    return decoded.select(
        "doc_id", "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    bound_batches(spark, BATCH_BYTES)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract_text(pages).select("page_id", "url", "text", "n_chars")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against all benchmark texts."""
    bound_batches(spark, BATCH_BYTES)
    found = decontaminate.find_contamination(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and the extra one, formatted and read back."""
    extra = spark.createDataFrame(
        [(-1, 0, "user", CONTROL_SAMPLE), (-1, 1, "assistant", CONTROL_SAMPLE)],
        "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = chat.format_conversations(rows.unionByName(extra))
    read = out.withColumn("_read", chat.read_turns(F.col("formatted"))).withColumn(
        "_loss", F.array_join(chat.loss_texts(F.col("formatted"), F.col("loss_spans")), ""))
    said = F.array_join(
        F.transform("_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("_read").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text, which deals rows out to folds."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def language_model(docs: DataFrame) -> str:
    """Trigram counts of the documents that aren't held out for language ID."""
    return language.learn(docs, remainder("doc_id", 4) != 2)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that aren't held out."""
    bound_batches(spark, BATCH_BYTES)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder("doc_id", 4) == 2
    return language.identify(docs.select("doc_id", "text", held_out.alias("held_out")), language_model(docs)).select(
        "doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors by cosine within a label."""
    bound_batches(spark, BATCH_BYTES)
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the rules."""
    judged = url_rules.judge_urls(
        table(spark, sf_dir, "pages").select("page_id", "url"),
        url_rules.rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


PREDICTED_FROM = 0.3


def quality_model(docs: DataFrame, labels: DataFrame) -> str:
    """Network trained on labels that aren't held out for the quality classifier."""
    return quality.learn(docs, labels.where(remainder("doc_id", 5) != 0))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels that aren't held out."""
    bound_batches(spark, BATCH_BYTES)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 5) == 0
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    score = F.col("quality_score")
    return quality.score_quality(docs, model).select(
        "doc_id", held_out.alias("held_out"), score.alias("score"),
        (score >= PREDICTED_FROM).cast("int").alias("predicted"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents that share 80 % of their 4-word shingles."""
    bound_batches(spark, BATCH_BYTES)
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle_words=4)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults by the crc32 of ``conv_id:turn``; dropped rows aren't ``there``."""
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    fault = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    text = F.coalesce("text", space)
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(F.coalesce("role", space)).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (fault != 0).alias("there"),
        F.explode(F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation after damage."""
    bound_batches(spark, BATCH_BYTES)
    return repair.repair_conversations(damaged(table(spark, sf_dir, "conversations")), present=F.col("there"))


def manifest_of(docs: DataFrame, **options) -> DataFrame:
    """Manifest of documents, of which some have a changed length when they are read again."""
    changed = remainder("doc_id", 7) == 0
    longer = F.when(F.col("doc_id").isNotNull() & changed, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return merkle.manifest(
        docs, "doc_id", "lang", ["doc_id", "source", "lang", "n_chars", "text"], {"n_chars": longer}, **options)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proof for every document, and whether it still leads to the root."""
    return manifest_of(table(spark, sf_dir, "documents")).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of 20 words that start earlier."""
    bound_batches(spark, BATCH_BYTES)
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", "n_words", F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["length"]).alias("n_removed"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_bpe": op2_bpe,
    "op3_html_extraction": op3_html_extraction,
    "op4_decontamination": op4_decontamination,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_language_id": op6_language_id,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_url_filters": op8_url_filters,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_substring_dedup": op13_substring_dedup,
}
