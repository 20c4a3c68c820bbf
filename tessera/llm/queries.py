"""One query for each operator, over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import embedding_dedup, language_id, line_dedup, near_dup, oracles, packing, quality_classifier, quality_rules, sentence_pieces, sharding, substring_dedup
from tessera.llm.scratch import Scratch, small_batches


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return embedding_dedup.link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.98)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = line_dedup.remove(docs, counted=True)
    return kept.select("doc_id", "n_removed", F.octet_length("text").cast("long").alias("kept_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dup.link(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), size=2, percent=80)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), packing.every_capacity(1024))


def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path = tokenizer_file("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    back = sentence_pieces.decode(sentence_pieces.encode(docs, path), path)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return substring_dedup.digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), 50)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(docs.select("doc_id", "text", "lang").where(~language_id.held_out()))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality_classifier.fit(docs, labels.where(~language_id.held_out()))
    found = quality_classifier.score(docs, model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "score", "predicted")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    narrow = docs.select(
        "doc_id",
        sharding.text_size().alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("text_hash"),
    )
    rows = Scratch(spark, "shards").table(narrow, "rows")
    out = sharding.assign(rows, 8, group="text_hash", id_col="doc_id", size="size")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    book = quality_rules.apply_policy(quality_rules.ledger(docs), "v1")
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dup": embedding_dedup.ORACLE_SQL, "op3_minhash_near_dup": oracles.NEAR_DUP, "op6_substring_dedup": substring_dedup.ORACLE_SQL, "op10_quality_rules": quality_rules.ORACLE_SQL}
