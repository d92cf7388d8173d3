"""Thin queries over the operators of this package, with SQL twins where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerlake.llm import brown_lm, decontamination, language_id, license_scan, line_dedup, merkle, near_duplicates, packing, quality_rules, reply_trees, scratch, spelling, token_store, tokens, warc_archive
from kmerlake.llm.oracles import ORACLES as ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_folder(spark, "warc")
    warc_archive.write_archive(_table(spark, sf_dir, "pages"), path)
    return warc_archive.read_archive(spark, path).drop("header", "payload")


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_folder(spark, "tokens")
    token_store.write_shards(_table(spark, sf_dir, "documents"), path, tokens.default_vocabulary())
    return token_store.read_documents(spark, path)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score_documents(_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents")).drop("spans")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.fit(docs))
    return found.select("doc_id", F.coalesce(~language_id.learnable(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(_table(spark, sf_dir, "documents"))
    book = quality_rules.apply_policy(book, quality_rules.BASE, "_base")
    book = quality_rules.apply_policy(book, quality_rules.LENIENT)
    return book.selectExpr("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "NOT _base AS base_failed", "kept", "fail_bits")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], said.schema)
    path = scratch.new_folder(spark, "conversations")
    messages, links = reply_trees.linear(said.unionByName(added), "conv_id", "turn")
    reply_trees.write_conversations(messages, path, links=links)
    back = reply_trees.read_conversations(spark, path)
    said_back = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return back.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said_back, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), F.length("text").cast("long").alias("formatted_chars"),
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every 31st run, by the checksum of id and run, a letter is left out."""
    found = spelling.runs(_table(spark, sf_dir, "documents"), keep=("doc_id",))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    found = found.withColumn("h", F.crc32(name))
    word = F.when(F.col("h") % 31 == 0, spelling.without_letter(F.col("run"), F.col("h") % F.length("run"))).otherwise(F.col("run"))
    return spelling.group_variants(spelling.vocabulary(found.select(word.alias("word"))))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth row, by the checksum of its id, is claimed with its text in lower case."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    said = F.when(tampered, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    found = merkle.proofs(merkle.build(_table(spark, sf_dir, "documents"), claimed={"text": said}))
    return found.withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_warc": op2_warc,
    "op3_token_ids": op3_token_ids,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_license_scan": op6_license_scan,
    "op7_language_id": op7_language_id,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_decontamination": op10_decontamination,
    "op11_chat_format": op11_chat_format,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_merkle": op13_merkle,
}
