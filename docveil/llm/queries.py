"""The contract queries: each applies its operator to the whole table with production parameters and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, lm, packing, pii, quality, resample, rules, secrets, simhash, spelling, tokenfiles, warc
from .common import table

#: The tokenizer files of the packing query and of the token files; pass others to the operators.
TOKENIZER, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train_quality(docs, table(spark, sf_dir, "labels")))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict_langid(docs, langid.train_langid(docs))


def _spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _digest(spans: Column) -> Column:
    return F.sha2(_spelled(spans).cast("binary"), 256)


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op5_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.detect_pii(table(spark, sf_dir, "documents")).select("doc_id", "spans", F.filter("spans", lambda s: s["base"]).alias("base"))
    base = F.col("base")
    counts = [_count(base, k) for k in ("email", "ip", "card", "phone")]
    return out.select("doc_id", *counts, _digest(base).alias("base_sha256"), _spelled(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan_secrets(table(spark, sf_dir, "documents")).select("doc_id", "spans", F.filter("spans", lambda s: s["kind"] != "novel").alias("base"))
    base = F.col("base")
    counts = [_count(base, k) for k in ("assign", "access", "hex")]
    return out.select("doc_id", *counts, _digest(base).alias("base_sha256"), _spelled(F.col("spans")).alias("spans"), _count(F.col("spans"), "novel"))


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.derive(warc.responses(table(spark, sf_dir, "pages")))
    return out.withColumn("block", F.col("block").cast("string"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenfiles.new_folder(spark)
    tokenfiles.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTES), path)
    return tokenfiles.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_best_fit_packing, op2_quality_classifier, op3_simhash_near_dedup, op4_language_id, op5_pii_weak_supervision, op6_lm_scoring, op7_quality_rules, op8_secret_scan, op9_warc_derivatives, op10_benchmark_decontamination, op11_token_files, op12_spelling_variants, op13_importance_resampling)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from . import sql

    return dict(sql.ORACLE)
