"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns of
documents.  ``run`` writes each stage's result as Parquet into the shared folder and rereads it for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docveil.llm import decontam, packing, rules, secrets, simhash
from docveil.llm.common import stored, table

#: Not all stages can be said in SQL; tests hold them against brute force.
ORACLE_SQL = None
_TOKENIZER = "word_bpe_49k.json"
SHINGLE, SIMILARITY = 5, 0.8


def _as_before(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``; n_chars follows the text."""
    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return docs.select(*like.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their hosts' boilerplate lines."""
    return _as_before(rules.cleaned(docs), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the smallest id; of rows with that same id and text, one.

    Texts link where the sets of their five-word shingles have a Jaccard similarity of 0.8 or more.
    """
    found = simhash.alike(docs, SHINGLE, SIMILARITY)
    stays = found.where("doc_id = component_id and text_hash = component_hash").select(F.col("doc_id").alias("_stays"), F.col("text_hash").alias("_hash")).distinct()
    on = (docs["doc_id"].cast("long") == stays["_stays"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == stays["_hash"])
    # a null id can't be told from others: such rows stay
    kept = docs.join(stays, on).dropDuplicates(["_stays", "_hash"]).select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced."""
    return _as_before(secrets.redacted(docs), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing plan."""
    return packing.pack_documents(docs, public_tokenizers.path(_TOKENIZER))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_dedup),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
