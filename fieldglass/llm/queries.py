"""The queries of the corpus operators: each runs its operator over whole tables and returns its full result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, jaccard, langid, mixing, oracle, packing, pii, quality, runs, sharding, sketch, suffix_dedup, superminhash, token_store
from .common import documents


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(documents(spark, sf_dir))


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file; its place is a setting of the installed package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_documents(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), "byte", 2)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), "word", 0)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir), 4, (85, 100)).drop("component", "tag")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(documents(spark, sf_dir))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprint_documents(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.collapse_runs(documents(spark, sf_dir)).withColumn("collapsed_sha256", F.sha2("collapsed", 256)).drop("collapsed")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(documents(spark, sf_dir), 5, (85, 100)).drop("component", "tag")


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_quality": op3_quality,
    "op4_token_store": op4_token_store,
    "op5_packing": op5_packing,
    "op6_pii": op6_pii,
    "op7_jaccard": op7_jaccard,
    "op9_language": op9_language,
    "op8_fingerprints": op8_fingerprints,
    "op10_mixing": op10_mixing,
    "op11_runs": op11_runs,
    "op12_conversations": op12_conversations,
    "op13_superminhash": op13_superminhash,
}
ORACLE_SQL: dict[str, str] = {
    "op7_jaccard": oracle.groups(4, ""),
    "op11_runs": oracle.RUNS,
    "op12_conversations": oracle.CONVERSATIONS,
    "op13_superminhash": oracle.groups(5, ", doc_id = component_id AS kept"),
}
