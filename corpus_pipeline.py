"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result and reads it back as
the next stage's documents. All stages but the last return the columns of documents.

Decisions are made for rows, not for doc_ids: rows without a doc_id, or with one that comes twice, are judged by their
own text. Each stage's docstring says what it does with null and empty texts, ties and repeated rows; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm import jaccard, mixing, packing, pii, quality
from fieldglass.llm.common import Scratch, free_names
from fieldglass.llm.queries import tokenizer_file


def _tag(*columns: str) -> Column:
    """A digest of a row's columns, told from other rows' also where they are null."""
    parts = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.md5(F.concat(*parts).cast("binary")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the robust outlier test keep.

    Null and empty texts fail the base rule and go. A verdict depends on text, language and source, so that equal rows
    stay or go together.
    """
    tag = _tag("doc_id", "text", "lang", "source")
    kept = quality.quality_verdicts(docs, tag=tag).filter("kept").select(F.col("tag").alias("_tag"))
    return docs.join(kept, tag == kept["_tag"], "left_semi")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more.

    The smallest doc_id stays (a null one only where there is no other), of equal ones the row with the least digest,
    of equal rows one. Texts without words are linked with nothing and stay, repeated ones too.
    """
    tag = _tag("doc_id", "text")
    groups = jaccard.jaccard_components(docs, 5, (80, 100), tag=tag).filter("component IS NOT NULL")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "tag")).alias("x")
    first = groups.groupBy("component").agg(least).select(F.col("x.tag").alias("_tag"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    (row,) = free_names(docs, "_row")
    chosen = docs.filter(worded).withColumn(row, tag)
    chosen = chosen.join(first, chosen[row] == first["_tag"], "left_semi").dropDuplicates([row]).drop(row)
    return chosen.unionByName(docs.filter(~worded))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in the texts replaced by its kind; null and empty texts stay as they are."""
    return pii.redact_documents(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the mixed order of their sources' blocks; equal rows stand together, a null source is a source."""
    return mixing.mixed_order(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences of 2048 tokens, numbered in the mixed order.

    Files needn't be read in the order of their rows, so the places in the mixed order, which follow from the documents
    alone, are taken from the mixing operator again. Null texts hold the end id; each row is a document of its own.
    """
    (position,) = free_names(docs, "_position")
    placed = mixing.with_positions(docs, position)
    return packing.pack_documents(placed, tokenizer_file("word_bpe_49k.json"), "word", 0, order=position)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources", source_mixing),
    ("best-fit packing", best_fit_packing),
]
#: Robust estimates, tokenizers and search can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tmp = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = tmp.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
