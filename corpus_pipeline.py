"""A training-data pipeline: quality rules, n-gram Jaccard join, PII, mixing sources to target weights, BPE encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.bpe import encode_decode
from lodestar.llm.common import numbered, table, written
from lodestar.llm.jaccard import linked_groups
from lodestar.llm.mixing import mixed_documents
from lodestar.llm.pii import sanitise
from lodestar.llm.quality import filter_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    return filter_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles with a similarity of 0.8 or more, the document with the smallest id stays. Rows that share an id stay or go together; equal rows become one."""
    groups = written(linked_groups(docs, n=5, num=80, den=100), "groups")
    ids = groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"))
    gone = written(ids.where("not kept").select(F.col("doc_id").alias("_id")), "gone")
    again = written(ids.where("rows > 1").select(F.col("doc_id").alias("_id")), "repeated")
    plain, at = numbered(docs)
    same = F.col(at["doc_id"]).eqNullSafe(F.col("_id"))
    kept = plain.join(gone, same, "left_anti")
    if again.isEmpty():
        return kept.toDF(*docs.columns)
    # only rows that share an id are compared as a whole
    once = kept.join(again, same, "left_semi").dropDuplicates([at["doc_id"], at["text"]])
    return kept.join(again, same, "left_anti").unionByName(once).toDF(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities become labels; terms that reveal them are generalised or removed."""
    return sanitise(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass of the mix that takes words of a document, its text cut to those words."""
    return mixed_documents(docs).withColumn("n_chars", F.length("text").cast("long"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, as little-endian unsigned 32-bit integers, and the text that they decode to."""
    return encode_decode(docs).select("doc_id", "n_tokens", "ids", F.col("decoded").cast("string").alias("decoded"))


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("PII", personal_data), ("mixing sources to target weights", mixing), ("BPE encoding and decoding", encoding)]

#: The learned rules, the terms' hashes, the mix's draws and the tokenizer have no SQL; tests/llm holds each stage against brute force on what the stage before gave it: the base rules of the first, not its learned ones.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
