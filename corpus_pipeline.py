"""A training corpus from the documents, in stages; each reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heapspan.llm import decontam, langid, merge_dropout, simhash, suffix_dedup
from heapspan.llm.common import Store, hash_mod, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled documents are in."""
    return langid.keep_identified(docs, langid.learn(docs.where(hash_mod("doc_id", 3) != 1)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link at 3 or fewer differing bits."""
    return simhash.one_of_each_linked(docs)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 200-byte strings that also start elsewhere."""
    return suffix_dedup.repeated_spans(docs, emit="documents")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces, as counts and digests, and whether they decode to its text."""
    return merge_dropout.encode(docs, emit="digest")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_text", repeated_text), ("benchmark_leaks", benchmark_leaks), ("encoding", encoding)]

#: None: SQL has no cross-parsing, prefix-free parsing or merge-dropout. The tests hold the operator of each stage against a brute-force
#: version, and the whole against planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, docs = Store(spark, "pipeline"), table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = store.put(stage(spark, docs, sf_dir), name)
        if before:
            store.drop(before)  # its reader is written
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
