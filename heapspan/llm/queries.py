"""The queries of the operators and the SQL that some of them can be checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import hash_mod, table


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_spans

    return repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, learn

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs.where(hash_mod("doc_id", 3) != 1)))
    return found.select("doc_id", (hash_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learn, toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity(docs, learn(docs, labels.where(hash_mod("doc_id", 4) != 2)))
    return found.select("doc_id", (hash_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge, rule_table

    return judge(table(spark, sf_dir, "pages"), rule_table(spark))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import link

    return link(table(spark, sf_dir, "conversations"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merge_dropout import encode

    return encode(table(spark, sf_dir, "documents"), emit="digest")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from . import chat, decontam, url_filter

    return {"op3_decontam": decontam.ORACLE, "op7_url_filter": url_filter.ORACLE, "op8_chat": chat.ORACLE}
