"""Registered queries of the corpus operators: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from statlake.llm import chat, collocations, url_filter, warc
from statlake.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statlake.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statlake.llm.mixing import mixed_draws

    return mixed_draws(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statlake.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statlake.llm.classifier import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statlake.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statlake.llm.chat import conversation_digests, with_probe

    return conversation_digests(with_probe(table(spark, sf_dir, "conversations")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statlake.llm.url_filter import judge_urls, rules_table

    return judge_urls(table(spark, sf_dir, "pages"), rules_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statlake.llm.quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statlake.llm.warc import archive_report

    return archive_report(table(spark, sf_dir, "pages")).drop("url")


def op10_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statlake.llm.search import bm25_search, stated_queries

    docs = table(spark, sf_dir, "documents")
    return bm25_search(docs, stated_queries(docs))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statlake.llm.repair import damaged, repair_digests

    return repair_digests(damaged(table(spark, sf_dir, "conversations")))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statlake.llm.embedding_dedup import embedding_dedup

    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_simhash, op2_mixing, op3_packing, op4_quality_classifier, op5_suffix_dedup, op6_chat_format, op7_url_filter,
    op8_quality_rules, op9_warc, op10_bm25_search, op11_collocations, op12_conversation_repair, op13_embedding_dedup, pipeline)}

#: DuckDB text of the queries that SQL can express on whole tables.
ORACLE: dict[str, str] = {"op6_chat_format": chat.ORACLE_SQL, "op7_url_filter": url_filter.ORACLE_SQL,
                          "op9_warc": warc.ORACLE_SQL, "op11_collocations": collocations.ORACLE_SQL}
