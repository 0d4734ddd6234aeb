"""Registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.llm import (conversation_repair, decontaminate, fingerprints, language_model, licenses, mixing, neardup, prefix_trie, quality, secrets, site_tree, sql,
                          suffixes, urls)
from tabsight.llm._text import crc_mod, ship
from tabsight.session import read_table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_items(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "hits.n_words", decontaminate.n_hit().alias("n_hit"), F.size("hits.items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = suffixes.remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("bigint").alias("n_removed"),
                        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, secrets.fit(docs))
    return found.select("doc_id", "secrets.n_assign", "secrets.n_access", "secrets.n_hex",
                        F.sha2(secrets.listed(F.col("secrets.spans"), secrets.KINDS[:3]), 256).alias("base_sha256"),
                        secrets.listed(F.col("secrets.spans")).alias("spans"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = neardup.classes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod("doc_id", 5) == 0
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), ~held_out)
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = licenses.find_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "license.n_words", "license.n_base", "license.first_word", "license.last_word",
                        F.array_join("license.base_labels", ",").alias("base_labels"), F.array_join("license.labels", ",").alias("labels"), "license.score")


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = language_model.score(read_table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2)
    return found.withColumnRenamed("id", "doc_id")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_neighbours(read_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix(docs).select("doc_id", "domain", "lang", "source", "n_tokens", "n_copies")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return site_tree.extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return prefix_trie.build(read_table(spark, sf_dir, "conversations"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return conversation_repair.repair(read_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_repeated_passages, op3_secret_scan, op4_url_filter, op5_near_duplicates, op6_quality, op7_license_scan, op8_language_model, op9_fingerprints, op10_mixing,
                                    op11_html_extraction, op12_prefix_trie, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
