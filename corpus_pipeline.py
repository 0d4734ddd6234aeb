"""Corpus pipeline: five stages from raw documents to a training mixture.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept; ``run`` writes
every stage's result as Parquet in the shared folder and reads it again for the next.

1. quality_classifier: documents whose quality score is under the threshold go.
2. near_duplicates: of each group of near duplicates (five words, similarity of 0.8 or more) the smallest id stays.
3. decontamination: documents that the contamination rule finds to hold benchmark passages go.
4. secret_scan: secrets are replaced by a mark in the text, n_chars is counted anew; all documents stay.
5. mixing: what the mixture holds: every selected document with its domain, tokens and number of copies.

Rows go to Python in batches of 2 MB, in every stage: a stage's work is done when its result is written, so the stages set this for
the session (``run`` takes it back).

All but the last return the columns of ``docs``, extra ones included. SQL can't express stages 1 and 4 (learnt models),
so there is no SQL twin; tests hold the pipeline against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.llm import decontaminate, mixing, neardup, quality, secrets
from tabsight.llm._text import BATCH_SETTING, crc_mod, ship, small_batches, written
from tabsight.session import read_table

SIMILARITY = (80, 100)


def _begin(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set(BATCH_SETTING, str(neardup.BATCH_BYTES))


def _narrow(docs: DataFrame) -> DataFrame:
    """Id and text beside the whole row, so that no column of ``docs`` meets one of an operator."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")


def _rows(found: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    return found.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return _rows(quality.score(_narrow(docs), model).where(F.col("score") >= quality.THRESHOLD), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return _rows(neardup.near_duplicates(_narrow(docs), SIMILARITY).where("kept"), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    found = decontaminate.find_items(_narrow(docs), read_table(spark, sf_dir, "benchmark"))
    return _rows(found.where(~decontaminate.contaminated()), docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    found = secrets.find_secrets(_narrow(docs), secrets.fit(docs))
    clean = found.withColumn("clean", secrets.redacted(F.col("text"), F.col("secrets.spans")))
    return _rows(clean, docs, text=F.col("clean"), n_chars=F.length("clean").cast("bigint"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return mixing.mix(docs).where("n_copies > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mixing", mixture),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    with small_batches(spark, neardup.BATCH_BYTES):
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
