"""A corpus pipeline of five stages: quality rules, language ID, near-dedup, benchmark decontamination, BPE.

Every stage reads all rows that its predecessor kept, from Parquet in the shared folder; all but the last return the columns
of documents. Repeated rows, nulls and empty tables are handled as each operator states.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidenta.llm import bpe, decontaminate, language, quality, simhash
from evidenta.llm.common import delete, fresh, numbered, read, scratch

#: A language is accepted from this score on.
LEAST_SCORE = 0.52


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    # a filter isn't pushed below a row number: pushed, it would repeat the nested measures many times over
    at = fresh(docs, "__at")
    found = quality.quality_rules(docs).withColumn(at, F.monotonically_increasing_id())
    return found.where(F.col("kept") & (F.col(at) >= 0)).select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language is hardly more likely than the next one, go."""
    model, whole = language.train(docs), fresh(docs, "__whole")
    return language.identify(docs.withColumn(whole, F.col("text")), model, whole).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row with the smallest doc_id stays (of equal ones the first)."""
    source, row = numbered(docs)
    component = fresh(source, "__component")
    found = simhash.near_duplicates(source.select(row, "doc_id", "text"), component=component)
    first = found.groupBy(component).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)).alias("m")).select(F.col(f"m.{row}").alias(row))
    return source.join(first, row, "left_semi").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which any window of a benchmark item occurs go."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark")).where("n_hit = 0").select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, their number and digests, and the digest of the text decoded again."""
    return bpe.bpe_round_trip(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality rules", quality_stage), ("language id", language_stage), ("simhash near-dedup", dedup_stage), ("benchmark decontamination", decontamination_stage), ("bpe", bpe_stage)]

#: Language ID, SimHash and BPE can't be said in SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again; what a stage has written is removed once the next one is."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
