"""Readers and writers of the engine's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table by Spark's own Parquet reader, so that filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The table once it is written below spark.checkpoint.dir, for what reads it several times; as it is, if that isn't set."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        return df
    path = f"{folder.rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_json_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A JSON array or object per file, with an explicit schema."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_csv(df: DataFrame, path: str, separator: str = "; ") -> None:
    """All values quoted, array columns joined."""
    flat = [F.array_join(c, separator).alias(c) if t.startswith("array<") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.option("header", True).option("quoteAll", True).option("escape", '"').mode("overwrite").csv(path)


def write_vectors(df: DataFrame, path: str, key: str = "paper_id") -> None:
    """Replace the vector table, laid out by paper."""
    df.repartition(F.col(key)).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def manifest(spark: SparkSession, path: str, needed: tuple[str, ...] = ()) -> DataFrame:
    """(path, length, sha256) of every file below a path (S21); FileNotFoundError if a `needed` name isn't among them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if needed:
        there = {r[0] for r in files.select(F.element_at(F.split("path", "/"), -1)).where(F.element_at(F.split("path", "/"), -1).isin(*needed)).distinct().collect()}  # at most the needed names
        if missing := sorted({*needed} - there):
            raise FileNotFoundError(", ".join(missing))
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """(paperId, title, pdf_path, has_full_text) of PDF files below a path: an id by the path's digest, the title by the name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(path).select("path")
    stem = F.regexp_replace(F.url_decode(F.element_at(F.split("path", "/"), -1)), r"\.pdf$", "")
    return files.select(F.substring(F.sha2("path", 256), 1, 12).alias("paperId"), F.regexp_replace(stem, "[_-]+", " ").alias("title"), F.col("path").alias("pdf_path"), F.lit(True).alias("has_full_text"))


def html_report(df: DataFrame, title: str) -> str:
    """A small table as an HTML page, row by row, with all values escaped."""
    from html import escape

    cell = lambda v: escape("; ".join(map(str, v)) if isinstance(v, list) else "" if v is None else str(v))
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    rows = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in df.toLocalIterator())
    return f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1><table><tr>{head}</tr>{rows}</table>"
