"""Windows over words and budgets over ordered passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidenta.functions.text import SPACE, text_of, words


def chunk_windows(df: DataFrame, key: str, text: str, size: int = 220, overlap: int = 40) -> DataFrame:
    """(key, chunk_index, n_words, chunk): sliding windows of words (F10); the last one ends with the text."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be shorter than a window")
    step = size - overlap
    w = df.select(key, words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.size("w") - overlap - 1, F.lit(0)) / step).cast("int"))
    cut = w.select(key, F.posexplode(F.transform(starts, lambda i: F.slice("w", i * step + 1, size))).alias("chunk_index", "part"))
    return cut.select(key, "chunk_index", F.size("part").alias("n_words"), F.array_join("part", " ").alias("chunk"))


def running_budget(df: DataFrame, partition: str, order: list, weight: str, budget: int) -> DataFrame:
    """Add before (weight of earlier rows) and take (what of the row's weight the budget leaves), rows that get nothing left out."""
    w = Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum(weight).over(w) - F.col(weight)
    return df.withColumn("before", before).withColumn("take", F.least(F.col(weight), F.lit(budget) - F.col("before"))).where("take > 0")


def head_tail(w: Column, budget: int, share: float = 0.75) -> Column:
    """The first and last words of a list that a budget allows, with a marker between them."""
    head = int(budget * share)
    return F.when(F.size(w) <= budget, F.array_join(w, " ")).otherwise(F.concat(F.array_join(F.slice(w, 1, head), " "), F.lit(" [...] "), F.array_join(F.slice(w, head - budget, budget - head), " ")))


def block_offsets(df: DataFrame, paper: str, order: str, text: str) -> DataFrame:
    """(paper, order, block_id, char_start, char_end): number of each block and its place in the paper's text."""
    w = Window.partitionBy(paper).orderBy(order)
    end = F.sum(F.length(text_of(F.col(text)))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    number = F.concat(F.col(paper).cast("string"), F.lit(":"), (F.row_number().over(w) - 1).cast("string"))
    return df.select(paper, order, number.alias("block_id"), (end - F.length(text_of(F.col(text)))).alias("char_start"), end.alias("char_end"))


def block_chunks(df: DataFrame, key: list[str], text: str, size: int = 220, overlap: int = 40) -> DataFrame:
    """(key, chunk_index, char_start, char_end, chunk): windows within a block, and their places in its text with single blanks."""
    step = size - overlap
    w = df.select(*key, F.filter(F.split(text_of(F.col(text)), SPACE + "+"), lambda x: x != "").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.size("w") - overlap - 1, F.lit(0)) / step).cast("int"))
    cut = lambda i: F.struct(F.array_join(F.slice("w", 1, i * step), " ").alias("before"), F.array_join(F.slice("w", i * step + 1, size), " ").alias("chunk"))
    each = w.select(*key, F.posexplode(F.transform(starts, cut)).alias("chunk_index", "c"))
    start = F.length("c.before") + F.when(F.col("chunk_index") > 0, 1).otherwise(0)
    return each.select(*key, "chunk_index", start.alias("char_start"), (start + F.length("c.chunk")).alias("char_end"), F.col("c.chunk").alias("chunk"))
