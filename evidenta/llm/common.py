"""Shared helpers: scratch space on the cluster, table access and bounded Arrow slices."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A single space between two characters that aren't white space. Byte-level pre-tokenizers always begin a pre-token there: a
#: run of letters, digits or symbols ends before a space, and a lone space joins what follows it.
SAFE_SPACE = re.compile(r"(?<=[^\s\x00-\x20\x7f-\xa0]) (?=[^\s\x00-\x20\x7f-\xa0])")
#: Two characters in a row that may be white space.
DOUBLE_SPACE = re.compile(r"[\s\x00-\x1f\x7f-\xa0]{2}|^ | $")
#: Characters of a text that are cut into pieces at once.
BLOCK_CHARS = 1 << 18

#: Python code handles at most about so many text bytes at a time.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the input tables, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; one of our own only if all run in one process."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="evidenta-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def store(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder, in folders by the columns `by`; its shuffles are given up."""
    spark = df.sparkSession
    path = scratch(spark, name)
    flag = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(flag, None)
    spark.conf.set(flag, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.unset(flag) if before is None else spark.conf.set(flag, before)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or a longer one that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Plan nodes that give the same rows in the same partitions each time they are read.
IN_PLACE = frozenset(("Project", "Filter", "LogicalRelation", "SubqueryAlias"))


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """`df` with a unique number for each row, and the name of that column, which no other column has.

    A scan with projections and filters is numbered in place, since its files fix partitions and order; rows of any other plan
    are written to the shared folder with their numbers, so that each branch that reads them sees the same ones. How files are
    split must not follow the executors that happen to be there, so the session's least number of splits is set if it is unset.
    """
    spark, splits = df.sparkSession, "spark.sql.files.minPartitionNum"
    if spark.conf.get(splits, None) is None:
        spark.conf.set(splits, str(spark.sparkContext.defaultParallelism))
    name = fresh(df, "__row")
    out = df.withColumn(name, F.monotonically_increasing_id())
    nodes, todo = [], [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        x = todo.pop()
        nodes.append(x.nodeName() if x.deterministic() else "")
        inner = x.children()
        todo += [inner.apply(k) for k in range(inner.size())]
    return (out if all(n.split(" ")[0] in IN_PLACE for n in nodes) else materialise(out)), name


def delete(spark: SparkSession, path: str) -> None:
    """Remove a scratch path through Hadoop's file system, whatever its scheme."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about `most` bytes of `column` at most (a single row may hold more)."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def blocks(text: str) -> Iterator[str]:
    """Cut a text before safe spaces into blocks of about BLOCK_CHARS characters (longer where there is no such space)."""
    start = 0
    while len(text) - start > BLOCK_CHARS and (found := SAFE_SPACE.search(text, start + BLOCK_CHARS)):
        yield text[start : found.start()]
        start = found.start()
    if start < len(text):
        yield text[start:] if start else text


def pieces(block: str) -> list[str]:
    """Cut a block at its safe spaces, which are left out; a space at its very start stays with the first piece."""
    if block.startswith(" "):
        head = " "
        block = block[1:]
    else:
        head = ""
    out = block.split(" ") if not DOUBLE_SPACE.search(block) else SAFE_SPACE.split(block)
    out[0] = head + out[0]
    return out
