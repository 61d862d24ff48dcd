"""SimHash near-duplicate detection with pivot distance tables.

Documents with one fingerprint are one node, so exact copies cost one row each. Two fingerprints that differ in at most two
bits agree on at least two of four blocks of 16 bits (pigeonhole), so they meet in one of six groups by 32 equal bits, however
many fingerprints there are: a group of chance holds one fingerprint in 2**32. Pairs inside a group are compared through the
pivot table: the Hamming distances of each fingerprint to PIVOTS fixed reference fingerprints differ by at most two for such a
pair, so a pair with a larger coordinate difference is discarded, and the survivors are verified bit by bit.

Groups of more than GROUP fingerprints are families of near copies (chance gives such groups only from about 2 * 10**11
distinct fingerprints on). They aren't paired, since pairs grow as a square: each fingerprint sends itself and its 64 one-bit
neighbours as keys. Two fingerprints differ in at most two bits if and only if they share such a key, and no key has more
than 65 fingerprints. Linking each to the least of its key gives the same components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidenta.llm.common import fresh, materialise, slices
from evidenta.llm.components import components, hub_join

SEED = 42
SHINGLE = 3
BITS = 2
#: Masks of the pairs of 16-bit blocks.
BLOCKS = tuple((0xFFFF << 16 * i) | (0xFFFF << 16 * j) for i, j in combinations(range(4), 2))
#: Reference fingerprints: hashes of their numbers, fixed for all time.
PIVOTS = tuple(int(np.uint64(xxhash.xxh64_intdigest(str(k), seed=SEED)).astype(np.int64)) for k in range(16))
#: Fingerprints of a block group up to which pairs are formed.
GROUP = 48
#: Shingles that are counted at once.
STEP = 1 << 15


def fingerprint(text: str | None) -> int:
    """SimHash of word shingles, as a signed 64-bit integer."""
    words = (text or "").encode().lower().split()  # for bytes: A-Z only, and white space is space and U+0009 to U+000D
    if not words:
        return 0
    if len(words) < SHINGLE:
        words = [b" ".join(words)]
        n = 1
    else:
        n = len(words) - SHINGLE + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, STEP):
        part = words[k : k + STEP + SHINGLE - 1]
        grams = part if n == 1 and len(words) == 1 else map(b" ".join, zip(*(part[j:] for j in range(SHINGLE)), strict=False))
        h = np.fromiter((digest(g, SEED) for g in grams), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, text: str = "text", name: str = "simhash") -> DataFrame:
    """Add the fingerprint of `text` as a long; other columns pass through, one of that name is replaced."""
    hidden = fresh(df, "__text")
    source = df.withColumnRenamed(text, hidden) if text == name else df
    column = hidden if text == name else text
    kept = [f for f in source.schema.fields if f.name not in (name, hidden)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                made = pa.array([fingerprint(x) for x in part.column(column).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), made], [*(f.name for f in kept), name])

    return source.mapInArrow(run, T.StructType([*kept, T.StructField(name, T.LongType())]))


def links(prints: DataFrame, fp: str = "fp", node: str = "node") -> DataFrame:
    """Edges (a, b) of nodes whose fingerprints differ in at most two bits, one row per distinct fingerprint coming in.

    The edges join the same components as all such pairs would.
    """
    coords = F.array(*(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("byte") for p in PIVOTS))
    table = prints.select(F.col(fp).alias("fp"), F.col(node).alias("node")).withColumn("pivots", coords)
    signed = lambda x: x if x < 1 << 63 else x - (1 << 64)
    key = F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")) for m in BLOCKS))).alias("block", "value")
    keyed = table.select("fp", "node", "pivots", key)
    sizes = keyed.groupBy("block", "value").agg(F.count("*").alias("n")).where("n > 1")
    keyed = keyed.join(sizes, ["block", "value"])
    keyed = materialise(keyed)
    few = keyed.where(F.col("n") <= GROUP)
    a, b = few.alias("a"), few.alias("b")
    apart = F.array_max(F.zip_with(F.col("a.pivots"), F.col("b.pivots"), lambda x, y: F.abs(x - y)))
    on = (F.col("a.block") == F.col("b.block")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.node") < F.col("b.node"))
    pairs = a.join(b, on & (apart <= BITS) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= BITS)).select(F.col("b.node").alias("a"), F.col("a.node").alias("b"))
    # a pair that meets in a large group is linked here
    many = keyed.where(F.col("n") > GROUP).select("fp", "node").distinct()
    ball = F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(64)))).alias("key")
    keys = many.select("node", ball)
    least = keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("n")).where("n > 1")
    # the extremes of a key are an edge already; the others need a look at the key
    ends = least.select(F.col("most").alias("a"), F.col("least").alias("b"))
    rest = keys.join(least.where("n > 2").select("key", "least", "most"), "key").where("node <> least and node <> most").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return pairs.unionByName(ends).unionByName(rest)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", component: str | None = None) -> DataFrame:
    """Add simhash (long) and component_id: the smallest `key` (a long) that is reachable over links of two or fewer bits.

    Null and empty texts have fingerprint zero and are linked like any other, as are rows whose key is null; a component without
    any key is named null, so `component` may name a further column, the component's least fingerprint. Repeated rows are rows of one component. An empty table gives an
    empty result; other columns pass through, input columns with the names of results are replaced.
    """
    source = df.drop("component_id", *([component] if component else []))
    prints = fingerprints(source, text, "simhash")
    prints = materialise(prints.drop(text) if text != key else prints)
    nodes = materialise(prints.groupBy("simhash").agg(F.min(key).alias("node"), F.count("*").alias("n")))
    # a fingerprint is its own node, so that those without a key take part
    found = components(links(nodes.select(F.col("simhash").alias("fp"), F.col("simhash").alias("node"))))
    joined = nodes.join(found.select(F.col("node").alias("simhash"), "component"), "simhash", "left").withColumn("component", F.coalesce("component", "simhash"))
    named = joined.groupBy("component").agg(F.min("node").alias("component_id"), F.count("*").alias("n_nodes"))
    total = named.agg(F.sum("n_nodes")).first()[0] or 0
    mapped = hub_join(joined, named.withColumnRenamed("n_nodes", "n_rows"), "component", "n_rows", total)
    mapped = materialise(mapped.select("simhash", "n", "component_id", *([F.col("component").alias(component)] if component else [])))
    return hub_join(prints, mapped, "simhash", "n", mapped.agg(F.sum("n")).first()[0] or 0)
