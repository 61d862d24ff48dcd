"""Connected components of a graph of long ids, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidenta.llm.common import materialise

#: Keys with more than this part of all rows are hubs; there are fewer of them than this number.
HUBS = 1 << 12
#: Far more rounds than logarithmic convergence needs; beyond it the result would not be proved.
MAX_ROUNDS = 60


def hub_join(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of `rows` with a table that has one row for each key and, as `weight`, the number of `rows` with it.

    The rows of a hub stay where they are: its row of the table, one of fewer than HUBS, is broadcast. The others are joined by
    shuffle. `total` is the number of `rows`; the weight is left out.
    """
    hubs = table.where(F.col(weight) * HUBS > total).drop(weight)
    others = table.where(F.col(weight) * HUBS <= total).drop(weight)
    near = rows.join(F.broadcast(hubs), key)
    far = rows.join(F.broadcast(hubs.select(key)), key, "left_anti").join(others, key)
    return near.unionByName(far)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node but the smallest of each component; component is that smallest node.

    Each round links every node's larger neighbours to its smallest neighbour (large star), then all smaller neighbours to
    the smallest (small star); stars are what remains. The smallest neighbour is an aggregate with partial sums, and is joined
    back by hub_join, so that a hub's edges are never gathered in one task. Rounds are checkpointed.
    """
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = materialise(now)
    if not now.head(1):
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # its larger neighbours are the rows that the join meets
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).select("u", F.least("u", "m").alias("m"), "n").where("n > 0"))
        # large star: neighbours v > u go to the least of u and its neighbours
        large = materialise(hub_join(now.select(F.col("v").alias("u"), F.col("u").alias("v")), least, "u", "n", now.count()).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small star: u and its smaller neighbours go to the least of these
        lowest = materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = hub_join(large, lowest, "u", "n", large.count()).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = materialise(small)
        # stars are left once no centre is a leaf; no round changes what is connected, so these are the components
        if not now.select("v").join(now.select("u"), F.col("v") == F.col("u"), "left_semi").head(1) and now.groupBy("u").count().where("count > 1").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
