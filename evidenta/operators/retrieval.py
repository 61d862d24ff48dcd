"""Exact vector retrieval."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidenta.functions.vectors import dot

#: Vectors and probes of a block, and probes that are multiplied at once.
BLOCK, PROBES, SLICE = 8192, 4096, 128
#: By how much a score may be under another that it equals once both are rounded.
ROUNDED = 1.01e-5


def top_k(vectors: DataFrame, probes: DataFrame, group: str, key: str, vector: str, probe: str, k: int) -> DataFrame:
    """(probe, group, key, score, rank): the k best vectors of each group for that group's probes.

    `probes` has group, `probe` and `probe`_vector; the join is on the group, and ties go to the smaller key.
    """
    scored = vectors.join(probes, group).select(probe, group, key, F.round(dot(F.col(vector), F.col(f"{probe}_vector")), 5).alias("score"))
    w = Window.partitionBy(probe, group).orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k_blocks(vectors: DataFrame, probes: DataFrame, key: str, vector: str, probe: str, k: int, group: str | None = None) -> DataFrame:
    """(probe, [group,] key, score, rank): the k best vectors for every probe, all of them or those of its group.

    `probes` has `probe`, `probe`_vector and the group. Blocks of vectors meet blocks of probes, each pair in a task's matrix
    product, which only finds candidates: their scores are summed in order, as `dot` does. A pair of blocks gives its k best for
    a probe, with all that rounding may make equal to them; ties go to the smaller key.
    """
    by, at = [group] if group else [], F.col(group) if group else F.lit(0)
    number = lambda df, n, size: df.groupBy(at.alias("__g")).agg(F.ceil(F.count("*") / size).cast("int").alias(n))
    blocks = number(vectors, "__nv", BLOCK).join(number(probes, "__np", PROBES), "__g")
    blocks = blocks if group else F.broadcast(blocks)  # one row

    def dealt(df: DataFrame, own: str, other: str, of: str, name: str) -> DataFrame:
        each = df.withColumn("__g", at).join(blocks, "__g").withColumn(f"__{own}", F.pmod(F.xxhash64(of), F.col(f"__n{own}")).cast("int"))
        return each.withColumn(f"__{other}", F.explode(F.sequence(F.lit(0), F.col(f"__n{other}") - 1))).select("__g", "__v", "__p", of, F.col(name).alias("__x"))

    on = ["__g", "__v", "__p"]
    left, right = dealt(vectors, "v", "p", key, vector), dealt(probes, "p", "v", probe, f"{probe}_vector")
    kind = {x.name: x.dataType for x in [*left.schema, *right.schema]}
    schema = T.StructType([T.StructField(probe, kind[probe]), T.StructField("__g", kind["__g"]), T.StructField(key, kind[key]), T.StructField("score", T.DoubleType())])

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        (x, ok), (y, fit) = _matrix(a["__x"]), _matrix(b["__x"])
        if x.shape[1] != y.shape[1]:  # no vector of the narrower side has all numbers that the other's have
            (x, ok), (y, fit) = (_widened(m, have, max(x.shape[1], y.shape[1])) for m, have in ((x, ok), (y, fit)))
        n, out = min(k, len(x)), []
        places = np.argsort(np.argsort(a[key].to_numpy(), kind="stable"), kind="stable")  # of keys in order
        for i in range(0, len(y) if n else 0, SLICE):
            with np.errstate(invalid="ignore", over="ignore"):
                rough = y[i : i + SLICE] @ x.T
                rough[np.isnan(rough)] = np.inf  # as Spark sorts it
                rough[:, ~ok] = rough[~fit[i : i + SLICE]] = -np.inf  # no score: after all others
                least = np.partition(rough, -n, axis=1)[:, -n]
                margin = ROUNDED + 1e-12 * np.linalg.norm(y[i : i + SLICE], axis=1) * np.linalg.norm(x[ok], axis=1).max(initial=0.0)
                least = np.where(np.isfinite(least), least - np.nan_to_num(margin, nan=np.inf), least)
                q, v = np.nonzero(rough >= least[:, None])
                none = ~ok[v] | ~fit[i + q]
                score = np.zeros(len(q))
                for d in range(x.shape[1]):
                    score += x[v, d] * y[i + q, d]
            # of the same score the k smallest keys will do
            order = np.lexsort((places[v], score, none, q))
            q, v, none, score = q[order], v[order], none[order], score[order]
            same = (q[1:] == q[:-1]) & (none[1:] == none[:-1]) & ((score[1:] == score[:-1]) | np.isnan(score[1:]) & np.isnan(score[:-1]) | none[1:])
            first = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(q)), 0)) if len(q) else np.zeros(0, int)
            kept = np.arange(len(q)) - first < k
            q, v, none, score = q[kept], v[kept], none[kept], score[kept]
            out.append(pa.table({probe: b[probe].take(pa.array(i + q)), "__g": a["__g"].take(pa.array(v)), key: a[key].take(pa.array(v)), "score": pa.array(score, mask=none)}))
        return pa.concat_tables(out) if out else pa.table({probe: b[probe][:0], "__g": a["__g"][:0], key: a[key][:0], "score": pa.array([], pa.float64())})

    best = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(pair, schema)
    best = best.withColumns({"score": F.round("score", 5)} | ({group: F.col("__g")} if group else {})).select(probe, *by, key, "score")
    w = Window.partitionBy(probe, *by).orderBy(F.desc("score"), key)
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of a matrix, and which of them have all their numbers; the others are zeros."""
    column = column.combine_chunks()
    sizes = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(float), nan=-1).astype(int)
    width = max(sizes, default=0)
    out, ok = np.zeros((len(column), max(width, 0))), sizes == width
    if ok.all() and width > 0 and column.flatten().null_count == 0:
        return column.flatten().to_numpy().astype(float).reshape(len(column), width), ok
    for r, values in enumerate(column.to_pylist()):
        ok[r] = ok[r] and width >= 0 and values is not None and None not in values
        if ok[r]:
            out[r] = values
    return out, ok


def _widened(m: np.ndarray, ok: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    return (m, ok) if m.shape[1] == width else (np.zeros((len(m), width)), ok & False)


def mean_pool(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, pos, mean): element-wise means (A4)."""
    return vectors.select(group, F.posexplode(vector).alias("pos", "x")).groupBy(group, "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))
