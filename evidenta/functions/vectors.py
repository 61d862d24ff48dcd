"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; the cosine of normalised vectors (M1)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def hashed_embedding(tokens: Column, dims: int = 64) -> Column:
    """A unit vector of hashed token counts: the default embedder where no model is installed (R1); all zeros without tokens."""
    places = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(dims)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.size(F.filter(places, lambda p: p == d)).cast("double"))
    norm = F.sqrt(dot(counts, counts))
    return F.transform(counts, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def first_filled(*fields: Column) -> Column:
    """Text that stands for a paper: its fields that aren't blank, joined (R2); empty if all are."""
    return F.concat_ws(" ", *(F.nullif(F.trim(F.coalesce(f, F.lit(""))), F.lit("")) for f in fields))
