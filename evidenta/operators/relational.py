"""Set, key and matrix operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidenta.functions import claims as C
from evidenta.functions import text as X

#: Least similarity of a fuzzy match, places it is rounded to, and how far the lengths of two titles may differ.
ALIKE, PLACES, LENGTHS = 0.9, 6, 2
#: Up to so many letters lost on either side titles meet by what is left of them, beyond it by pieces.
LOST = 2


def gap_matrix(facts: DataFrame, category: str, item: str) -> DataFrame:
    """(category, item, n): counts of all pairs of a category and a known item, zeros included (A1).

    A category without any item is kept. Counts are aggregated first. The grid is that of two vocabularies, not of the facts,
    and its rows are the result itself: the items are repeated for each category.
    """
    counts = facts.where(F.col(category).isNotNull()).groupBy(category, item).agg(F.count("*").alias("n"))
    items = counts.select(item).where(F.col(item).isNotNull()).distinct()
    grid = counts.select(category).distinct().crossJoin(items)
    return grid.join(counts, [category, item], "left").select(category, item, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of `left` that `right` lacks."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def symmetric_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys on one side only."""
    return missing(left, right, key).withColumn("side", F.lit("left")).unionByName(missing(right, left, key).withColumn("side", F.lit("right")))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by several rows, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def first_wins(df: DataFrame, keys: list, order: list) -> DataFrame:
    """One row for each key, the first in order (A10, U5). Keys are shuffled and compared as their SHA-256."""
    names = [f"__key{k}" for k in range(len(keys))]
    keyed = df.withColumns(dict(zip(names, keys, strict=True)))
    ranked = keyed.withColumn("__rn", F.row_number().over(Window.partitionBy(*(F.sha2(F.to_json(F.struct(*names)), 256),)).orderBy(*order)))
    return ranked.where("__rn = 1").drop("__rn", *names)


def first_n(df: DataFrame, keys: list, order: list, n: int) -> DataFrame:
    """The first n rows of each key (W8), with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def dominant(df: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """(key, value, n): the most frequent value of each key, of equal ones the one seen first."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    return counts.groupBy(key).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("first"))).alias("m")).select(key, f"m.{value}", "m.n")


def title_tiers(cited: DataFrame, real: DataFrame, key: str, title: str) -> DataFrame:
    """(key, tier, real): cited titles by equal title (1), else without a note in brackets at their end (2), else null.

    `real` has title (normalised, each once) and real.
    """
    c = cited.select(key, X.normal_title(F.col(title)).alias("t1"), X.normal_title(X.without_tag(F.col(title))).alias("t2"))
    one = real.select(F.col("title").alias("t1"), F.col("real").alias("r1"))
    two = real.select(F.col("title").alias("t2"), F.col("real").alias("r2"))
    out = c.join(one, "t1", "left").join(two, "t2", "left")
    return out.select(key, F.when(F.col("r1").isNotNull(), 1).when(F.col("r2").isNotNull(), 2).alias("tier"), F.coalesce("r1", "r2").alias("real"))


def _meeting_keys(title: Column, cited: Column, real: Column, of_cited: bool) -> Column:
    """Digests that a cited title of length `cited` shares with every real one of length `real` that is ALIKE.

    Such titles have at most a tenth of their letters apart. If few are, both leave the same text once so many letters are taken
    out of each. Else one of the pieces into which the cited title is cut, one more than letters apart, stands in the real one,
    moved by no more than those letters.
    """
    most = F.floor((1 - ALIKE + 10.0**-PLACES) * (cited + real)).cast("int")
    apart = most - F.pmod(most + cited + real, F.lit(2))
    lost, other = ((apart + x) / 2 for x in ((cited - real, real - cited) if of_cited else (real - cited, cited - real)))
    lost, other, n = lost.cast("int"), other.cast("int"), cited if of_cited else real
    before, behind = lambda i: F.substring(title, F.lit(1), i - 1), lambda i: F.substring(title, i + 1, n)
    one = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(before(i), behind(i)))
    two = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.sequence(i + 1, n), lambda j: F.concat(before(i), F.substring(title, i + 1, j - i - 1), behind(j)))))
    left = F.when(lost == 0, F.array(title)).when(lost == 1, one).when(lost == 2, two)
    start = lambda k: F.floor(k * cited / (apart + 1)).cast("int")
    piece = lambda k, moved: F.concat(k.cast("string"), F.lit(":"), F.substring(title, start(k) + moved + 1, start(k + 1) - start(k)))
    numbers = F.sequence(F.lit(0), apart)
    if of_cited:
        pieces = F.transform(numbers, lambda k: piece(k, F.lit(0)))
    else:
        within = lambda k: F.filter(F.sequence(-other, lost), lambda m: (start(k) + m >= 0) & (start(k + 1) + m <= n))
        pieces = F.flatten(F.transform(numbers, lambda k: F.transform(within(k), lambda m: piece(k, m))))
    texts = F.when(apart < F.abs(cited - real), F.array().cast("array<string>")).when(F.greatest(lost, other) <= LOST, left).otherwise(pieces)
    return F.array_distinct(F.transform(texts, lambda x: F.xxhash64(cited, real, x)))


def closest_titles(cited: DataFrame, real: DataFrame, group: str) -> DataFrame:
    """(group, cited, real_id, ratio): the most similar real title of its group for each cited one, if any is ALIKE (J14, tier 3; F23).

    `cited` has group and cited; `real` has group, real and real_id, of equal ratios the smallest is taken. Each different
    title is compared once, and only with those that it shares a key with, as all that are ALIKE do.
    """
    a = cited.select(group, "cited", F.length("cited").alias("na")).where("na is not null").distinct()
    b = real.groupBy(group, "real").agg(F.min("real_id").alias("real_id")).withColumn("nb", F.length("real")).where("nb is not null")
    # pairs of lengths that occur, a few for each length
    na, nb = cited.select(F.length("cited").alias("na")).distinct(), real.select(F.length("real").alias("nb")).distinct()
    lengths = F.broadcast(na.join(F.broadcast(nb), F.abs(F.col("na") - F.col("nb")) <= LENGTHS))
    keyed = lambda t, by, title: t.join(lengths, by).withColumn("key", F.explode(_meeting_keys(F.col(title), F.col("na"), F.col("nb"), by == "na"))).select(group, "key", *t.drop(group, by).columns)
    pairs = keyed(a, "na", "cited").join(keyed(b, "nb", "real"), [group, "key"]).select(group, "cited", "real", "real_id").distinct()
    near = F.levenshtein("cited", "real") <= (1 - ALIKE + 10.0**-PLACES) * (F.length("cited") + F.length("real"))
    scored = pairs.where(near).withColumn("ratio", F.round(C.ratio("cited", "real"), PLACES)).where(F.col("ratio") >= ALIKE)
    return scored.groupBy(group, "cited").agg(F.max_by("real_id", F.struct("ratio", -F.col("real_id"))).alias("real_id"), F.max("ratio").alias("ratio"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many ids both have, either has, and only the first has."""
    key = a.columns[0]
    both = a.distinct().withColumn("__a", F.lit(1)).join(b.distinct().withColumn("__b", F.lit(1)), key, "full")
    return both.agg(F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("both"), F.count("*").alias("either"), F.count_if(F.col("__b").isNull()).alias("only_first"))
