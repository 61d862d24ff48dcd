"""Measures over claims, anchors, readers and arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    """precision, sensitivity and specificity, three places, null where nothing is counted."""
    share = lambda a, b: F.round(F.try_divide(a, a + b), 3)
    return [share(tp, fp).alias("precision"), share(tp, fn).alias("sensitivity"), share(tn, fp).alias("specificity")]


def confusion(df: DataFrame, truth: Column, said: Column, by: list[str]) -> DataFrame:
    """Counts of the four cells and their rates, for each group."""
    cells = df.groupBy(*by).agg(*(F.count_if((truth == a) & (said == b)).alias(n) for n, a, b in (("tp", True, True), ("fn", True, False), ("fp", False, True), ("tn", False, False))))
    return cells.select(*by, "tp", "fp", "fn", "tn", *rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def recall_at(df: DataFrame, rank: str, ks: list[int], slices: list[str]) -> DataFrame:
    """Share of rows ranked among the first k, for each slice and for all of them, in one pass."""
    sets = [[s] for s in slices] + [[]]
    return df.groupingSets(sets, *slices).agg(F.count("*").alias("n"), *(F.round(F.avg(F.coalesce(F.col(rank) <= k, F.lit(False)).cast("int")), 4).alias(f"recall_{k}") for k in ks))


def delivery(df: DataFrame, hit: Column, budget: Column, size: Column, by: list[str]) -> DataFrame:
    """Share of anchors delivered, that of a random choice of `budget` among `size`, and their ratio."""
    out = df.groupBy(*by).agg(F.avg(hit.cast("int")).alias("d"), F.avg(F.least(budget, size) / size).alias("r"))
    return out.select(*by, F.round("d", 4).alias("delivered"), F.round("r", 4).alias("random"), F.round(F.try_divide("d", "r"), 4).alias("ratio"))


def agreement(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Share of units on which two readers agree; two missing answers agree."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(F.col(a).eqNullSafe(F.col(b)).cast("int")), 4).alias("agreement"))


def transitions(before: DataFrame, after: DataFrame, unit: str, value: str) -> DataFrame:
    """(before, after, n): how units change between two arms; a unit that one arm lacks is `missing` there."""
    a = before.select(unit, F.col(value).alias("before"), F.lit(True).alias("__a"))
    b = after.select(unit, F.col(value).alias("after"), F.lit(True).alias("__b"))
    both = a.join(b, unit, "full")
    side = lambda v, there: F.when(F.col(there).isNull(), "missing").otherwise(F.coalesce(F.col(v).cast("string"), F.lit("null"))).alias(v)
    return both.select(side("before", "__a"), side("after", "__b")).groupBy("before", "after").agg(F.count("*").alias("n"))


def coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, filled, n, share): how many records have something in each field (Q1)."""
    long = df.select(*(F.col(f).cast("string").alias(f) for f in fields)).unpivot([], fields, "field", "value")
    some = F.trim(F.coalesce("value", F.lit(""))) != ""
    return long.groupBy("field").agg(F.count_if(some).alias("filled"), F.count("*").alias("n"), F.round(F.avg(some.cast("int")), 4).alias("share"))


def criterion(value: Column, low: Column, aligned: Column) -> Column:
    """PASS or FAIL against a bound, UNMEASURED if the value is missing or its units don't match (Q14)."""
    return F.when(value.isNull() | ~F.coalesce(aligned, F.lit(False)), "UNMEASURED").when(value >= low, "PASS").otherwise("FAIL")


def routing(a: Column, b: Column, rule: Column) -> Column:
    """Whom a label goes to: a human if a judge is unsure or both differ, else its value; N by rule is provisional (Q7)."""
    unsure = (a == "UNCERTAIN") | (b == "UNCERTAIN") | ~a.eqNullSafe(b)
    return F.when(unsure, "human").when((a == "N") & rule, "provisional_N").otherwise(a)


def regressions(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """Which of the stages that a unit passed before it no longer passes (Q8)."""
    return F.array_compact(F.array(*(F.when(before[k] & ~after[k], F.lit(f"{k}_lost")) for k in before)))


def invariants(tests: dict[str, DataFrame]) -> DataFrame:
    """One row of booleans: whether each table of violations is empty."""
    out = None
    for name, df in tests.items():
        row = df.limit(1).agg((F.count("*") == 0).alias(name))
        out = row if out is None else out.crossJoin(row)  # one row each
    return out


def structural_diff(a: DataFrame, b: DataFrame, key: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(key, path, before, after) of the values in which records differ; a missing record has no values (K7)."""
    fields = [c for c in a.columns if c != key and c not in ignored]
    flat = lambda df, name: df.select(key, *(F.col(c).cast("string").alias(c) for c in fields)).unpivot([key], fields, "path", name)
    return flat(a, "before").join(flat(b, "after"), [key, "path"], "full").where(~F.col("before").eqNullSafe(F.col("after")))


def merge_first_casing(a: Column, b: Column) -> Column:
    """All of `a`, then what `b` adds to it, letter case apart."""
    both = F.concat(a, b)
    low = F.transform(both, lambda x: F.lower(x))
    return F.filter(both, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def probes(cells: DataFrame, table: str = "table_id") -> DataFrame:
    """(kind, table, row, col, value): values for a cell that are its own, of another column or row, or of another table.

    `cells` has table, row, col and value. The neighbour in order (the last one's is the first) stands for all others, so that
    each cell has one probe of a kind.
    """
    from pyspark.sql import Window

    def beside(part: list[str], order: str, kind: str) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(order)
        first = F.first("value").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        other = F.coalesce(F.lead("value").over(w), first)
        return cells.select(F.lit(kind).alias("kind"), table, "row", "col", other.alias("probe"), "value").where(~F.col("probe").eqNullSafe(F.col("value"))).drop("value")

    own = cells.select(F.lit("correct").alias("kind"), table, "row", "col", F.col("value").alias("probe"))
    return own.unionByName(beside([table, "row"], "col", "wrong_column")).unionByName(beside([table, "col"], "row", "wrong_row")).unionByName(beside(["row", "col"], table, "cross_table"))
