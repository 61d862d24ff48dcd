"""Operators over extraction records: conformance, caches, outcomes and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidenta.functions import text as X

#: Abbreviations behind which no sentence ends.
ABBREVIATIONS = ("e.g.", "i.e.", "et al.", "etc.", "vs.", "cf.", "Fig.", "Eq.", "Sec.", "Tab.", "No.", "approx.")


def careful_sentences(c: Column) -> Column:
    """Sentences that don't end behind an abbreviation (F4): stops of these are marked before the text is cut."""
    t = X.text_of(c)
    for a in ABBREVIATIONS:
        t = F.replace(t, F.lit(a), F.lit(a.replace(".", "\x02")))
    return F.transform(X.sentences(t), lambda s: F.translate(s, "\x02", "."))


def reusable(cached: DataFrame, texts: DataFrame, version: str, paper: str = "paper_id") -> DataFrame:
    """Cached records whose text and prompt are still the same, unflagged and usable (P16); the others are to be made again.

    `cached` has paper, prompt_version, text_hash, flags (array) and filled; `texts` has paper and text.
    """
    now = texts.select(paper, F.substring(F.sha2(X.text_of(F.col("text")), 256), 1, 16).alias("now"))
    ok = (F.col("prompt_version") == version) & (F.col("text_hash") == F.col("now")) & (F.size("flags") == 0) & (F.col("filled") >= 2)
    return cached.join(now, paper).where(ok).drop("now")


def to_extract(texts: DataFrame, kept: DataFrame, paper: str = "paper_id") -> DataFrame:
    """Papers without a reusable record."""
    return texts.join(kept.select(paper), paper, "left_anti")


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`old` with the values of `new` where that has the key and a value."""
    fields = [c for c in old.columns if c != key]
    n = new.select(key, *(F.col(c).alias(f"__{c}") for c in fields if c in new.columns))
    return old.join(n, key, "left").select(key, *(F.coalesce(f"__{c}", c).alias(c) if c in new.columns else F.col(c) for c in fields))


def conformance(c: Column, keys: list[str]) -> Column:
    """(parsed, missing, extra): whether a text holds a JSON object, and how its keys differ from those wanted (K5)."""
    found = X.json_object(c)
    have = F.coalesce(F.json_object_keys(found), F.array().cast("array<string>"))
    want = F.array(*map(F.lit, keys))
    return F.struct(found.isNotNull().alias("parsed"), F.array_except(want, have).alias("missing"), F.array_except(have, want).alias("extra"))


def response_class(c: Column, done: Column, keys: list[str]) -> Column:
    """What is wrong with a model's answer: truncated, loop, invalid_json, wrong_shape, or ok (Q10)."""
    shape = conformance(c, keys)
    return F.when(done == "length", "truncated").when(X.loops(c, 40), "loop").when(~shape["parsed"], "invalid_json").when(F.size(shape["missing"]) > 0, "wrong_shape").otherwise("ok")


def perturbed(value: Column, step: int = 7) -> Column:
    """A claim with its first number made another one of the same shape."""
    shape = r"(?s)^(\D*)(\d+(?:\.\d+)?)(.*)$"
    before, number, after = (F.regexp_extract(value, shape, k) for k in (1, 2, 3))
    other = F.when(number.contains("."), F.replace(F.format_number(number.cast("double") + step, 1), F.lit(","), F.lit(""))).otherwise((number.try_cast("long") + step).cast("string"))
    return F.when(number != "", F.concat(before, other, after))


def bag_equal(a: DataFrame, b: DataFrame, columns: list[str], by: str) -> DataFrame:
    """(by, equal): whether two bags of rows are the same in each group."""
    count = lambda df, n: df.groupBy(by, *columns).agg(F.count("*").alias(n))
    both = count(a, "na").join(count(b, "nb"), [by, *columns], "full")
    return both.groupBy(by).agg(F.bool_and(F.col("na").eqNullSafe(F.col("nb"))).alias("equal"))


def best_match(a: DataFrame, b: DataFrame, key: str, other: str, tokens: str, least: int = 2) -> DataFrame:
    """(key, other, shared): for each row of `a` that of `b` with most tokens in common, `least` or more (J13); ties go to the smaller.

    Keys with the same tokens have the same match: sets of tokens are compared, each once, and the smallest key of a set in `b`
    stands for all of them. Rows of one key count together.
    """

    def sets(df: DataFrame, k: str) -> DataFrame:
        each = df.select(k, F.explode(F.array_distinct(tokens)).alias("t")).groupBy(k, "t").agg(F.count("*").alias("n"))
        return each.groupBy(k).agg(F.array_sort(F.collect_list(F.struct("t", "n"))).alias("own"))

    of_a, of_b = sets(a, key), sets(b, other).groupBy("own").agg(F.min(other).alias(other))
    left = of_a.select("own").distinct().select("own", F.explode("own").alias("x")).select("own", "x.t", F.col("x.n").alias("na"))
    right = of_b.select(other, F.explode("own").alias("x")).select(other, "x.t", F.col("x.n").alias("nb"))
    shared = left.join(right, "t").groupBy("own", other).agg(F.sum(F.col("na") * F.col("nb")).alias("shared")).where(F.col("shared") >= least)
    best = shared.groupBy("own").agg(F.max_by(F.struct(other, "shared"), F.struct("shared", -F.col(other))).alias("m"))
    return of_a.join(best, "own").select(key, f"m.{other}", "m.shared")
