"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Base measures and base rule are fixed by the definition of `measures`; the verdict adds the rows of RULES, each a ratio of
two measures with a lower and an upper bound, or such bounds on a single measure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of four languages, for the stop-word ratio.
STOP_WORDS = tuple("the of and to in a is that it for on was be with as by this are from or der die und das von zu den mit des im für auf ist nicht sich ein eine als auch dem de la le et les des en un du une que est pour dans qui par sur pas au el los las se del con una su por no es lo".split())

#: (name, numerator, denominator or None, lower bound or None, upper bound or None, words from which the rule applies); both
#: bounds are allowed values.
RULES = (
    ("mean_word_length", "word_chars", "n_words", 2.0, 16.0, 0),
    ("symbols_per_word", "n_symbols", "n_words", None, 0.25, 0),
    ("stop_words", "n_stop_words", "n_words", 0.02, None, 50),
    ("echoed_words", "n_echo_words", "n_words", None, 0.30, 0),
    ("shouted_words", "n_shouted_words", "n_words", None, 0.60, 0),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 0.50, 0),
    ("bullet_lines", "n_bullet_lines", "n_lines", None, 0.90, 0),
    ("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.30, 0),
)

WINDOW = 5
SPLIT = r"[\x20\x09-\x0D]+"


def _count(words: Column, test) -> Column:
    return F.size(F.filter(words, test)).cast("long")


def measures(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Add the measures of a text, all long: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and others.

    Words are runs of characters other than space and U+0009 to U+000D; lines are cut at \\n and count if they hold a word. A
    null text has none. n_repeat_words counts the words inside five-word windows that occur twice or more in the text, the
    first occurrence included: windows are found by 64-bit hashes, and those whose hash repeats are compared as text.
    """
    p, own = prefix, prefix + "__"
    while any(c.startswith(own) for c in df.columns):
        own += "_"
    name = lambda k: F.col(own + k)
    w, ln, h, dup, cand, st = map(name, ("words", "lines", "hashes", "dup", "cand", "starts"))
    whole = F.coalesce(F.col(text), F.lit(""))
    at = lambda i, k: F.get(w, i + k)
    window = lambda i: F.concat_ws(" ", *(at(i, k) for k in range(WINDOW)))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    steps = {
        "words": F.array_remove(F.split(whole, SPLIT), ""),
        "lines": F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "hashes": F.when(F.size(w) > WINDOW, F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW))))).otherwise(none("bigint")),
        # (hash, position) in order, only if some hash repeats
        "dup": F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).otherwise(none("struct<x:bigint,i:int>")),
        # (text, position) of the windows whose hash repeats, in order
        "cand": F.array_sort(F.transform(F.filter(dup, lambda c, k: (c["x"] == F.get(dup, k - 1)["x"]) | (c["x"] == F.get(dup, k + 1)["x"])), lambda c: F.struct(window(c["i"]).alias("t"), c["i"].alias("i")))),
        "starts": F.array_sort(F.transform(F.filter(cand, lambda c, k: (c["t"] == F.get(cand, k - 1)["t"]) | (c["t"] == F.get(cand, k + 1)["t"])), lambda c: c["i"])),
    }
    out = df
    for k, v in steps.items():
        out = out.withColumn(own + k, v)
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    made = {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_lines": F.size(ln).cast("long"),
        "n_dup_lines": (F.size(ln) - F.size(F.array_distinct(ln))).cast("long"),
        # each start covers a window, or as much as lies before the next start
        "n_repeat_words": total(F.transform(st, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(st, k + 1) - x, F.lit(WINDOW))))),
        "n_stop_words": _count(w, lambda x: F.lower(x).isin(*dict.fromkeys(STOP_WORDS))),
        "n_echo_words": F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).cast("long"),
        "n_shouted_words": _count(w, lambda x: (F.length(x) > 1) & (x == F.upper(x)) & (x != F.lower(x))),
        "n_bullet_lines": _count(ln, lambda x: x.rlike(r"^\s*[-*\x{2022}]\s")),
        "n_ellipsis_lines": _count(ln, lambda x: x.rlike(r"(\.\.\.|\x{2026})\s*$")),
    }
    return out.withColumns({p + k: v for k, v in made.items()}).drop(*(own + k for k in steps))


def violation(rule: tuple) -> Column:
    """Whether a row of the threshold table is broken, without division: ratios of a zero denominator break nothing."""
    _, number, over, low, high, least = rule
    scale = F.col(over) if over else F.lit(1)
    tests = [F.col(number) < scale * low] * (low is not None) + [F.col(number) > scale * high] * (high is not None)
    broken = tests[0] if len(tests) == 1 else tests[0] | tests[1]
    return broken & (scale > 0) & (F.col("n_words") >= least)


def quality_rules(df: DataFrame, text: str = "text", rules: tuple = RULES) -> DataFrame:
    """Add the measures, base_failed (n_words < 10, or over 20 % repeated words), broken (names of the rules broken) and kept.

    kept is false if base_failed or if any rule is broken. A null or empty text has no words and fails. Rows are independent:
    repeated rows give repeated results, an empty table an empty one; other columns pass through, an input column with the
    name of a result is replaced.
    """
    out = measures(df, text)
    out = out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    out = out.withColumn("broken", F.array_compact(F.array(*(F.when(violation(r), F.lit(r[0])) for r in rules))))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
