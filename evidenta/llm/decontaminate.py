"""Benchmark decontamination with a distributed positional inverted index, in DataFrame functions only.

The texts are split once. Of each token that some benchmark item has, a posting is written: row, position and the term's
number. A further posting at the end of every text, of no term, gives its length. All else works on this index. A count of the
postings ranks the terms; every window opens the list of its rarest term, and each of its postings gives a start (its position
minus the term's offset). The list of the second rarest term is shifted by its own offset and intersected with these starts, an
equi-join on row and position; then the lists of the remaining terms, all at once. What has a posting for each term at its
place is an exact match, so no text or token array is looked at again. Proximity is the same with every place widened by `slop`.

Keys of the joins hold a row and a position, so neither a frequent term nor a copied passage gathers in one task. The lists
that the benchmark gives (terms, ranks) are broadcast up to BROADCAST_BYTES, by their measured size; beyond it their rows are
repeated for each of SALTS salts and joined by shuffle, so that a frequent term is split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidenta.llm.common import numbered, store

WINDOW = 8
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_BYTES = 32 << 20
SALTS = 32


def words(text: Column) -> Column:
    """Words of a text, lower-cased in A-Z only; none for null."""
    whole = F.coalesce(text, F.lit(""))
    # lower() differs from lower-casing A-Z only where there are other letters
    lowered = F.when(whole.rlike(r"[^\x00-\x7F]"), F.translate(whole, UPPER, LOWER)).otherwise(F.lower(whole))
    return F.array_remove(F.split(lowered, SPLIT), "")


def windows(items: DataFrame, item: str, text: str, size: int = WINDOW) -> DataFrame:
    """(window array, items array): the distinct windows of all items; a shorter item, if it has a word, is one window."""
    w = items.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    return w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, size))).alias("window")).groupBy("window").agg(F.collect_set("item").alias("items"))


def small_join(big: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Inner join with a table that grows with the benchmark only: broadcast if its measured size allows, else salted."""
    bytes_ = small.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    if bytes_ <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), key)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("__salt", F.pmod(F.col("pos"), F.lit(SALTS))).join(salted, [key, "__salt"]).drop("__salt")


def index(docs: DataFrame, row: str, text: str, terms: DataFrame) -> DataFrame:
    """(row, pos, term): the stored postings of `terms` (word, term), and of each text one of term -1 at its number of words."""
    every = F.posexplode(F.concat(words(F.col(text)), F.array(F.lit("")))).alias("pos", "word")
    end = docs.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(-1).cast("long").alias("term"))
    return store(small_join(docs.select(F.col(row).alias("row"), every), terms.unionByName(end), "word").select("row", "pos", "term"), "postings")


def phrase_matches(postings: DataFrame, plan: DataFrame, slop: int = 0) -> DataFrame:
    """(row, start, window): every place where all terms of a window have a posting, each within `slop` of its own place.

    `plan` has window, rank (0 is the rarest term), offset, term and size. With a slop, a start may lie before the text.
    """
    shift = lambda c: F.explode(F.sequence(c - slop, c + slop)) if slop else c
    opened = small_join(postings, plan.where("rank = 0").select("term", "window", "offset", "size"), "term")
    starts = opened.select("row", "window", "size", shift(F.col("pos") - F.col("offset")).alias("start"))
    starts = starts.distinct() if slop else starts.where("start >= 0")
    for lists, needed in ((plan.where("rank = 1"), F.least(F.col("size") - 1, F.lit(1))), (plan.where("rank > 1"), F.greatest(F.col("size") - 2, F.lit(0)))):
        lists = lists.select("window", "rank", "offset", "term")
        used = small_join(postings, lists.select("term").distinct(), "term")
        wanted = starts.where(needed > 0).withColumn("pos", F.lit(0)).transform(lambda d: small_join(d, lists, "window"))
        wanted = wanted.select("row", "window", "size", "start", "rank", "term", shift(F.col("start") + F.col("offset")).alias("pos"))
        met = wanted.join(used, ["row", "pos", "term"], "left_semi")
        met = met.select("row", "window", "size", "start", "rank").distinct() if slop else met
        full = met.groupBy("row", "window", "size", "start").agg(F.count("*").alias("n")).where(F.col("n") == needed).drop("n")
        # what has been opened and cut so far is written, so that no list is read twice for it
        starts = store(full.unionByName(starts.where(needed == 0).select(*full.columns)), "starts")
    return starts.select("row", "start", "window")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW, least_items: int = 2, slop: int = 0) -> DataFrame:
    """Add n_words, n_hit (words inside any occurrence of a window), items (the ids found, sorted strings) and contaminated.

    One row for each row of `docs`, repeated rows included; a null or empty text has no words and no items. Items without
    words have no windows; a null item id counts as the string "null". An empty benchmark marks nothing. Other columns pass
    through; an input column with the name of a result is replaced. The texts themselves are left out of every shuffle but the
    last join, which has the columns that the caller goes on to use. With `slop` windows are found by proximity (see
    phrase_matches), and what of a window lies in the text is inside it.
    """
    source, row = numbered(docs)
    phrases = store(windows(benchmark, item, item_text, size).withColumn("window_id", F.monotonically_increasing_id()), "windows")
    # numbered once they are written, so that every reading sees the same numbers
    terms = store(phrases.select(F.explode("window").alias("word")).distinct().withColumn("term", F.monotonically_increasing_id()), "terms")
    postings = index(source, row, text, terms)
    ends = postings.where("term = -1").select("row", F.col("pos").cast("long").alias("n_words"))
    counts = postings.where("term >= 0").groupBy("term").agg(F.count("*").alias("df"))
    lists = phrases.select(F.col("window_id").alias("window"), F.size("window").alias("size"), F.posexplode("window").alias("offset", "word")).join(terms, "word").join(counts, "term")
    ranked = lists.groupBy("window", "size").agg(F.array_sort(F.collect_list(F.struct("df", "offset", "term"))).alias("lists")).where(F.size("lists") == F.col("size"))  # a window with an unseen term can't occur
    plan = store(ranked.select("window", "size", F.posexplode("lists").alias("rank", "l")).select("window", "size", "rank", "l.offset", "l.term"), "plan")
    hits = phrase_matches(postings, plan, slop).join(phrases.select(F.col("window_id").alias("window"), F.size("window").alias("length"), "items"), "window")
    spans = hits.groupBy("row", "start").agg(F.max("length").alias("length")).join(ends, "row") if slop else hits.groupBy("row", "start").agg(F.max("length").alias("length"))
    if slop:
        begin = F.greatest("start", F.lit(0))
        spans = spans.select("row", begin.alias("start"), (F.least(F.col("start") + F.col("length"), F.col("n_words")) - begin).alias("length"))
    per_row = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("s"))
    zero = F.lit(0).cast("long")
    covered = F.aggregate("s", F.struct(zero.alias("n"), zero.alias("end")), lambda a, x: F.struct((a["n"] + F.greatest(x["start"] + x["length"] - F.greatest(x["start"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], x["start"] + x["length"]).alias("end")), lambda a: a["n"])
    found_items = hits.select("row", "items").distinct().select("row", F.explode("items").alias("item")).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = store(per_row.select("row", covered.alias("n_hit")).join(found_items, "row"), "hits")
    none = F.array().cast("array<string>")
    results = ends.join(found, "row", "left").select(F.col("row").alias(row), "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("items", none).alias("items"))
    out = source.drop("n_words", "n_hit", "items", "contaminated").join(results, row, "left").drop(row)
    return out.withColumn("contaminated", F.size("items") >= least_items)
