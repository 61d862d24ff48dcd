"""Stupid-backoff language-model scores, computed relationally.

Counts of all n-grams of the corpus, of every length up to the order, are tables keyed by 64-bit hashes and partitioned by
them. Every document's n-grams are exploded, joined to those tables and summed per document. An n-gram seen fewer than `least`
times backs off to the one shorter by its first word, times ALPHA. Scores are whole micro-nats, so that sums don't depend on
the order of rows.

A repeated n-gram's parts are repeated too, so a score is a sum over lengths: that of the last word with a step back for every
longer n-gram, and for each n-gram that is repeated the difference it makes. The tables hold these differences, and an
n-gram that isn't repeated needs no row at all.

Texts are read once for words, once for longer n-grams and once for the scores. N-grams on their way to be counted are packed
into rows of many keys, since most are there once and a row each costs more than counting them. Fewer than HEAVY words or
n-grams of one length can hold more than 1 / HEAVY of all words; these, and only these, are broadcast, so no key that is left
for the join is hot. A pair of such words is keyed by their two numbers instead of a hash, so that its table needs no context
column. A bitmap of BITS bits, whatever the corpus, tells of most n-grams that they aren't repeated. Of the others, a row for
an occurrence (its text and key) meets the tables; the join decides, so the bitmap's false positives change nothing but the
number of rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidenta.llm.common import numbered, slices, store

ALPHA = 0.4
ORDER = 2
LEAST = 2
MICRO = 1_000_000
#: Fewer n-grams than this are broadcast (16 bytes each).
HEAVY = 1 << 22
#: Bits of the bitmap of repeated n-grams of one length: the greatest prime below 2**26.
BITS = 67108859
#: Words that are handled at once.
STEP = 1 << 17
#: About so many occurrences of n-grams of one length are counted by one task.
BUCKET = 1 << 20
#: Words of more bytes are hashed one by one.
LONG = 64
#: Bytes of text that are split at once.
SLICE = 1 << 20
SEED = 42
#: A step back, in micro-nats.
PENALTY = round(math.log(ALPHA) * MICRO)

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))
_UNSPREAD = np.uint64(pow(int(_MIX[2]), -1, 1 << 64))
#: Columns of n-grams on their way to be counted; the last four hold arrays.
PACKED = ["bucket", "level", "keys", "n", "context", "shorter"]


def lowered(text: Column) -> Column:
    """A text lower-cased by Unicode's rules; empty for null."""
    return F.lower(F.coalesce(text, F.lit("")))


def longer(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of n-grams from those of the n-grams without the last word, and of that word."""
    with np.errstate(over="ignore"):
        x = context * _MIX[2] + word
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        return x ^ (x >> np.uint64(31))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between white space: hashes of the distinct ones, the number of each occurrence's, and words by text."""
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    there = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(there)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
    coded = pc.dictionary_encode(flat.filter(pa.array(there)))
    return digests(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False), np.diff(ends)


def digests(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words, eight bytes of all of them at once; XXH64 of words of over LONG bytes."""
    offsets, data = flat_bytes(words)
    size = np.diff(offsets)
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    out = longer(np.full(len(size), SEED, np.uint64), size.astype(np.uint64))
    use = np.flatnonzero(size <= LONG)
    for at in range(0, LONG, 8):
        use = use[size[use] > at]
        blank = (8 * np.maximum(at + 8 - size[use], 0)).astype(np.uint64)  # bits of the eight bytes that follow the word
        out[use] = longer(out[use], eight[offsets[use] + at] << blank)
    for k in np.flatnonzero(size > LONG):
        out[k] = xxhash.xxh64_intdigest(data[offsets[k] : offsets[k + 1]].tobytes(), SEED)
    return out


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a column of strings or binaries."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset :][: len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return offsets - offsets[0], np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]


def hashed(kind: int, h: np.ndarray) -> np.ndarray:
    """A hash as a key: its first two bits tell words (1), pairs (2) and longer n-grams (3) apart; 0 is a pair of frequent words."""
    return (h >> np.uint64(2)) | np.uint64(kind << 62)


class Known:
    """What a task knows of one length: the frequent keys with their counts and scores, and which others may be repeated."""

    def __init__(self, table: DataFrame, total: int, counts: bool = True):
        heavy = table.where(F.col("n") * HEAVY > total).select("key", "n", "micro").toArrow()  # fewer than HEAVY rows
        order = np.argsort(heavy.column("key").to_numpy())
        self.key, self.micro = (heavy.column(c).to_numpy()[order] for c in ("key", "micro"))
        self.n = heavy.column("n").to_numpy()[order] if counts else None
        at = F.pmod("key", F.lit(BITS))
        rows = table.where("n > 1").groupBy(F.shiftright(at, 15).alias("bucket")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("bits")).collect()  # BITS / 8 bytes
        self.bits = np.zeros((BITS >> 15) + 1 << 12, np.uint8)
        for r in rows:
            self.bits[r["bucket"] << 12 : r["bucket"] + 1 << 12] = np.frombuffer(r["bits"], np.uint8)

    def look(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of signed keys among the frequent ones (-1: not among them), and whether others may be repeated."""
        at = np.mod(key, BITS)
        maybe = (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        place = np.full(len(key), -1, np.int64)
        if len(self.key):
            k = np.flatnonzero(maybe)
            found = np.minimum(np.searchsorted(self.key, key[k]), len(self.key) - 1)
            place[k] = np.where(self.key[found] == key[k], found, -1)
        return place, maybe & (place < 0)


class Block:
    """Occurrences of a slice: their texts, positions, and for each length from 2 on the keys of the n-grams ending there."""

    def __init__(self, words: np.ndarray, place: np.ndarray, once: np.ndarray, position: np.ndarray, own: int, order: int):
        self.position, self.own = position[own:], own
        back = lambda x: np.concatenate([x[:1], x[:-1]])
        pair = (back(place) << 31) | place
        both = (place >= 0) & (back(place) >= 0)
        self.keys, self.contexts, self.here = [words.view(np.int64)], [words.view(np.int64)], [np.ones(len(words), bool)]
        alive = ~once
        for level in range(2, order + 1):
            alive = back(alive) & ~once & (position >= level - 1)  # an n-gram with a word that isn't repeated isn't either
            h = hashed(min(level, 3), longer(back(self.keys[-1]).view(np.uint64), words + np.uint64(level))).view(np.int64)
            self.contexts.append(back(self.keys[-1]))
            self.keys.append(np.where(both, pair, h) if level == 2 else h)
            self.here.append(alive)

    def level(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(which occurrences, their keys, keys without the last word, keys without the first word) of n-grams of n words."""
        use = np.flatnonzero(self.here[n - 1][self.own :])
        return use, *(x[self.own :][use] for x in (self.keys[n - 1], self.contexts[n - 1], self.keys[n - 2]))


def blocks(texts: pa.Array, known: Known, order: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, Block]]:
    """(place, text numbers, places among the frequent words, whether other words may be repeated, block), STEP words at once.

    A block begins with the `order` - 1 words before its place, which are only context.
    """
    hashes, codes, sizes = tokens(texts)
    words = hashed(1, hashes)
    place, maybe = known.look(words.view(np.int64))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    position = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    for a in range(0, len(codes), STEP):
        first = max(0, a - order + 1)
        part = slice(a, min(a + STEP, len(codes)))
        near = codes[first : part.stop]
        yield part, owner[part], place[codes[part]], maybe[codes[part]], Block(words[near], place[near], (place[near] < 0) & ~maybe[near], position[first : part.stop], a - first, order)


def word_counts(df: DataFrame) -> DataFrame:
    """(key, n) of all words of `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                hashes, codes, _ = tokens(part.column("text"))
                n = np.bincount(codes, minlength=len(hashes))
                yield pa.RecordBatch.from_arrays([pa.array(hashed(1, hashes).view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    return df.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values of a sorted array begin, and their lengths."""
    first = np.flatnonzero(np.concatenate([[len(x) > 0], x[1:] != x[:-1]]))
    return first, np.diff(first, append=len(x))


def packed(level: int, key: np.ndarray, others: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """A row for each bucket: its keys, spread evenly and sorted, how often each is there, and what else belongs to it."""
    spread = key.view(np.uint64) * _MIX[2]
    order = np.argsort(spread) if others else None
    spread = spread[order] if others else np.sort(spread)
    first, n = runs(spread)
    spread = spread[first]
    bucket = (spread >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    cut, _ = runs(bucket)

    def column(x: np.ndarray) -> pa.Array:
        ends = np.append(cut, len(x)) * x.itemsize
        return pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(x)])

    more = [column(x[order[first]]) for x in others] or [pa.nulls(len(cut), pa.binary())] * 2
    heads = [pa.array(bucket[cut].astype(np.int32)), pa.array(np.full(len(cut), level, np.int32))]
    return pa.RecordBatch.from_arrays([*heads, column(spread), column(n.astype(np.int32)), *more], PACKED)


def counted(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(level, key, n, context, shorter) of the keys that are there `least` times or more in the rows of whole buckets."""
    held = defaultdict(list)
    for batch in batches:
        levels, plain = batch.column("level").to_numpy(), batch.column("context").is_null().to_numpy(zero_copy_only=False)
        for level in np.unique(levels).tolist():
            for form in (True, False):
                rows = batch.filter(pa.array((levels == level) & (plain == form)))
                if rows.num_rows:
                    held[level, form].append([flat_bytes(rows.column(c))[1].view(t).copy() for c, t in zip(PACKED[2:4] if form else PACKED[2:], (np.uint64, np.int32, np.int64, np.int64))])
    for level, form in sorted(held):
        spread, n, *more = (np.concatenate(x) for x in zip(*held.pop((level, form)), strict=True))
        order = np.argsort(spread)
        spread = spread[order]
        first, _ = runs(spread)
        n = np.add.reduceat(n[order].astype(np.int64), first)
        use = np.flatnonzero(n >= least)
        at = first[use]
        key = (spread[at] * _UNSPREAD).view(np.int64)
        more = [pa.array(x[order[at]]) for x in more] or [pa.nulls(len(at), pa.int64())] * 2
        out = pa.RecordBatch.from_arrays([pa.array(np.full(len(at), level, np.int32)), pa.array(key), pa.array(n[use]), *more], ["level", "key", "n", "context", "shorter"])
        yield from (out.slice(k, STEP) for k in range(0, len(at), STEP))


def gram_counts(df: DataFrame, known: Known, order: int, least: int, total: int) -> DataFrame:
    """(level, key, n, context, shorter) of n-grams of 2 .. order words that are there `least` times; a pair of numbers has no context.

    Few n-grams of a task are there twice, so rows of a key each would be no fewer than the occurrences. A row is a bucket of
    keys, and the buckets are as many as the corpus needs for each to be counted in a task's memory.
    """
    shared = df.sparkSession.sparkContext.broadcast(known)
    buckets = total * (order - 1) // BUCKET + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                for *_, block in blocks(part.column("text"), shared.value, order):
                    for level in range(2, order + 1):
                        _, key, *others = block.level(level)
                        plain = (key >= 0) & (key >> 62 == 0)
                        yield packed(level, key[plain], [], buckets)
                        yield packed(level, key[~plain], [x[~plain] for x in others], buckets)

    found = df.select("text").mapInArrow(run, "bucket int, level int, keys binary, n binary, context binary, shorter binary")
    return found.repartitionById(buckets, "bucket").mapInArrow(lambda rows: counted(rows, least), "level int, key long, n long, context long, shorter long")


def differences(counts: DataFrame, below: DataFrame, known: Known, total: int) -> DataFrame:
    """(key, n, micro, hit) of repeated n-grams of one length: their scores (hit), and how much these exceed a step back.

    `below` is the same table of n-grams one word shorter.
    """
    shared = counts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            key, n = batch.column("key").to_numpy(), batch.column("n").to_numpy()
            hit = np.rint(np.log(n / words.n[key >> 31]) * MICRO).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(hit - PENALTY - words.micro[key & (1 << 31) - 1]), pa.array(hit)], ["key", "n", "micro", "hit"])

    plain = counts.where("context is null").select("key", "n").mapInArrow(run, "key long, n long, micro long, hit long")
    context = below.select(F.col("key").alias("context"), F.col("n").alias("n_context"))
    shorter = below.select(F.col("key").alias("shorter"), F.col("hit").alias("under"))
    hit = F.round(F.log(F.col("n") / F.col("n_context")) * MICRO).cast("long")
    other = counts.where("context is not null").join(context, "context").join(shorter, "shorter").select("key", "n", (hit - F.lit(PENALTY) - F.col("under")).alias("micro"), hit.alias("hit"))
    return plain.unionByName(other)


def requests(df: DataFrame, known: list[Known], order: int, once: int) -> DataFrame:
    """(row, key, micro, said): of each text a row with what is known (said: number of words and steps back), and its requests.

    A request has a key only: of a word or longer n-gram that may be repeated. What is known takes such words as read once.
    """
    shared = df.sparkSession.sparkContext.broadcast(known)
    names = ["row", "key", "micro", "said"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                rows = part.column("row").to_numpy()
                micro, steps, words = (np.zeros(len(rows), np.int64) for _ in range(3))
                for _, owner, place, maybe, block in blocks(part.column("text"), tables[0], order):
                    add = lambda to, of, x: np.add.at(to, of, x)
                    behind = np.minimum(block.position, order - 1)
                    own = np.full(len(place), once)
                    if len(tables[0].key):
                        own = np.where(place >= 0, tables[0].micro[place], own)
                    add(micro, owner, own + behind * PENALTY)
                    add(steps, owner, behind)
                    add(words, owner, 1)
                    asked = [(owner[maybe], block.keys[0][block.own :][maybe])]
                    for level in range(2, order + 1):
                        use, key, *_ = block.level(level)
                        at, unsure = tables[level - 1].look(key)
                        sure = at >= 0
                        add(micro, owner[use[sure]], tables[level - 1].micro[at[sure]])
                        add(steps, owner[use[sure]], -1)
                        asked.append((owner[use[unsure]], key[unsure]))
                    of, key = (np.concatenate(x) for x in zip(*asked, strict=True))
                    none = pa.nulls(len(of), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(rows[of]), pa.array(key), none, none], names)
                key = longer(rows.view(np.uint64), np.uint64(SEED)).view(np.int64)  # spreads the rows
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(key), pa.array(micro), pa.array((words << 32) | steps)], names)

    return df.mapInArrow(run, "row long, key long, micro long, said long")


def lm_scores(df: DataFrame, text: str = "text", order: int = ORDER, least: int = LEAST) -> DataFrame:
    """Add n_words, n_backoffs and log_score (nats: the sum over words given up to `order` - 1 words before them).

    The first words of a text are scored by the context there is. A null or empty text has no words and the score 0.0. The
    counts are those of all rows, repeated rows included. Every row gives one row; an empty table gives an empty one. Other
    columns pass through, an input column with the name of a result is replaced. Words and n-grams are told apart by 62-bit
    hashes. The tables are written below the shared folder.
    """
    if least < 2 or order < 1:
        raise ValueError("an order of 1 or more and a least count of 2 or more are needed")
    source, row = numbered(df)
    slim = source.select(F.col(row).alias("row"), lowered(F.col(text)).alias("text"))
    words = store(word_counts(slim), "lm-words")
    total = words.agg(F.sum("n")).first()[0] or 1
    score = F.round(F.log(F.col("n") / total) * MICRO).cast("long")
    tables = [words.select("key", "n", score.alias("micro"), score.alias("hit"))]
    known = [Known(tables[0], total)]
    if order > 1:
        counts = store(gram_counts(slim, known[0], order, least, total), "lm-counts", "level")
        for level in range(2, order + 1):
            tables.append(store(differences(counts.where(F.col("level") == level), tables[-1], known[0], total), "lm-grams"))
            known.append(Known(tables[-1], total, counts=False))
    once = round(math.log(1 / total) * MICRO)
    more = [F.col("micro") - F.lit(once if k == 0 else 0) for k in range(order)]
    light = [t.where((F.col("n") > 1) & (F.col("n") * HEAVY <= total)).select("key", more[k].alias("more"), F.lit(k > 0).alias("step")) for k, t in enumerate(tables)]
    met = requests(slim, known, order, once).join(reduce(DataFrame.unionByName, light), "key", "left")
    asked = F.col("said").isNull()
    sums = met.groupBy("row").agg(F.max("said").alias("said"), F.sum(F.when(asked, F.coalesce("more", F.lit(0))).otherwise(F.col("micro"))).alias("micro"), F.count_if(asked & F.col("step")).alias("less"))
    words_, steps = F.shiftright("said", 32), F.col("said").bitwiseAND(F.lit((1 << 32) - 1))
    results = sums.select(F.col("row").alias(row), words_.alias("n_words"), (steps - F.col("less")).alias("n_backoffs"), (F.col("micro") / F.lit(float(MICRO))).alias("log_score"))
    return source.drop("n_words", "n_backoffs", "log_score").join(results, row, "left").drop(row)
