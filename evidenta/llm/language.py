"""Hierarchical language identification: family first, then one-versus-one linear support vector machines within it.

Features are counts of letter trigrams (UTF-8 bytes in 64 classes) of the whole lower-cased text. All machines are linear and
without bias, so a text's decision is the sign of a sum of weights over its trigrams, taken block by block in numpy. They are
fitted on the driver from a bounded sample: at most PER_LANGUAGE labelled documents of each language, those with the least
hash of their key, each giving its distinct trigrams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidenta.llm.common import fresh, slices

#: Families of languages that are easily confused; any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl"),
    "finnic": ("fi", "et"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "mr", "ne"),
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
#: Labelled documents of a language that the machines are fitted on, at most.
PER_LANGUAGE = 600
#: Leading bits of a key's hash by which labelled rows are counted before they are ranked.
BUCKET_BITS = 10
DIMS = 64**3
LETTER = regex.compile(r"\p{L}")
#: How fast a decision's score goes from 0.5 to 1 with the mean weight of a trigram, in units of its spread in training.
STEEPNESS = 3.0
STEP = 1 << 20
#: The weights of all machines take so many bytes at most; with many languages, trigrams share weights to keep within it.
MODEL_BYTES = 64 << 20
LEAST_DIMS = 1 << 10

_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27 + np.arange(128) % 37


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Codes of the trigrams of a text, with one space around runs of letters, in blocks."""
    raw = np.frombuffer((" " + text.lower() + " ").encode(), np.uint8)
    for k in range(0, len(raw), STEP):
        c = _CLASS[raw[k : k + STEP + 2]]
        code = (c[:-2] << 12) + (c[1:-1] << 6) + c[2:]
        yield code[(c[1:-1] != 0)]  # its middle is a letter


def dims_of(machines: int) -> int:
    """Weights of a machine: a power of two, at most DIMS, by which all machines stay within MODEL_BYTES."""
    dims = DIMS
    while 4 * dims * machines > MODEL_BYTES:
        dims //= 2
    if dims < LEAST_DIMS:
        raise ValueError(f"{machines} machines don't fit into {MODEL_BYTES} bytes: too many languages")
    return dims


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dims: int = DIMS, rounds: int = 12, cost: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights of a linear support vector machine by dual coordinate descent, and the spread of its mean weights."""
    w, alpha = np.zeros(dims), np.zeros(len(rows))
    xs = [(i, v / np.sqrt((v * v).sum())) for i, v in rows]
    order = np.random.default_rng(0)
    for _ in range(rounds):
        for k in order.permutation(len(xs)):
            i, v = xs[k]
            new = min(max(alpha[k] - (y[k] * (w[i] @ v) - 1.0), 0.0), cost)
            if new != alpha[k]:
                w[i] += (new - alpha[k]) * y[k] * v
                alpha[k] = new
    means = [abs(w[i] @ v) / v.sum() for i, v in rows]
    return w.astype(np.float32), float(np.median(means)) or 1.0


class Model:
    """Machines of the family decision and of each family, all one-versus-one."""

    def __init__(self, rows: list[tuple[str, np.ndarray, np.ndarray]]):
        langs = sorted({lang for lang, _, _ in rows})
        groups: dict[str, list[str]] = {}
        for lang in langs:
            groups.setdefault(FAMILY.get(lang, "only " + lang), []).append(lang)
        self.groups = groups
        of = {lang: family for family, own in groups.items() for lang in own}
        self.dims = dims_of(math.comb(len(groups), 2) + sum(math.comb(len(own), 2) for own in groups.values()))
        if self.dims < DIMS:
            rows = [(lang, np.unique(i % self.dims), np.bincount(i % self.dims, v, self.dims)[np.unique(i % self.dims)]) for lang, i, v in rows]
        self.family = {(a, b): self._pair(rows, lambda r, a=a, b=b: (of[r] == a) - (of[r] == b)) for a, b in combinations(sorted(groups), 2)}
        self.within = {own_family: {(a, b): self._pair(rows, lambda r, a=a, b=b: (r == a) - (r == b)) for a, b in combinations(own, 2)} for own_family, own in groups.items()}

    def _pair(self, rows, side) -> tuple[np.ndarray, float]:
        own = [(i, v.astype(np.float64), side(lang)) for lang, i, v in rows]
        own = [x for x in own if x[2]]
        return fit([x[:2] for x in own], np.array([x[2] for x in own], np.float64), self.dims)

    @staticmethod
    def _vote(names: list[str], machines: dict, codes: list[np.ndarray], n: int) -> tuple[str, float]:
        if len(names) == 1:
            return names[0], 1.0
        wins, margin = dict.fromkeys(names, 0), {}
        for (a, b), (w, spread) in machines.items():
            m = float(sum(w[c].sum(dtype=np.float64) for c in codes)) / n / spread
            wins[a if m > 0 else b] += 1
            margin[a, b] = m
        best = max(names, key=lambda x: (wins[x], -names.index(x)))
        least = min((m if a == best else -m) for (a, b), m in margin.items() if best in (a, b))
        return best, 1.0 / (1.0 + math.exp(-STEEPNESS * max(-50.0, min(50.0, least))))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score); `und` and 0 if there is no letter. The score is the weaker of the two decisions'."""
        if not text or not LETTER.search(text) or not self.groups:
            return "und", 0.0
        codes = [c % self.dims for c in trigrams(text) if len(c)]
        n = sum(map(len, codes))
        if not n:
            return "und", 0.0
        family, sure = self._vote(sorted(self.groups), self.family, codes, n)
        lang, own = self._vote(self.groups[family], self.within[family], codes, n)
        return lang, min(sure, own)


def train(df: DataFrame, where=None, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit the machines on labelled rows of `df` (those that `where` allows); rows with a null text, key or language are left out.

    An empty table, or one without a label, gives a model that knows no language. Rows that repeat a key count as one draw and
    all enter the fit; equal texts under different keys are rows of their own. Of tied votes, the first name in order wins.
    """
    known = df.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & F.col(text).isNotNull())
    known = known if where is None else known.where(where)
    ids = known.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.xxhash64(F.col(key)).alias("hash")).withColumn("bucket", F.shiftright("hash", 64 - BUCKET_BITS))
    # only the hash buckets that the least hashes lie in are ranked, so that a frequent language isn't sorted in one task
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = ids.groupBy("lang", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
    reached = sizes.where(F.col("before") < per_language).select("lang", "bucket")  # at most 2**BUCKET_BITS rows of a language
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "key"))
    ids = ids.join(F.broadcast(reached), ["lang", "bucket"], "left_semi").withColumn("rank", rank).where(F.col("rank") <= per_language)
    ids = ids.select("key").distinct()  # at most per_language keys for each language
    chosen = known.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")).join(F.broadcast(ids), "key", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [np.unique(np.concatenate([*trigrams(x), np.zeros(0, np.int64)]), return_counts=True) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([i.astype(np.int32) for i, _ in found], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))], ["lang", "i", "v"])

    rows = chosen.mapInArrow(run, "lang string, i array<int>, v array<float>").toArrow().to_pydict()
    found = [(lang, np.array(i, np.int64), np.array(v)) for lang, i, v in zip(rows["lang"], rows["i"], rows["v"], strict=True) if i]
    found.sort(key=lambda r: (r[0], len(r[1]), r[1].tolist()))  # the fit doesn't depend on the order of rows
    return Model(found)


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred and score (0 to 1) of every whole text.

    `und` with score 0 for a null or empty text, or one without a letter, or if the model has seen no language. Rows are
    independent; other columns pass through, an input column with the name of a result is replaced.
    """
    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    names = {f.name for f in made}
    hidden = fresh(df, "__text")
    source = df.withColumnRenamed(text, hidden) if text in names else df
    column = hidden if text in names else text
    kept = [f for f in source.schema.fields if f.name not in names and f.name != hidden]
    shared = df.sparkSession.sparkContext.broadcast(model)  # MODEL_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = shared.value
        for batch in batches:
            for part in slices(batch, column):
                found = [machines.predict(x) for x in part.column(column).to_pylist()]
                arrays = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *arrays], [*(f.name for f in kept), *(f.name for f in made)])

    return source.mapInArrow(run, T.StructType([*kept, *made]))
