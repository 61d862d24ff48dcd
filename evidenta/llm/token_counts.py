"""Token counts as a public tokenizer library gives them, with overlap resynchronisation for huge documents.

A text of at most `chunk_chars` characters is encoded whole. A longer one is encoded in overlapping chunks with offsets. The
tokens of two neighbouring chunks are spliced at a common boundary that is proved to be stable: a position in their overlap
where both begin a new pre-token, `MARGIN` characters or more away from either chunk's cut ends. Pre-tokenization runs from
left to right without look-behind and merges never cross pre-tokens, so after such a position the right chunk's tokens are
those of the whole text, and before it the left chunk's are. If there is no common boundary, the overlap is doubled, at last
up to the left chunk's own start; then both are encoded as one, which reaches twice as far each time, so that a run without
any boundary costs a small multiple of its length.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from evidenta.llm.common import fresh, slices

#: A boundary so close to a cut end isn't trusted: special strings and contractions may be cut there.
MARGIN = 64


class Counter:
    """Ids and counts by the tokenizers library (.json) or sentencepiece (.model)."""

    def __init__(self, path: str, chunk_chars: int, overlap: int):
        if not 2 * MARGIN < overlap < chunk_chars:
            raise ValueError("the overlap must exceed two margins and be shorter than a chunk")
        self.chunk, self.overlap = chunk_chars, overlap
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.splices = False
        else:
            from tokenizers import Tokenizer

            self.pieces = None
            self.tokens = Tokenizer.from_file(path)
            self.tokens.no_truncation()
            self.tokens.no_padding()
            self.tokens.post_processor = None  # it may trim offsets; ids don't depend on it without special tokens
            # the proof needs byte-level pre-tokens of the text as it is
            pre = self.tokens.pre_tokenizer
            self.splices = self.tokens.normalizer is None and type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and all(len(t.content) < MARGIN and not (t.lstrip or t.rstrip or t.single_word) for t in self.tokens.get_added_tokens_decoder().values())

    def counts(self, texts: list[str]) -> list[int]:
        long = {k for k, x in enumerate(texts) if len(x) > self.chunk and self.splices}
        short = [x for k, x in enumerate(texts) if k not in long]
        if self.pieces is not None:
            found = iter(map(len, self.pieces.encode(short, num_threads=1)))
        else:
            found = iter(len(e.ids) for e in self.tokens.encode_batch_fast(short, add_special_tokens=False))
        return [sum(map(len, self.spliced(x))) if k in long else next(found) for k, x in enumerate(texts)]

    def encoded(self, text: str, start: int, end: int) -> tuple[list[int], dict[int, int]]:
        """Ids of text[start:end], and the number of ids before each position that begins a pre-token."""
        e = self.tokens.encode(text[start:end], add_special_tokens=False)
        words, offsets = e.word_ids, e.offsets
        begins = {offsets[k][0] + start: k for k in range(len(words)) if k == 0 or words[k] is None or words[k] != words[k - 1]}
        return e.ids, begins

    def spliced(self, text: str) -> Iterator[list[int]]:
        """Ids of a whole text, in pieces."""
        n, start, end, step = len(text), 0, min(len(text), self.chunk), self.chunk - self.overlap
        ids, begins = self.encoded(text, start, end)
        while end < n:
            # no overlap is of use that doesn't reach back beyond the left chunk's last boundary
            last = max((p for p in begins if p <= end - MARGIN), default=start)
            overlap = max(self.overlap, end - last + 2 * MARGIN)
            while True:
                back = max(start, end - overlap) if last > start else start
                further = min(n, end + step)
                if back == start:  # no stable boundary anywhere: both as one
                    ids, begins = self.encoded(text, start, further)
                    end, step = further, 2 * step
                    break
                new_ids, new_begins = self.encoded(text, back, further)
                at = max((p for p in begins.keys() & new_begins.keys() if back + MARGIN <= p <= end - MARGIN), default=None)
                if at is not None:
                    yield ids[: begins[at]]
                    first = new_begins[at]
                    ids = new_ids[first:]
                    begins = {p: k - first for p, k in new_begins.items() if p >= at}
                    start, end, step = at, further, self.chunk - self.overlap
                    break
                overlap *= 2
        yield ids


@lru_cache(maxsize=4)
def load(path: str, chunk_chars: int, overlap: int) -> Counter:
    return Counter(path, chunk_chars, overlap)


def token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 512, chunk_chars: int = 1 << 14, overlap: int = 1 << 9) -> DataFrame:
    """Add n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of `text` to every row.

    Counts are those of the whole text, without added begin or end tokens. A null text counts as empty (0 bytes, 0 tokens).
    Rows are independent: repeated rows give repeated results, an empty table an empty one; other columns pass through, an
    input column with the name of a result is replaced.
    """
    made = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    names = {f.name for f in made}
    hidden = fresh(df, "__text")
    source = df.withColumnRenamed(text, hidden) if text in names else df
    column = hidden if text in names else text
    kept = [f for f in source.schema.fields if f.name not in names and f.name != hidden]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path, chunk_chars, overlap)
        for batch in batches:
            for part in slices(batch, column):
                texts = [x or "" for x in part.column(column).to_pylist()]
                n = counter.counts(texts)
                arrays = [pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *arrays], [*(f.name for f in kept), *(f.name for f in made)])

    return source.mapInArrow(run, T.StructType([*kept, *made]))
