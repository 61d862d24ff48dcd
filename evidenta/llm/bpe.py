"""BPE encoding and decoding by backtracking over longest token matches.

A byte-level BPE vocabulary is compiled into three tables:

* an Aho-Corasick automaton over all tokens: one pass over a pre-token finds the longest token that starts at every byte;
* a pair-compatibility test: two neighbouring tokens may stand in a result if and only if merging their joined bytes from
  scratch would leave exactly these two. It follows from the merge tree and is memoised;
* a shorter-token table: the longest token that is a proper prefix of a token, the next candidate on backtracking.

The encoder walks left to right, takes the longest candidate that is compatible with its left neighbour, and otherwise
shortens or steps back; positions proved to be dead ends are marked, so each is tried once for every token that starts
there and the time is linear in the text. Decoding gathers bytes through an offset table over one blob of all tokens.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from evidenta.llm.common import blocks, fresh, pieces, slices

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies of 50,257 entries.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids are remembered by a worker. A full table becomes the older one, from which what recurs is taken over, and
#: the one before it goes, so memory is bounded.
REMEMBERED = 300_000
#: Ids that are decoded at once.
DECODE_IDS = 1 << 18


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary file writes for each byte: itself if printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder of one vocabulary file of the tokenizers library (byte-level BPE without a normaliser)."""

    def __init__(self, spec: dict):
        model, letters = spec["model"], byte_letters()
        added = spec.get("added_tokens") or []
        if spec.get("normalizer") or model["type"] != "BPE" or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("only plain byte-level BPE files are supported")
        pre = spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only the plain byte-level pre-tokenizer is supported")
        self.special = {t["content"]: t["id"] for t in added}
        raw = {word: bytes(letters[c] for c in word) for word in model["vocab"] if word not in self.special}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for word, at in model["vocab"].items():
            self.bytes[at] = raw.get(word, word.encode())
        for word, at in self.special.items():
            self.bytes[at] = word.encode()
        self.offsets = np.cumsum([0, *map(len, self.bytes)])
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        # merge rank of each token and the two tokens it is merged from
        vocab, self.rank, self.parts, self.merged = model["vocab"], {}, {}, {}
        for k, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, made = vocab[left], vocab[right], vocab[left + right]
            self.merged[a, b] = (k, made)
            if made not in self.parts:
                self.parts[made], self.rank[made] = (a, b), k
        self.ids = {word: vocab[name] for name, word in raw.items()}
        # tokens that no sequence of merges can make are never the result of an encoding
        self.matcher = ahocorasick.Automaton()
        reachable = {word: at for word, at in self.ids.items() if len(word) == 1 or at in self.parts and self._whole(at)}
        for word, at in reachable.items():
            self.matcher.add_word(word.decode("latin-1"), (at, 1 - len(word)))
        self.matcher.make_automaton()
        self.shorter = {at: next((reachable[word[:n]] for n in range(len(word) - 1, 0, -1) if word[:n] in reachable), -1) for word, at in reachable.items()}
        self.whole = {word: at for word, at in reachable.items()}
        self.sizes = [*map(len, self.bytes)]
        self.fits: dict[int, bool] = {}
        self.words: dict[str, list[int]] = {}  # ids of remembered pre-tokens
        self.older_words: dict[str, list[int]] = {}
        self.known: dict[str, tuple[str, bytes]] = {}  # of each remembered piece, with the space before it: its ids in decimal and as int32
        self.older: dict[str, tuple[str, bytes]] = {}
        self.names = [*map(str, range(size))]
        self.find = regex.compile(PATTERN).findall
        self.maybe = regex.compile("|".join(map(regex.escape, self.special)) or "(?!)").search
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def _whole(self, token: int) -> bool:
        """Whether merging a token's own bytes from scratch gives back that token."""
        a, b = self.parts[token]
        return all(t not in self.parts or self._whole(t) for t in (a, b)) and self._pair(a, b, self.rank[token])

    def _pair(self, a: int, b: int, before: int) -> bool:
        """Whether no merge across the border of a and b comes earlier than `before` and than those that complete a or b.

        Both sides are undone step by step, the later merge first; at each step the two tokens at the border are those that
        stand there while the lower ranks are being merged.
        """
        while True:
            rank, _ = self.merged.get((a, b), (None, None))
            if rank is not None and rank < before:
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                before, a = ra, self.parts[a][1]
            else:
                # of equal merges the left one comes first, so the right one is undone first and a border merge of its rank wins
                before, b = rb + 1, self.parts[b][0]

    def _compatible(self, a: int, b: int) -> bool:
        if len(self.fits) > 2 * REMEMBERED:
            self.fits.clear()
        found = self.fits[a << 32 | b] = self._pair(a, b, len(self.merged) + 1)
        return found

    def encode_pretoken(self, data: bytes) -> list[int]:
        """Ids of one pre-token, by longest matches and backtracking."""
        if (whole := self.whole.get(data)) is not None:
            return [whole]
        n = len(data)
        longest = [0] * n
        for end, (token, back) in self.matcher.iter(data.decode("latin-1")):
            longest[end + back] = token  # ends come in ascending order, so the last one is the longest
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        sizes, fits, shorter = self.sizes, self.fits, self.shorter
        at, token, left = 0, longest[0] if n else 0, -1
        while at < n:
            end = at + sizes[token]
            if alive[end]:
                if left < 0:
                    fit = True
                else:
                    fit = fits.get(left << 32 | token)
                    if fit is None:
                        fit = self._compatible(left, token)
                if fit:
                    out.append(token)
                    at, left = end, token
                    if at < n:
                        token = longest[at]
                    continue
            token = shorter[token]
            while token < 0:
                alive[at] = 0
                last = out.pop()
                left = out[-1] if out else -1
                at -= sizes[last]
                token = shorter[last]
        return out

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of any text: special tokens first, then pre-tokens."""
        out: list[int] = []
        for k, part in enumerate(self.cut(piece) if self.cut and self.maybe(piece) else [piece]):
            if k % 2:
                out.append(self.special[part])
            else:
                for word in self.find(part):
                    ids = self.words.get(word)
                    if ids is None:
                        ids = self.older_words.get(word) or self.encode_pretoken(word.encode())
                        if len(self.words) >= REMEMBERED:
                            self.older_words, self.words = self.words, {}
                        if len(word) <= 200:
                            self.words[word] = ids
                    out += ids
        return out

    def _remember(self, piece: str) -> tuple[str, bytes]:
        found = self.older.get(piece)
        if found is None:
            ids = self.encode_piece(" " + piece)
            found = ",".join(map(self.names.__getitem__, ids)), array("i", ids).tobytes()
        if len(piece) <= 200:
            if len(self.known) >= REMEMBERED:
                self.older, self.known = self.known, {}
            self.known[piece] = found
        return found

    def encode_blocks(self, text: str) -> Iterator[tuple[str, np.ndarray]]:
        """The ids of a text, in decimal and as numbers, for one block of pieces after the other."""
        for block in blocks(text):
            first, *rest = pieces(block)
            if first.startswith(" "):  # any block but the first
                rest, first = [first[1:], *rest], None
            head = [] if first is None else self.encode_piece(first)
            get, remember = self.known.get, self._remember
            decimals, raw = zip(*[get(p) or remember(p) for p in rest], strict=True) if rest else ((), ())
            ids = np.frombuffer(array("i", head).tobytes() + b"".join(raw), np.int32)
            if len(ids):
                yield ",".join([*([",".join(map(str, head))] if head else []), *decimals]), ids

    def encode(self, text: str) -> list[int]:
        return [t for _, ids in self.encode_blocks(text) for t in ids.tolist()]

    def decode_bytes(self, ids: np.ndarray) -> Iterator[bytes]:
        """Bytes of the ids, by the offset table, in blocks of DECODE_IDS ids."""
        for k in range(0, len(ids), DECODE_IDS):
            block = ids[k : k + DECODE_IDS]
            first, sizes = self.offsets[block], self.offsets[block + 1] - self.offsets[block]
            ends = np.cumsum(sizes)
            yield self.blob[np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes()

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that are no valid UTF-8 become U+FFFD."""
        return b"".join(self.decode_bytes(np.asarray(ids, np.int64))).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """Compiled once for each Python worker."""
    with open(path, encoding="utf-8") as f:
        return Bpe(json.load(f))


def bpe_round_trip(df: DataFrame, path: str, text: str = "text", keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """Encode and decode `text` of every row with the vocabulary file at `path`.

    Adds n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the decoded text in UTF-8), and on
    request token_ids (array<int>) and decoded. A null text counts as empty: no ids, digests of the empty string. Rows are
    independent: repeated rows give repeated results, an empty table an empty one; other columns pass through, an input
    column with the name of a result is replaced.
    """
    made = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    made += [T.StructField("token_ids", T.ArrayType(T.IntegerType()))] * keep_ids + [T.StructField("decoded", T.StringType())] * keep_text
    names = {f.name for f in made}
    clash = text in names
    hidden = fresh(df, "__text")
    source = df.withColumnRenamed(text, hidden) if clash else df
    column = hidden if clash else text
    kept = [f for f in source.schema.fields if f.name not in names and f.name != hidden]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in slices(batch, column):
                rows = [_digests(bpe, x or "", keep_ids, keep_text) for x in part.column(column).to_pylist()]
                arrays = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *arrays], [*(f.name for f in kept), *(f.name for f in made)])

    types = [pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32())] * keep_ids + [pa.string()] * keep_text
    return source.mapInArrow(run, T.StructType([*kept, *made]))


def _digests(bpe: Bpe, text: str, keep_ids: bool, keep_text: bool) -> tuple:
    total, ids_hash, decoded_hash = 0, hashlib.sha256(), hashlib.sha256()
    kept: list[int] = []
    parts: list[bytes] = []
    for decimals, ids in bpe.encode_blocks(text):
        ids_hash.update(("," * bool(total) + decimals).encode())
        total += len(ids)
        for data in bpe.decode_bytes(ids):
            decoded_hash.update(data)
            if keep_text:
                parts.append(data)
        if keep_ids:
            kept += ids.tolist()
    return (total, ids_hash.hexdigest(), decoded_hash.hexdigest(), *([kept] * keep_ids), *([b"".join(parts).decode("utf-8", "replace")] * keep_text))
