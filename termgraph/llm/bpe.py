"""Byte-level BPE: encoding and decoding with vectorised pre-tokenisation.

Pre-tokens are those of the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|white space not before text|white space

found without a regex.  Each code point gets a class (letter, number, other, white space, and the cases
that need a look ahead: the last of a run of white space, an apostrophe before a contraction).  A class is a
function on the eight states of a small automaton; functions compose associatively, so a text is scanned in
blocks at once: compose inside every block, scan the blocks' functions by doubling, then run every block from its
entry state.  A token begins where the automaton says so; texts are parted by a class that forgets the state.

The slices are hashed, made distinct, and merged pair by pair once per worker and slice (a cache of slice -> ids);
ids and the byte offset of every token come back as arrays.  Decoding joins the bytes of the ids and uses no more
than the ids; the offsets map a token to its place in the text.

Defined cases: NULL gives NULL ids and offsets and decodes to NULL; an empty text gives empty arrays and decodes to
an empty text; special tokens' strings are ordinary text; ids outside the vocabulary raise an error in decoding; decoding
bytes that aren't UTF-8 (a part of a character) puts U+FFFD; rows are independent, so repeated rows and other columns
matter to nothing; an empty table gives an empty table; existing columns named as the new ones stay and the new ones
get leading underscores.
"""

from __future__ import annotations

import base64
import heapq
import os
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termgraph.llm.vectortext import buffers, span_hashes
from termgraph.storage import fresh_name

CHUNK_BYTES = 1 << 20
CACHE_SLICES = 500_000
_BLOCK = 256

# classes of code points, with look ahead
_LETTER, _NUMBER, _OTHER, _SPACE, _LAST_BLANK, _LAST_SPACE, _QUOTE1, _QUOTE2 = range(8)
# states: done, in letters, numbers, others, white space; after one blank; one or two letters of a contraction to come
_DONE, _L, _N, _O, _W, _B, _C1, _C2 = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, begins a token) by class and state; class + 8: the first of a text."""
    to, begins = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    for s in range(8):
        for c, (own, goes_on) in enumerate([(_L, (_L, _B)), (_N, (_N, _B)), (_O, (_O, _B)), (_W, (_W,)), (_B, ()), (_DONE, ()), (_C1, ()), (_C2, ())]):
            to[c, s], begins[c, s] = own, s not in goes_on
    to[_LETTER, _C1], begins[_LETTER, _C1] = _DONE, False
    to[_LETTER, _C2], begins[_LETTER, _C2] = _C1, False
    for c in (_QUOTE1, _QUOTE2):  # inside others, or after a blank, an apostrophe is one of the others
        for s in (_O, _B):
            to[c, s], begins[c, s] = _O, False
    to[8:] = to[:8, _DONE][:, None]
    return to, begins


_TO, _BEGINS = _automaton()


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point without look ahead."""
    table = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = _LETTER
        elif kind == "N":
            table[c] = _NUMBER
    table[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    return table


def token_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Which code points begin a pre-token; ``text_starts``: where a text (not empty) begins."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    cls = _classes()[points]
    first = np.zeros(n + 3, bool)
    first[text_starts] = True
    first[n:] = True
    space = cls == _SPACE
    last = np.flatnonzero(space & ~first[1 : n + 1] & ~np.append(space[1:], True))
    cls[last] = np.where(points[last] == 0x20, _LAST_BLANK, _LAST_SPACE)
    quote = np.flatnonzero((points == 0x27) & ~first[1 : n + 1])
    if len(quote):
        a = points[quote + 1]
        one = (a == 0x73) | (a == 0x74) | (a == 0x6D) | (a == 0x64)
        cls[quote[one]] = _QUOTE1
        quote, a = quote[~one & ~first[quote + 2]], a[~one & ~first[quote + 2]]
        b = points[np.minimum(quote + 2, n - 1)]
        two = ((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C))
        cls[quote[two]] = _QUOTE2
    cls[first[:n]] += 8
    blocks = -(-n // _BLOCK)
    grid = np.full(blocks * _BLOCK, _OTHER, np.uint8)
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(blocks, _BLOCK).T).astype(np.intp) * 8
    to = _TO.ravel()
    fun = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    for column in grid:  # compose the functions of each block
        fun = to[column[:, None] + fun]
    hop = 1
    while hop < blocks:  # inclusive scan: fun[i] after fun[i - hop]
        fun[hop:] = np.take_along_axis(fun[hop:], fun[:-hop].astype(np.intp), axis=1)
        hop *= 2
    state = np.zeros(blocks, np.uint8)
    state[1:] = fun[:-1, _DONE]
    begins = _BEGINS.ravel()
    out = np.empty((_BLOCK, blocks), bool)
    for j, column in enumerate(grid):
        at = column + state
        out[j] = begins[at]
        state = to[at]
    return out.T.ravel()[:n]


class Vocabulary:
    """Ranks of byte strings (a .tiktoken file); merging, decoding and the cache of slices."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(t): int(r) for t, r in pairs}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for t, r in self.ranks.items():
            tokens[r] = t
        self.known = np.zeros(size, bool)
        self.known[list(self.ranks.values())] = True
        self.bytes_ = np.frombuffer(b"".join(tokens), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
        self.forget()

    def forget(self) -> None:
        self.slices: dict[int, int] = {}
        self.pool = np.zeros(1 << 16, np.int32)
        self.starts, self.sizes, self.used = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def merge(self, piece: bytes) -> list[int]:
        """Join the adjacent pair of the lowest rank (the first of equals) until none is in the vocabulary."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > 200:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        cost = [ranks.get(parts[i] + parts[i + 1], 1 << 30) for i in range(len(parts) - 1)]
        while cost:
            least = min(cost)
            if least == 1 << 30:
                break
            i = cost.index(least)
            parts[i] += parts.pop(i + 1)
            cost.pop(i)
            if i:
                cost[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
            if i < len(cost):
                cost[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap and a linked list: n log n for runs of thousands of bytes."""
        ranks, n = self.ranks, len(piece)
        end, back = list(range(1, n + 1)), list(range(-1, n - 1))  # part i is piece[i:end[i]]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop or not alive[end[i]]:
                continue
            j = end[i]
            alive[j] = False
            end[i] = end[j]
            if end[i] < n:
                back[end[i]] = i
                if (r := ranks.get(piece[i : end[end[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[end[i]]))
            if back[i] >= 0 and (r := ranks.get(piece[back[i] : end[i]])) is not None:
                heapq.heappush(heap, (r, back[i], end[i]))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def look_up(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Cache entry of each distinct slice, merging those that are new."""
        if self.used > CACHE_SLICES:
            self.forget()
        out = np.empty(len(hashes), np.int64)
        slices, new = self.slices, []
        for k, h in enumerate(hashes.tolist()):
            entry = slices.get(h)
            if entry is None:
                entry = slices[h] = self.used + len(new)
                new.append(k)
            out[k] = entry
        if new:
            data = raw.tobytes()
            ids = [self.merge(data[a:b]) for a, b in zip(starts[new].tolist(), ends[new].tolist())]
            sizes = np.array([len(i) for i in ids], np.int64)
            top = int(self.starts[self.used - 1] + self.sizes[self.used - 1]) if self.used else 0
            flat = np.fromiter((x for i in ids for x in i), np.int32, int(sizes.sum()))
            while len(self.pool) < top + len(flat):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            while len(self.starts) < self.used + len(new):
                self.starts, self.sizes = np.concatenate([self.starts, np.zeros_like(self.starts)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            self.pool[top : top + len(flat)] = flat
            self.starts[self.used : self.used + len(new)] = top + np.cumsum(sizes) - sizes
            self.sizes[self.used : self.used + len(new)] = sizes
            self.used += len(new)
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... of each range, end to end."""
    total = int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(total)


def encode_column(column: pa.Array, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of each text as offsets, ids, byte offset of each token in its text)."""
    data, offsets = buffers(column)
    raw = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(raw):
        return np.zeros(len(offsets), np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((raw & 0xC0) != 0x80)  # byte of each code point
    text_starts = np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0])
    starts = at[token_starts(points, text_starts)]
    ends = np.append(starts[1:], len(raw))
    hashes, where, back = np.unique(span_hashes(raw, starts, ends), return_index=True, return_inverse=True)
    entry = vocab.look_up(hashes, starts[where], ends[where], raw)[back]
    sizes = vocab.sizes[entry]
    ids = vocab.pool[_ranges(vocab.starts[entry], sizes)]
    lengths = vocab.at[ids + 1] - vocab.at[ids]
    place = np.cumsum(lengths) - lengths
    bounds = np.searchsorted(place, offsets)
    return bounds, ids, (place - np.repeat(offsets[:-1], np.diff(bounds))).astype(np.int32)


def decode_column(bounds: np.ndarray, ids: np.ndarray, vocab: Vocabulary) -> pa.Array:
    """The text of each list of ids."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(vocab.known) or not vocab.known[ids].all()):
        raise ValueError("an id isn't in the vocabulary")
    sizes = vocab.at[ids + 1] - vocab.at[ids]
    out = vocab.bytes_[_ranges(vocab.at[ids], sizes)]
    ends = np.concatenate([[0], np.cumsum(sizes)])[bounds]
    try:
        out.tobytes().decode("utf-8")
        lead = np.append((out & 0xC0) != 0x80, True)
        if not lead[ends].all():
            raise UnicodeError
    except UnicodeError:
        data = out.tobytes()
        return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])], pa.large_string())
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out))


def _pieces(column: pa.Array) -> Iterator[tuple[int, int]]:
    _, offsets = buffers(column)
    row, last = 0, len(offsets) - 1
    while row < last:
        end = min(last, max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1))
        yield row, end
        row = end


def _null_mask(column: pa.Array) -> np.ndarray:
    return column.is_null().to_numpy(zero_copy_only=False)


def _lists(bounds: np.ndarray, values: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32), mask=np.append(null, False)) if null.any() else pa.array(bounds.astype(np.int32)), pa.array(values))


def encode(docs: DataFrame, vocab_path: str, text: str = "text", keep: list[str] | None = None, check: bool = False) -> DataFrame:
    """The columns ``keep`` (default: all but the text) with ``ids``, ``starts`` (byte offset of each token) and
    ``n_tokens``; with ``check`` also ``same``: whether decoding the ids gives the text back."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    names = [fresh_name(docs.select(*keep), n) for n in ("ids", "starts", "n_tokens", *(["same"] if check else []))]
    path = os.path.abspath(vocab_path) if os.path.exists(vocab_path) else vocab_path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for b in batches:
            column = b.column(len(keep))
            for first, last in _pieces(column):
                part = column[first:last]
                null = _null_mask(part)
                bounds, ids, starts = encode_column(part, vocab)
                out = [_lists(bounds, ids, null), _lists(bounds, starts, null), pa.array(np.diff(bounds).astype(np.int32), mask=null)]
                if check:
                    out.append(pa.array(decode_column(bounds, ids, vocab).to_numpy(zero_copy_only=False) == part.cast(pa.large_string()).fill_null("").to_numpy(zero_copy_only=False), mask=null))
                yield pa.RecordBatch.from_arrays([*(b.column(i)[first:last] for i in range(len(keep))), *out], names=[*keep, *names])

    kinds = ["array<int>", "array<int>", "int", "boolean"]
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))
    return docs.select(*keep, F.col(text)).mapInArrow(run, StructType([docs.schema[c] for c in keep] + schema.fields))


def decode(tokens: DataFrame, vocab_path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``tokens`` with the text of ``ids``."""
    name = fresh_name(tokens, out)

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab = vocabulary(vocab_path)
        for s in batches:
            lists = [np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in s]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            found = decode_column(bounds, np.concatenate(lists) if lists else np.zeros(0, np.int64), vocab).to_pylist()
            yield pd.Series([None if x is None else t for x, t in zip(s, found)], dtype=object)

    return tokens.withColumn(name, texts(ids))
