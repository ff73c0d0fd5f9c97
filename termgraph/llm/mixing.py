"""Language-model scoring by online logistic context mixing, in bits per byte.

Halves.  The rows are parted in two by a hash of all their columns; a document is scored with the counts of the half that it isn't in, so
that it isn't known from itself.  A copy under another id is in the other half as often as not, and is then known.

Predictors.  For each order k in ``ORDERS`` the k bytes before a byte, hashed to 60 bits, name a block of 15 nodes that
predict the bits of its upper half, and, with that half, another block for the lower one; a node predicts by the log-odds of its bit in the
half of the corpus.  The counts are gathered over every document: each task counts the (block, half byte) pairs that occur in
its part and sends them once, by pieces of the hash; a piece's counts add up to its nodes' log-odds.  What is gathered grows with the corpus and is
written to the shared folder, a row a piece.

Table.  Scoring holds the blocks in one table with a check byte for each (a context that isn't there predicts nothing).  The table
takes at least two places a block, so it grows with the number of contexts met, up to ``max_bits`` (2**22 blocks of 16 bytes,
64 MB: what a worker can hold; a block is read at one place).  From there on it takes the contexts that were seen most often.  A block may stand at its place or at the
one beside it; of three that meet, those seen more often stay.

Mixing.  The log-odds x_k of the predictors are combined as s = sum_k w[g, bit, k] x_k + d[bit, round(2 s')] + u[hash of three bytes and node],
where the gate g is the class of the byte before (letter or digit, blank, other ASCII, other), d refines the mix s' by its own
height and u is a predictor that learns from this document alone.  All three begin alike for each document and follow the gradient of the coding
cost online: after every 16 bytes of the first 64, every 64 up to 512, every 128 from there on.  The score is the sum of
-log2 p over all bits, over the whole text.

A document's score depends on its text and the corpus' counts alone: documents are only put side by side (``LANES``
at a time) to be computed at once.

Defined cases: ids of any type; a NULL or empty text has 0 bytes, 0 bits and NULL bits per byte; repeated rows get equal scores (and count
twice in their half); where the other half has no text, only the document itself is learnt from; an empty table gives no rows; columns named as the new ones stay and the new ones get
leading underscores; columns of map type play no part in the halves.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from termgraph.llm.vectortext import buffers, runs
from termgraph.storage import fresh_name, materialise

ORDERS = (1, 2, 3, 4)
K = len(ORDERS)
LANES = 64
STEPS = ((64, 16), (512, 64), (1 << 62, 128))  #: up to which place updates follow how many bytes
GATES = 4
BINS = 33
OWN_BITS = 11  #: cells of a document's own predictor
START = 0.3
RATE = 0.002
REFINE = 0.05
LEARN = 0.1
SCALE = 16.0  #: log-odds are kept in sixteenths, from -7.9 to 7.9
PRIOR = 0.05
MAX_BITS = 22
_COUNT_BYTES = 1 << 20
_MERGE = 1 << 22
_PIECE_BYTES = 64 << 20  #: text a piece, and at least a counting task: the more a task reads, the more it adds up before it sends
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.arange(1, 17, dtype=np.uint64) * _ODD
_SALTS = np.arange(1, 2 * K + 1, dtype=np.uint64) * np.uint64(0xFF51AFD7ED558CCD)
_LOW = np.uint64(15)

_BIT = (np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1
_SIGN = (2 * _BIT - 1).astype(np.float32)
_NODE = np.stack([(np.arange(256) | 256) >> (8 - b) for b in range(8)], axis=1) * 73
_PATHS = np.stack([(half | 16) >> (4 - b) for half in (np.arange(256) >> 4, np.arange(256) & 15) for b in range(4)], axis=1)  # a byte's nodes in its two blocks
_GATE = np.full(256, 2, np.int64)
_GATE[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 0
_GATE[[9, 10, 13, 32]] = 1
_GATE[128:] = 3


def histories(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The last bytes before each byte, as many as the longest order, the nearest lowest; 0 before a text's start."""
    h = np.zeros(len(raw), np.uint64)
    for k in range(1, max(ORDERS) + 1):
        before = np.zeros(len(raw), np.uint64)
        before[k:] = raw[:-k]
        for j in range(k):  # of these the k-th byte before belongs to another text
            before[starts[sizes > j] + j] = 0
        h |= before << np.uint64(8 * (k - 1))
    return h


def upper_keys(h: np.ndarray, half: np.ndarray, order: int) -> np.ndarray:
    """Hash of the block that predicts the upper half of the byte after each history."""
    own = h & np.uint64((1 << 8 * ORDERS[order]) - 1)
    own += np.uint64(1)
    own *= _ODD
    own += _SALTS[2 * order + half]
    own ^= own >> np.uint64(32)
    own *= np.uint64(0xD6E8FEB86659FD93)
    own ^= own >> np.uint64(32)
    own *= np.uint64(0xD6E8FEB86659FD93)
    return own


def lower_keys(upper: np.ndarray, nibble: np.ndarray) -> np.ndarray:
    """Hash of the block that predicts the lower half, once the upper one is known."""
    x = upper | _LOW
    x += _STEP[nibble]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def summed(cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order, with the sums of their counts."""
    order = np.argsort(cells, kind="stable")
    cells, counts = cells[order], counts[order]
    at = runs(cells)[:-1]
    return (cells[at], np.add.reduceat(counts, at)) if len(at) else (cells, counts)


def cells_of(raw: np.ndarray, offsets: np.ndarray, half: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts of the (block, half byte) pairs of some texts: a cell is a block's hash with the half byte as its last four bits."""
    h, side = histories(raw, offsets[:-1], np.diff(offsets)), np.repeat(half, np.diff(offsets))
    upper, lower = (raw >> 4).astype(np.uint64), (raw & 15).astype(np.uint64)
    out = []
    for k in range(K):
        up = upper_keys(h, side, k)
        for key, nibble in ((up, upper), (lower_keys(up, raw >> 4), lower)):
            cells = (key & ~_LOW) | nibble
            cells.sort()
            at = runs(cells)
            out.append((cells[at[:-1]], np.diff(at)))
    return out


def corpus_counts(texts: DataFrame, piece_bits: int) -> DataFrame:
    """(piece, cells, counts) from (text, half): each task's counts, by pieces of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for b in batches:
            data, offsets = buffers(b.column(0))
            half = b.column(1).to_numpy(zero_copy_only=False)
            row = 0
            while row < len(offsets) - 1:
                end = min(len(offsets) - 1, max(row + 1, int(np.searchsorted(offsets, offsets[row] + _COUNT_BYTES, "right")) - 1))
                held += cells_of(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], half[row:end])
                row = end
                size = sum(len(c) for c, _ in held)
                if size > _MERGE:
                    held = [summed(*(np.concatenate(x) for x in zip(*held)))]
                    if len(held[0][0]) > _MERGE // 2:  # distinct ones alone fill the room: send them
                        yield _sent(*held.pop(), piece_bits)
        if held:
            yield _sent(*summed(*(np.concatenate(x) for x in zip(*held))), piece_bits)

    return texts.mapInArrow(run, "piece int, cells binary, counts binary")


def _sent(cells: np.ndarray, counts: np.ndarray, piece_bits: int) -> pa.RecordBatch:
    piece = cells >> np.uint64(64 - piece_bits)
    at = runs(piece)
    few = counts.astype(np.uint32)
    blobs = lambda a: pa.array([a[x:y].tobytes() for x, y in zip(at[:-1], at[1:])], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(piece[at[:-1]].astype(np.int32)), blobs(cells), blobs(few)], names=["piece", "cells", "counts"])


def log_odds(counts: np.ndarray) -> np.ndarray:
    """(blocks, 16) int8 log-odds of the nodes (1 to 15) from (blocks, 16) counts of half bytes."""
    out = np.zeros(counts.shape, np.int8)
    level = counts.astype(np.float32)
    for depth in range(3, -1, -1):
        pairs = level.reshape(len(level), -1, 2)
        odds = np.log((pairs[:, :, 1] + np.float32(PRIOR)) / (pairs[:, :, 0] + np.float32(PRIOR)))
        out[:, 1 << depth : 2 << depth] = np.rint(np.clip(odds * SCALE, -127, 127))
        level = pairs.sum(axis=2)
    return out


def tag_of(keys: np.ndarray) -> np.ndarray:
    """A block's check byte."""
    return keys.view(np.int8)[1::8]  # bits 8 to 15


def blocks_of(cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, (n, 16) check byte and nodes, how often seen up to 255) of the blocks of some distinct cells in order."""
    block = cells >> np.uint64(4)
    at = runs(block)
    keys, nodes, seen = block[at[:-1]] << np.uint64(4), np.zeros((len(at) - 1, 16), np.int8), np.zeros(len(at) - 1, np.uint8)
    for a in range(0, len(keys), 1 << 16):
        z = min(a + (1 << 16), len(keys))
        own = slice(at[a], at[z])
        dense = np.zeros((z - a, 16), np.float32)
        dense[np.repeat(np.arange(z - a), np.diff(at[a : z + 1])), (cells[own] & _LOW).astype(np.int64)] = counts[own]
        nodes[a:z] = log_odds(dense)
        seen[a:z] = np.minimum(dense.sum(axis=1), 255)
    nodes[:, 0] = tag_of(keys)
    return keys, nodes, seen


def blocks(docs: DataFrame, text: str, half: Column, piece_bits: int) -> DataFrame:
    """(piece, keys, nodes, seen, many): the blocks of all of ``docs``; many[i] of them were seen i times (255: or more often)."""

    def merge(own: pd.DataFrame) -> pd.DataFrame:
        cells = np.concatenate([np.frombuffer(c, np.uint64) for c in own["cells"]])
        counts = np.concatenate([np.frombuffer(c, np.uint32) for c in own["counts"]])
        keys, nodes, seen = blocks_of(*summed(cells, counts.astype(np.int64)))
        return pd.DataFrame({"piece": own["piece"].iloc[:1], "keys": [keys.tobytes()], "nodes": [nodes.tobytes()], "seen": [seen.tobytes()], "many": [np.bincount(seen, minlength=256).tolist()]})

    texts = docs.select(text, half.alias("_half"))
    tasks = max(1 << piece_bits, 2 * docs.sparkSession.sparkContext.defaultParallelism)
    sent = corpus_counts(texts.coalesce(tasks), piece_bits)
    return sent.groupBy("piece").applyInPandas(merge, "piece int, keys binary, nodes binary, seen binary, many array<long>")


def table_of(found: DataFrame, max_bits: int = MAX_BITS, room: int = 2) -> tuple[np.ndarray, int]:
    """(flat table of 2**bits blocks, bits) from written ``blocks``: ``room`` places a block, as far as ``max_bits`` allow."""
    many = np.zeros(256, np.int64)
    for r in found.select(F.posexplode("many").alias("n", "c")).groupBy("n").agg(F.sum("c").alias("c")).collect():
        many[r.n] = r.c
    most = np.cumsum(many[::-1])[::-1]  # blocks seen so often or more
    least = int(np.argmax(most <= 1 << (max_bits - 1))) if (most <= 1 << (max_bits - 1)).any() else 255
    bits = min(max_bits, max(10, int(room * max(1, most[least]) - 1).bit_length()))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece, keys, nodes, seen in zip(*(b.column(i).to_pylist() for i in range(4))):
                often = np.frombuffer(seen, np.uint8)
                pick = often >= least
                cut = [np.frombuffer(keys, np.uint64)[pick].tobytes(), np.frombuffer(nodes, np.int8).reshape(-1, 16)[pick].tobytes(), often[pick].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), *(pa.array([c], pa.binary()) for c in cut)], names=["piece", "keys", "nodes", "seen"])

    table, count, owner = np.zeros((1 << bits, 16), np.int8), np.zeros(1 << bits, np.uint8), np.zeros(1 << bits, np.uint64)
    rows = found.select("piece", "keys", "nodes", "seen").mapInArrow(chosen, "piece int, keys binary, nodes binary, seen binary").orderBy("piece")
    for r in rows.toLocalIterator():
        keys, nodes, seen = np.frombuffer(r["keys"], np.uint64), np.frombuffer(r.nodes, np.int8).reshape(-1, 16), np.frombuffer(r.seen, np.uint8)
        order = np.argsort(seen, kind="stable")  # what was seen most often is written last
        keys, nodes, seen = keys[order], nodes[order], seen[order]
        for beside in (0, 1):
            place = (keys >> np.uint64(64 - bits)).astype(np.int64) ^ beside
            wins = count[place] == 0 if beside else seen > count[place]
            table[place[wins]], count[place[wins]], owner[place[wins]] = nodes[wins], seen[wins], keys[wins]
            lost = owner[place] != keys
            keys, nodes, seen = keys[lost], nodes[lost], seen[lost]
    return table.ravel(), bits


def bits_of(raw: np.ndarray, offsets: np.ndarray, half: np.ndarray, table: Table) -> np.ndarray:
    """Bits of each text, by the counts of the half that it isn't in."""
    sizes = np.diff(offsets)
    out = np.zeros(len(sizes))
    order = np.argsort(sizes, kind="stable")[::-1]
    h, other = histories(raw, offsets[:-1], sizes), 1 - half
    room = _Room(LANES * max(w for _, w in STEPS))
    for g in range(0, len(order), LANES):
        own = order[g : g + LANES]
        own = own[sizes[own] > 0]
        if len(own):
            out[own] = _lanes(raw, h, other[own], offsets[own], sizes[own], table, room)
    return out


def steps(longest: int) -> Iterator[tuple[int, int]]:
    """(first byte, bytes) of the stretches between updates."""
    at = 0
    while at < longest:
        width = next(n for end, n in STEPS if at < end)
        yield at, min(width, longest - at)
        at += width


class Table:
    """The table, read a block at a time: check byte and nodes of a block are 16 bytes that are fetched together."""

    def __init__(self, flat: np.ndarray, bits: int):
        self.shift, self.blocks = np.uint64(64 - bits), np.require(flat.view(np.complex128), requirements="A")

    def look(self, keys: np.ndarray, out: np.ndarray) -> None:
        """The blocks of ``keys`` into ``out`` (n, complex); zeros where the context isn't in the table."""
        block, tag, check = (keys >> self.shift).view(np.int64), tag_of(keys), out.view(np.int8)[::16]
        np.take(self.blocks, block, out=out, mode="clip")
        away = np.flatnonzero(check != tag)  # at the place beside, or nowhere
        beside = self.blocks[block[away] ^ 1]
        beside[beside.view(np.int8)[::16] != tag[away]] = 0
        out[away] = beside


class _Room:
    """Arrays that every step of every group of lanes reuses: fresh ones of this size would be mapped anew each time."""

    def __init__(self, n: int):
        f = np.float32
        self.x, self.nodes, self.keys, self.blocks = np.empty((K, n, 8), f), np.empty((n, 8), np.int8), np.empty((n, 2), np.uint64), np.empty(2 * n, np.complex128)
        self.first = np.arange(0, 32 * n, 16).reshape(n, 2, 1)
        self.s, self.sign, self.u, self.more, self.error = (np.empty((n, 8), f) for _ in range(5))
        self.bins, self.cell, self.path = (np.empty((n, 8), np.int64) for _ in range(3))


def _lanes(raw: np.ndarray, h: np.ndarray, half: np.ndarray, starts: np.ndarray, sizes: np.ndarray, table: Table, room: _Room) -> np.ndarray:
    """Bits of some texts, longest first, one stretch of each at a time."""
    n = len(starts)
    weight = np.full((K, n * GATES, 8), START / SCALE, np.float32)  # of log-odds in sixteenths
    refine, own_odds = np.zeros(n * 8 * BINS, np.float32), np.zeros(n << OWN_BITS, np.float32)
    total = np.zeros(n)
    lane_bins = ((np.arange(8) * BINS)[None] + (np.arange(n) * 8 * BINS)[:, None])[:, None]
    lane_cells = (np.arange(n) << OWN_BITS)[:, None]
    gates = np.arange(GATES)[:, None]
    for at, width in steps(int(sizes[0])):
        live = int(np.searchsorted(-sizes, -at, "left"))
        m = live * width
        s, sign, u, more, error, bins, cell, path, nodes, keys = (a[:m] for a in (room.s, room.sign, room.u, room.more, room.error, room.bins, room.cell, room.path, room.nodes, room.keys))
        blocks = room.blocks[: 2 * m]
        step = np.arange(at, at + width)
        inside = step < sizes[:live, None]
        place = (np.minimum(step, sizes[:live, None] - 1) + starts[:live, None]).ravel()
        byte, past, side = raw[place].astype(np.int64), h[place], np.repeat(half[:live], width)
        np.take(_PATHS, byte, axis=0, out=path, mode="clip")
        wide = path.reshape(m, 2, 4)
        wide += room.first[:m]
        upper = byte >> 4
        gate = _GATE[(past & np.uint64(255)).astype(np.int64)].reshape(live, width)
        own = (np.arange(live)[:, None] * GATES + gate).ravel()
        for k in range(K):  # predictors one by one, each in an array without gaps
            x = room.x[k, :m]
            keys[:, 0] = upper_keys(past, side, k)
            keys[:, 1] = lower_keys(keys[:, 0], upper)
            table.look(keys.ravel(), blocks)
            np.take(blocks.view(np.int8), path, out=nodes, mode="clip")
            np.copyto(x, nodes)
            np.take(weight[k], own, axis=0, out=more if k else s, mode="clip")
            if k:
                more *= x
                s += more
            else:
                s *= x
        np.clip(s, -8, 8, out=s)
        np.multiply(s, 2, out=more)
        more += np.float32(16.5)
        np.copyto(bins, more, casting="unsafe")
        wide = bins.reshape(live, width, 8)
        wide += lane_bins[:live]
        np.take(refine, bins, out=more, mode="clip")
        s += more
        np.take(_NODE, byte, axis=0, out=cell, mode="clip")
        cell ^= (((past & np.uint64(0xFFFFFF)) * np.uint64(0x9E3779B1)) >> np.uint64(9)).astype(np.int64)[:, None]
        cell &= (1 << OWN_BITS) - 1
        cells = cell.reshape(live, width * 8)
        cells += lane_cells[:live]
        np.take(own_odds, cell, out=more, mode="clip")
        s += more
        np.take(_SIGN, byte, axis=0, out=sign, mode="clip")
        s *= sign
        np.negative(s, out=s)
        np.exp(s, out=u)
        if not inside[:, -1].all():
            u *= inside.reshape(m, 1)  # a padded byte costs nothing and teaches nothing
        np.add(u, 1, out=s)
        np.divide(u, s, out=error)
        error *= sign
        parts = s.reshape(live, 2, width * 4)
        np.multiply(parts[:, 0], parts[:, 1], out=more.reshape(2, live, width * 4)[0])
        total[:live] += np.log2(more.reshape(2, live, width * 4)[0]).sum(axis=1, dtype=np.float64)
        refine += np.float32(REFINE) * np.bincount(bins.ravel(), weights=error.ravel(), minlength=len(refine)).astype(np.float32)
        for k in range(K):
            np.multiply(room.x[k, :m], error, out=more)
            one = (gate[:, None] == gates).astype(np.float32) if k == 0 else one
            weight[k, : live * GATES] += np.float32(RATE / SCALE**2) * np.matmul(one, more.reshape(live, width, 8)).reshape(live * GATES, 8)
        error *= np.float32(LEARN)
        np.add.at(own_odds, cell.ravel(), error.ravel())
    return total


def half_of(docs: DataFrame) -> Column:
    """0 or 1 for each row."""
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.xxhash64(*plain).bitwiseAND(1) if plain else F.lit(0).cast("long")


_ready: dict[str, Table] = {}  #: the worker's table, by model


def _laid_out(model: str, shared, bits: int) -> Table:
    if model not in _ready:
        _ready.clear()
        _ready[model] = Table(shared.value, bits)
    return _ready[model]


def score(docs: DataFrame, text: str = "text", keep: list[str] | None = None, max_bits: int = MAX_BITS, room: int = 2) -> DataFrame:
    """The columns ``keep`` (default: all but the text) with ``n_bytes``, ``bits`` and ``bits_per_byte``."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    size = docs.agg(F.sum(F.octet_length(text)).alias("b")).first().b or 0
    half = half_of(docs)
    table, bits = table_of(materialise(blocks(docs, text, half, max(3, (size // _PIECE_BYTES).bit_length())), "mixing-blocks"), max_bits, room)
    shared, model = docs.sparkSession.sparkContext.broadcast(table), uuid.uuid4().hex
    names = [fresh_name(docs.select(*keep), n) for n in ("n_bytes", "bits", "bits_per_byte")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _laid_out(model, shared, bits)
        for b in batches:
            data, offsets = buffers(b.column(len(keep)))
            half = b.column(len(keep) + 1).to_numpy(zero_copy_only=False)
            row, last, found = 0, len(offsets) - 1, np.zeros(len(offsets) - 1)
            while row < last:
                end = min(last, max(row + 1, int(np.searchsorted(offsets, offsets[row] + _COUNT_BYTES, "right")) - 1))
                found[row:end] = bits_of(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], half[row:end], own)
                row = end
            each = np.diff(offsets)
            with np.errstate(invalid="ignore", divide="ignore"):
                rate = np.round(found / each, 4)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(each), pa.array(np.round(found, 1)), pa.array(rate, mask=each == 0)], names=[*keep, *names])

    new = [StructField(names[0], LongType()), StructField(names[1], DoubleType()), StructField(names[2], DoubleType())]
    return docs.select(*keep, F.col(text), half.alias(fresh_name(docs, "half"))).mapInArrow(run, StructType([docs.schema[c] for c in keep] + new))
