"""SimHash near-dedup with pivot distance tables.

Fingerprint: 256 bits (four 64-bit words), the majority, over the distinct words of the
text, of each word's random bits.  Two documents are near copies when their fingerprints differ in at
most ``max_distance`` bits (44: about one distinct word in eight changed; unrelated texts differ in 77 or more).

1. Equal fingerprints are put together; the rest works on distinct fingerprints.
2. Candidates: the bits are cut into 15 parts (23 for few fingerprints).  Of two fingerprints within ``max_distance`` some part
   differs in at most two bits (one bit), and it with any number of the parts after it in less than three (two) bits a part, so each
   fingerprint looks, part by part, at those whose part is its own with at most so many bits flipped, and a pair that differs in more
   than 11 of the 64 bits from that part on goes.  Buckets are compared a layer at a time: the first rows of all of them, the second
   ones, ...  No near copy is lost by any of it.
3. Pivot tables: each word's Hamming distances to 64 reference fingerprints are precomputed.  By the triangle
   inequality no distance is less than the largest difference of two such coordinates, and of two near copies some word
   differs in at most ``max_distance // 4`` bits; a pair for which every word's largest coordinate difference is above that is
   discarded.  No near copy is lost by it.
4. Survivors are verified on all 256 bits.
5. The fingerprints are put into blocks by their hash, and every pair of blocks is searched by one task; it sends the edges of
   a spanning star of its verified groups, not all pairs, and connected components over all tasks give the groups.  Parts that more than ``SMALL`` squared
   pairs share grow their groups one by one: what is in a group is compared with what is in none, so that near copies cost a pass
   over them, not a pass a row.  There is no cap on parts, partners or group size: the groups are those of all pairs.

The work grows with the square of the number of distinct fingerprints (under 2 % of the pairs are looked at), what is shuffled with
the number of blocks.

Defined cases: ids of any type that can be ordered; a text without a word (NULL, empty, punctuation) has no fingerprint and is copy of nothing; of a group
the smallest id stays; ``id`` names a document: rows that repeat an id are one document and leave one row, that
of the smallest hash over all columns; rows with a NULL id stay; an empty table gives an empty table; other columns
are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termgraph.llm.components import connected, local_roots
from termgraph.llm.vectortext import chunks, distinct_pairs, runs, segment_sum, words
from termgraph.storage import fresh_name, materialise

WORDS = 4
BITS = 64 * WORDS
MAX_DISTANCE = 44
PIVOTS = 64
PART_BITS = 18
BLOCKS = 8  #: of distinct fingerprints, so that all cores have pairs of blocks; more where a block would have over MOST_ROWS
LEAST_ROWS, MOST_ROWS = 1 << 12, 1 << 19
FEW = 1 << 21  #: pairs that are looked at without parts
MANY = 1 << 13  #: fingerprints from which parts are longer
FEATURE_BITS = 16
_F = [f"f{i}" for i in range(WORDS)]
_BLOCK = 1 << 18
_STEP = 1 << 14  #: pairs at a time, so that they stay in a core's cache
LAYERS = 8  #: rows of a bucket that are compared a layer at a time
LEAST_LAYER = 1 << 12
SMALL = 256  #: two buckets of more than SMALL**2 pairs grow groups


@lru_cache(maxsize=1)
def _bits() -> np.ndarray:
    packed = np.random.default_rng(11).integers(0, 256, (1 << FEATURE_BITS, BITS // 8), dtype=np.uint8)
    return np.unpackbits(packed, axis=1)


@lru_cache(maxsize=1)
def _pivots() -> np.ndarray:
    return np.random.default_rng(12).integers(0, 1 << 64, (WORDS, PIVOTS), dtype=np.uint64)


def fingerprints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """((n, WORDS) fingerprints, which texts have one)."""
    out, has = np.zeros((len(column), WORDS), np.uint64), np.zeros(len(column), bool)
    for first, last, raw, offsets in chunks(column):
        h, owner, _ = words(raw, offsets)
        doc, feature, _ = distinct_pairs(owner, h >> np.uint64(64 - FEATURE_BITS), FEATURE_BITS)
        n = last - first
        total = np.zeros((n, BITS), np.int32)
        for a in range(0, len(doc), 1 << 13):
            own, bits = doc[a : a + (1 << 13)], _bits()[feature[a : a + (1 << 13)]]
            place = np.arange(len(own))
            cut = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (place % 255 == 0))  # sums of at most 255 bits fit a byte
            sums = np.add.reduceat(bits, cut, axis=0, dtype=np.uint8)
            total[own[0] : own[-1] + 1] += segment_sum(sums.astype(np.int32), own[cut] - own[0], own[-1] + 1 - own[0])
        kinds = np.bincount(doc, minlength=n)
        out[first:last] = np.packbits(total * 2 > kinds[:, None], axis=1).view(">u8").astype(np.uint64)
        has[first:last] = np.bincount(owner, minlength=n) > 0
    return out, has


def popcount_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int32)


def pivot_table(prints: np.ndarray) -> np.ndarray:
    """(n, WORDS, PIVOTS): Hamming distance of each word to each of its reference fingerprints."""
    return np.bitwise_count(prints[:, :, None] ^ _pivots()[None]).astype(np.int8)


def close_pairs(a: np.ndarray, b: np.ndarray, prints: np.ndarray, table: np.ndarray, max_distance: int) -> np.ndarray:
    """Which pairs (rows a, b) are within ``max_distance``: pivot filter word by word, then all bits."""
    near = np.zeros(len(a), bool)
    left = np.arange(len(a))
    for w in range(WORDS):
        gap = np.abs(table[a[left], w] - table[b[left], w]).max(axis=1)
        passed = gap <= max_distance // WORDS
        near[left[passed]] = True
        left = left[~passed]
    found = np.flatnonzero(near)
    near[found] = popcount_distance(prints[a[found]], prints[b[found]]) <= max_distance
    return near


def parts(max_distance: int, most: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the parts of a fingerprint: of two within ``max_distance``, some part differs in at most ``most`` bits."""
    n = -(-(max_distance + 1) // (most + 1))  # were every part to differ in most + 1 or more, all of them would in more than max_distance
    cut = [BITS * i // n for i in range(n + 1)]
    return [(x, min(y - x, PART_BITS)) for x, y in zip(cut, cut[1:])]


def part_keys(prints: np.ndarray, first: int, bits: int) -> np.ndarray:
    word, shift = divmod(first, 64)
    key = prints[:, word] >> np.uint64(shift)
    if shift + bits > 64:
        key |= prints[:, word + 1] << np.uint64(64 - shift)
    return (key & np.uint64((1 << bits) - 1)).astype(np.int64)


def flips(bits: int, most: int) -> list[int]:
    """Every way in which at most ``most`` of so many bits differ."""
    return [sum(1 << b for b in own) for n in range(most + 1) for own in combinations(range(bits), n)]


def window(prints: np.ndarray, first: int) -> np.ndarray:
    """The 64 bits from bit ``first`` on; after the last bit comes the first one."""
    word, shift = divmod(first, 64)
    out = prints[:, word] >> np.uint64(shift)
    if shift:
        out |= prints[:, (word + 1) % WORDS] << np.uint64(64 - shift)
    return out


def window_limit(cut: list[tuple[int, int]], i: int, most: int) -> int:
    """How many of the 64 bits from part i on may differ: for some part of two near copies, it and any number of parts after it differ in
    less than ``most + 1`` bits a part (else runs of parts that differ in more would go round the ring and add up to more than the limit)."""
    n, bits = 0, 0
    while bits < 64:
        bits += cut[(i + n) % len(cut)][1]
        n += 1
    return (most + 1) * n - 1


class _Side:
    """Fingerprints in the order of their keys.  The first ones of every bucket, the second ones, ... are layers: arrays by key, so that
    a flip compares whole layers; the rows beyond the layers are ``deep``."""

    def __init__(self, rows: np.ndarray, key: np.ndarray, view: np.ndarray, bits: int):
        order = np.argsort(key, kind="stable")
        self.rows, self.key, self.view = rows[order], key[order], view[order]
        self.size = np.bincount(key, minlength=1 << bits)
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        depth = np.arange(len(key)) - self.start[self.key]
        self.keys, self.views, self.all = [], [], []
        for d in range(LAYERS):
            at = np.flatnonzero(depth == d)
            if len(at) < LEAST_LAYER:
                break
            self.keys.append(self.key[at])
            self.views.append(self.view[at])
            self.all.append(np.zeros(1 << bits, np.uint64))
            self.all[d][self.keys[d]] = self.views[d]
        self.deep = np.flatnonzero(depth >= len(self.keys))


class _Layers:
    """Arrays that every comparison of layers reuses."""

    def __init__(self):
        self.at, self.apart, self.count, self.near = np.empty(_STEP, np.int64), np.empty(_STEP, np.uint64), np.empty(_STEP, np.uint8), np.empty(_STEP, bool)

    def pairs(self, x: _Side, y: _Side, flip: int, limit: int, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in the layers of both sides that differ in at most ``limit`` bits of the window; each pair once where both are one side."""
        for i in range(len(x.keys)):
            for j in range(len(y.keys)):
                if own and not flip and i >= j:
                    continue
                swap = len(y.keys[j]) < len(x.keys[i])
                keys, views, other = (y.keys[j], y.views[j], x.all[i]) if swap else (x.keys[i], x.views[i], y.all[j])
                for s in range(0, len(keys), _STEP):
                    key = keys[s : s + _STEP]
                    n = len(key)
                    at, apart, count, near = self.at[:n], self.apart[:n], self.count[:n], self.near[:n]
                    np.bitwise_xor(key, flip, out=at)
                    np.take(other, at, out=apart, mode="clip")
                    np.bitwise_xor(apart, views[s : s + _STEP], out=apart)
                    np.bitwise_count(apart, out=count)
                    np.less_equal(count, limit, out=near)
                    if near.any():
                        hit = np.flatnonzero(near)
                        v, w = (at[hit], key[hit]) if swap else (key[hit], at[hit])
                        real = (x.size[v] > i) & (y.size[w] > j)  # else one of them is a gap in its layer
                        if own and flip:
                            real &= v < w
                        yield x.start[v[real]] + i, y.start[w[real]] + j


def _ranges(x: _Side, y: _Side, rows: np.ndarray, low: np.ndarray, many: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of ``rows`` and of each one's ``many`` partners from ``low`` on, if they differ in at most ``limit`` bits of the window."""
    upto = np.cumsum(many)
    t = 0
    while t < len(rows):
        z = max(t + 1, int(np.searchsorted(upto, (upto[t - 1] if t else 0) + _STEP, "right")))
        before = upto[t:z] - many[t:z]
        a, b = np.repeat(rows[t:z], many[t:z]), np.arange(before[0], upto[z - 1]) + np.repeat(low[t:z] - before, many[t:z])
        near = np.flatnonzero(np.bitwise_count(x.view[a] ^ y.view[b]) <= limit)
        yield a[near], b[near]
        t = z


def links(prints: np.ndarray, first: int, max_distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join all near copies among the fingerprints or, where there are others after the ``first`` ones, between
    those and the others."""
    n, own = len(prints), first == len(prints)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    root = np.arange(n)
    others = n - (0 if own else first)
    if first * others <= FEW:
        low = 0 if own else first
        for s in range(0, first, max(1, _BLOCK // others)):
            a, b = np.nonzero(np.bitwise_count(prints[s : min(first, s + max(1, _BLOCK // others)), None, :2] ^ prints[None, low:, :2]).sum(axis=2) <= max_distance)
            a, b = a + s, b + low
            once = a < b
            root = _add(a[once], b[once], prints, root, found, max_distance)
        return found
    most = 1 if others < MANY else 2  # fewer ways, or fewer fingerprints each
    cut, layers = parts(max_distance, most), _Layers()
    for i, (at, bits) in enumerate(cut):
        new: list[tuple[np.ndarray, np.ndarray]] = []
        key, view, limit = part_keys(prints, at, bits), window(prints, at), window_limit(cut, i, most)
        x = _Side(np.arange(first), key[:first], view[:first], bits)
        y = x if own else _Side(np.arange(first, n), key[first:], view[first:], bits)
        full = int(x.size.max()) * int(y.size.max()) > SMALL * SMALL
        if full:
            one = [_joined(root[s.rows], s.key, bits, none) for s, none in ((x, -1), (y, -2))]
        for flip in flips(bits, most):
            new += [(x.rows[a], y.rows[b]) for a, b in layers.pairs(x, y, flip, limit, own)]
            for this, that in ((x, y),) if own else ((x, y), (y, x)):  # the deep ones with all of the other side, then its deep ones with the layers
                rows, top = this.deep, len(this.keys)
                partner = this.key[rows] ^ flip
                many = that.size[partner] if this is x else np.minimum(that.size[partner], len(that.keys))
                held = np.flatnonzero(many)
                rows, partner, many = rows[held], partner[held], many[held]
                if full and len(rows):
                    mine, theirs = one if this is x else one[::-1]
                    open_ = mine[this.key[rows]] != theirs[partner]  # else all of both is joined already
                    rows, partner, many = rows[open_], partner[open_], many[open_]
                    dense = this.size[this.key[rows]] * that.size[partner] > SMALL * SMALL
                    for v in np.unique(this.key[rows[dense]]):
                        both = np.union1d(*(s.rows[s.start[k] : s.start[k + 1]] for s, k in ((this, v), (that, v ^ flip))))
                        if (root[both] != root[both[0]]).any():
                            near = grown(np.arange(len(both)), prints[both], pivot_table(prints[both]), max_distance)
                            found += [(both[a], both[b]) for a, b in near]  # chains of near copies, verified
                    if dense.any() and found:
                        root = _roots(n, found)
                        one = [_joined(root[s.rows], s.key, bits, none) for s, none in ((x, -1), (y, -2))]
                    rows, partner, many = rows[~dense], partner[~dense], many[~dense]
                for a, b in _ranges(this, that, rows, that.start[partner], many, limit):
                    if own:  # two deep ones meet twice, and each meets itself
                        once = (a < b) | (b - that.start[that.key[b]] < top)
                        a, b = a[once], b[once]
                    new.append((this.rows[a], that.rows[b]))
        a, b = (np.concatenate([f[k] for f in new]) if new else np.zeros(0, np.int64) for k in (0, 1))
        root = _add(a, b, prints, root, found, max_distance)
    return found


def _add(a: np.ndarray, b: np.ndarray, prints: np.ndarray, root: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], max_distance: int) -> np.ndarray:
    """The roots after those of the pairs that are near copies went to ``found``."""
    open_ = root[a] != root[b]  # the rest is joined already
    a, b = a[open_], b[open_]
    near = [np.zeros(0, bool)] + [_verified(a[s : s + _BLOCK // 4], b[s : s + _BLOCK // 4], prints, max_distance) for s in range(0, len(a), _BLOCK // 4)]
    near = np.concatenate(near)
    if near.any():
        found.append((a[near], b[near]))
        root = _roots(len(prints), found)
    return root


def _joined(root: np.ndarray, kept: np.ndarray, bits: int, none: int) -> np.ndarray:
    """For each key the one root of its rows, or ``none``; rows come sorted by key."""
    out, at = np.full(1 << bits, none), runs(kept)
    low, high = np.minimum.reduceat(root, at[:-1]), np.maximum.reduceat(root, at[:-1])
    out[kept[at[:-1]]] = np.where(low == high, low, none)
    return out


def _roots(n: int, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return local_roots(n, *(np.concatenate([f[i] for f in found]) for i in (0, 1)))


def _verified(a: np.ndarray, b: np.ndarray, prints: np.ndarray, max_distance: int) -> np.ndarray:
    rows, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    return close_pairs(place[: len(a)], place[len(a) :], prints[rows], pivot_table(prints[rows]), max_distance)


def _bucket_edges(max_distance: int):
    """Edges of the spanning stars of the near copies of each key, from (key, id, f0..f3[, side]); rows come sorted by key.  Where a
    key has two sides, links are sought between them alone."""

    def edges_of(ids: pa.Array, prints: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(side, kind="stable")
        first = int((side == side[order[0]]).sum())
        a, root = _star(len(order), links(prints[order], first, max_distance))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(order[a])), ids.take(pa.array(order[root]))], names=["a", "b"])

    def of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        prints = np.stack([np.concatenate([b.column(2 + w).to_numpy(zero_copy_only=False) for b in held]) for w in range(WORDS)], axis=1).view(np.uint64)
        side = np.concatenate([b.column(2 + WORDS).to_numpy(zero_copy_only=False) if b.num_columns > 2 + WORDS else np.zeros(b.num_rows, np.int32) for b in held])
        return edges_of(pa.concat_arrays([b.column(1) for b in held]), prints, side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False)
            at = runs(key)
            for x, y in zip(at[:-1], at[1:]):
                if held and key[x] != last:
                    yield of(held)
                    held = []
                last = key[x]
                held.append(b.slice(int(x), int(y - x)))
        if held:
            yield of(held)

    return run


def _star(n: int, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    root = _roots(n, found)
    a = np.flatnonzero(root != np.arange(n))
    return a, root[a]


def grown(rows: np.ndarray, prints: np.ndarray, table: np.ndarray, max_distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join the near copies among ``rows``: a group grows from its first row until nothing outside is near any of it."""
    found, left = [], rows
    while len(left):
        first, left, edge = left[0], left[1:], left[:1]
        while len(edge) and len(left):
            near = np.zeros(len(left), bool)
            step = max(1, _BLOCK // len(left))
            for s in range(0, len(edge), step):
                own = edge[s : s + step]
                rest = np.flatnonzero(~near)
                hit = close_pairs(np.repeat(own, len(rest)), np.tile(left[rest], len(own)), prints, table, max_distance)
                near[rest] |= hit.reshape(len(own), len(rest)).any(axis=0)
            edge, left = left[near], left[~near]
            found.append((np.full(len(edge), first), edge))
    return found


def fingerprint_table(docs: DataFrame, text: str, id: str) -> DataFrame:
    """(id, f0..f3) of every row with a word and an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                prints, has = fingerprints(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(prints[:, w].view(np.int64), mask=~has) for w in range(WORDS))], names=["id", *_F])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).where("id IS NOT NULL").mapInArrow(run, f"id {kind}, " + ", ".join(f"{f} long" for f in _F))


def groups(docs: DataFrame, text: str = "text", id: str = "doc_id", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(id, group_id, rows): each document, the smallest id of its group, and the rows that bear its id."""
    table = materialise(fingerprint_table(docs, text, id), "fingerprints")
    one = table.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.min(F.when(F.col("f0").isNotNull(), F.struct(*_F))).alias("f")).select("id", "rows", "f.*")
    own = materialise(one.withColumn("rep", F.when(F.col("f0").isNull(), F.col("id")).otherwise(F.min("id").over(Window.partitionBy(*_F)))), "representatives")
    distinct = own.where("f0 IS NOT NULL AND id = rep").select("id", *_F)
    n = distinct.count()
    blocks = max(1, min(BLOCKS, n // LEAST_ROWS), -(-n // MOST_ROWS))
    block, other = F.pmod(F.xxhash64(*_F), F.lit(blocks)), F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    turns = F.transform(other, lambda j: F.struct((F.least(F.col("block"), j) * blocks + F.greatest(F.col("block"), j)).alias("key"), (F.col("block") > j).cast("int").alias("side")))
    kind = docs.schema[id].dataType.simpleString()
    spread = distinct.withColumn("block", block).select("id", *_F, F.explode(turns).alias("turn")).select("turn.key", "id", *_F, "turn.side")
    edges = spread.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_bucket_edges(max_distance), f"a {kind}, b {kind}")
    roots = connected(edges)
    return own.join(roots, own.rep == roots.node, "left").select("id", F.coalesce("root", "rep").alias("group_id"), "rows")


def near_groups(docs: DataFrame, text: str = "text", id: str = "doc_id", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, duplicates): each document that stays, with the ids of the near copies it stands for."""
    g = groups(docs, text, id, max_distance)
    return g.groupBy(F.col("group_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.when(F.col("id") != F.col("group_id"), F.col("id")))).alias("duplicates"))


def near_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` with one document of each group, columns as they were."""
    g = materialise(groups(docs, text, id, max_distance).where("id <> group_id OR rows > 1"), "near-copies")
    mark, key, place = fresh_name(docs, "copy"), fresh_name(docs, "copy_id"), fresh_name(docs, "copy_place")
    todo = g.select(F.col("id").alias(key), (F.col("id") != F.col("group_id")).alias(mark))
    seen = docs.join(todo, F.col(id) == F.col(key), "left").where(f"`{mark}` IS NULL OR NOT `{mark}`")
    if g.where("id = group_id").isEmpty():  # no id occurs twice
        return seen.select(*docs.columns)
    again = seen.where(F.col(mark).isNotNull()).withColumn(place, F.row_number().over(Window.partitionBy(id).orderBy(F.xxhash64(*docs.columns))))
    return seen.where(F.col(mark).isNull()).select(*docs.columns).unionByName(again.where(F.col(place) == 1).select(*docs.columns))
