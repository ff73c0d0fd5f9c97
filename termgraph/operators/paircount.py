"""Counts of pairs over sets of whole numbers, and a walk over ranked pairs: what co-occurrence does at size.

A set is sent, from the first number that lies in a range on, to that range's group; a group forms and sorts its pairs piece by piece
in arrays.  What is shuffled are parts of sets, several pairs to a number, and no pair that is too rare leaves its group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termgraph.storage import materialise

PIECE = 8_000_000  #: pairs that a group holds at once
GROUP_PAIRS = 64_000_000  #: pairs of a group, about
SLICE = 100_000  #: numbers that a sender cuts up at once
WALK_ROWS = 4_000_000  #: ranked pairs that one step of a walk reads


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (one for each key) with ``id``, their place from 0 in the order of ``key``; no task sorts all keys."""
    nth = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = materialise(rows.repartitionByRange(key).sortWithinPartitions(key).withColumns({"_part": F.spark_partition_id(), "_nth": nth}), "numbered")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn("id", (F.col("_start") + F.col("_nth")).cast("int")).drop("_part", "_nth", "_start")


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Every place of the ranges, one range after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def _sender(bounds, mask=None):
    """Cuts sets (column ``k``, ascending) into (group, seg, ids): for each part of a set its length and how many of its numbers are the group's own."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge, open_ = bounds.value, mask.value if mask is not None else None
        for batch in batches:
            k = batch.column("k")
            ids, sizes = k.flatten().to_numpy(zero_copy_only=False), np.diff(k.offsets.to_numpy())
            if open_ is not None:
                keep = open_[ids]
                total = np.concatenate([[0], np.cumsum(keep)])
                ends = np.cumsum(sizes)
                sizes, ids = total[ends] - total[ends - sizes], ids[keep]
            ends = np.cumsum(sizes)
            cut = 0
            while cut < len(sizes):
                base = int(ends[cut - 1]) if cut else 0
                to = max(cut + 1, int(np.searchsorted(ends, base + SLICE, "right")))
                x, n = ids[base : int(ends[to - 1])], sizes[cut:to]
                cut = to
                if not len(x):
                    continue
                doc = np.repeat(np.arange(len(n)), n)
                end = np.repeat(np.cumsum(n), n)
                group = np.searchsorted(edge, x, "right") - 1
                first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (group[1:] != group[:-1])]))
                own = np.diff(np.concatenate([first, [len(x)]]))
                length, g = end[first] - first, group[first]
                some = length > 1
                first, own, length, g = first[some], own[some], length[some], g[some]
                if not len(g):
                    continue
                by = np.argsort(g, kind="stable")
                first, own, length, g = first[by], own[by], length[by], g[by]
                flat = x[_ranges(first, length)].astype(np.int32)
                at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                upto, filled = np.concatenate([at[1:], [len(g)]]), np.concatenate([[0], np.cumsum(length)])
                seg = np.stack([length, own], axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(g[at].astype(np.int32)),
                        pa.array([seg[i:j].tobytes() for i, j in zip(at, upto)], pa.binary()),
                        pa.array([flat[filled[i] : filled[j]].tobytes() for i, j in zip(at, upto)], pa.binary()),
                    ],
                    names=["g", "seg", "ids"],
                )

    return send


def _counted(seg: np.ndarray, ids: np.ndarray, width: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, n), n of ``least`` or more, of a group's parts of sets; at most about ``PIECE`` pairs are held at once."""
    length, own = seg[:, 0].astype(np.int64), seg[:, 1].astype(np.int64)
    start = np.cumsum(length) - length
    place = _ranges(start, own)
    others = np.repeat(start + length, own) - place - 1
    owner = ids[place]
    by = np.argsort(owner, kind="stable")
    by = by[others[by] > 0]
    place, others, owner = place[by], others[by], owner[by]
    if not len(owner):
        return
    run = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    run = np.concatenate([run, [len(owner)]])
    often = np.diff(run) >= least  # a pair is no more frequent than its ends
    pairs = np.concatenate([[0], np.cumsum(others)])
    i = 0
    while i < len(run) - 1:
        if not often[i]:
            i += 1
            continue
        j = i + 1
        while j < len(run) - 1 and often[j] and pairs[run[j + 1]] - pairs[run[i]] <= PIECE:
            j += 1
        lo, hi = run[i], run[j]
        if pairs[hi] - pairs[lo] <= PIECE:
            key = np.repeat(owner[lo:hi].astype(np.int64) * width, others[lo:hi]) + ids[_ranges(place[lo:hi] + 1, others[lo:hi])]
            key.sort()
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.diff(np.concatenate([new, [len(key)]]))
            some = n >= least
            key, n = key[new[some]], n[some]
            yield key // width, key % width, n
        else:  # one number of very many sets
            total = np.zeros(width, np.int64)
            while lo < hi:
                to = max(lo + 1, int(np.searchsorted(pairs, pairs[lo] + PIECE, "right")) - 1)
                to = min(to, hi)
                total += np.bincount(ids[_ranges(place[lo:to] + 1, others[lo:to])], minlength=width)
                lo = to
            b = np.flatnonzero(total >= least)
            yield np.full(len(b), owner[run[i]], np.int64), b, total[b]
        i = j


def total_pairs(sets: DataFrame) -> int:
    n = F.size("k").cast("long")
    return sets.agg(F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0))).first()[0]


def counts(sets: DataFrame, df: np.ndarray, n_sets: int, pairs: float, least: int, lift_k: float, most: int | None = None, wanted: np.ndarray | None = None) -> DataFrame:
    """(a, b, n), a < b: pairs of numbers that lie in ``least`` or more of the ``sets`` (column ``k``, ascending), fewer than ``most``, whose lift
    is above ``lift_k``.  ``df``: each number's sets; ``pairs``: how many pairs the sets have, about; ``wanted``: numbers that count."""
    spark = sets.sparkSession
    width = max(1, len(df))
    groups = int(min(max(spark.sparkContext.defaultParallelism * 2, 24, -(-pairs // GROUP_PAIRS)), width))
    mass = np.cumsum(df if wanted is None else np.where(wanted, df, 0), dtype=np.float64)
    bounds = np.unique(np.concatenate([[0], np.searchsorted(mass, mass[-1] * np.arange(1, groups) / groups) if len(mass) else []]).astype(np.int64))
    send = _sender(spark.sparkContext.broadcast(bounds), spark.sparkContext.broadcast(wanted) if wanted is not None else None)
    sent, each = sets.select("k").mapInArrow(send, "g int, seg binary, ids binary"), spark.sparkContext.broadcast(df)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        many = each.value.astype(np.float64)
        seg = np.frombuffer(b"".join(pdf["seg"]), np.int32).reshape(-1, 2)
        found = [(np.zeros(0, np.int64),) * 3]
        for a, b, n in _counted(seg, np.frombuffer(b"".join(pdf["ids"]), np.int32), width, least):
            good = n.astype(np.float64) * n_sets > lift_k * (many[a] * many[b])
            if most is not None:
                good &= n < most
            found.append((a[good], b[good], n[good]))
        a, b, n = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"a": a.astype(np.int32), "b": b.astype(np.int32), "n": n})

    return sent.repartition(len(bounds), "g").groupBy("g").applyInPandas(count, "a int, b int, n long")


def walk(ranked: DataFrame, room: np.ndarray) -> tuple[DataFrame | None, np.ndarray]:
    """The pairs (a, b, n) that a walk down (n descending, a, b) takes which skips a pair with an end that has no ``room``, and the room left.

    The pairs are written in ranges of that order, of about ``WALK_ROWS`` each; one task at a time goes over one range, for only pairs whose
    ends both have room when it begins."""
    spark, rows = ranked.sparkSession, ranked.count()
    if not rows:
        return None, room
    parts = -(-rows // WALK_ROWS)
    if parts > 1:
        ranked = materialise(ranked.repartitionByRange(parts, F.desc("n"), "a", "b").withColumn("_part", F.spark_partition_id()), "walk-ranges")
    taken = None
    for part in range(parts):
        left = spark.sparkContext.broadcast(room)

        def undecided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                free = left.value > 0
                yield x.filter(pa.array(free[x.column("a").to_numpy()] & free[x.column("b").to_numpy()]))

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, b, n = ([np.zeros(0, np.int64)] for _ in range(3))
            for x in batches:
                for to, c in ((a, "a"), (b, "b"), (n, "n")):
                    to.append(x.column(c).to_numpy())
            a, b, n = np.concatenate(a), np.concatenate(b), np.concatenate(n)
            by = np.lexsort((b, a, -n))
            now, kept, at, step = left.value.copy(), [], 0, 4096
            while at < len(by):
                some = by[at : at + step]
                at, step = at + step, min(step * 2, 1 << 18)
                some = some[(now[a[some]] > 0) & (now[b[some]] > 0)]
                have: dict[int, int] = {}
                ends = np.unique(np.concatenate([a[some], b[some]]))
                have.update(zip(ends.tolist(), now[ends].tolist()))
                for i, x, y in zip(some.tolist(), a[some].tolist(), b[some].tolist()):
                    if have[x] and have[y]:
                        have[x] -= 1
                        have[y] -= 1
                        kept.append(i)
                now[ends] = np.fromiter(map(have.__getitem__, ends.tolist()), now.dtype, len(ends))
            kept = np.array(kept, np.int64)
            for lo in range(0, len(kept), 100_000):
                i = kept[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(a[i].astype(np.int32)), pa.array(b[i].astype(np.int32)), pa.array(n[i]), pa.nulls(len(i), pa.binary())], names=["a", "b", "n", "room"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([zlib.compress(now.tobytes(), 1)], pa.binary())], names=["a", "b", "n", "room"])

        one = ranked.where(F.col("_part") == part) if parts > 1 else ranked
        done = materialise(one.select("a", "b", "n").mapInArrow(undecided, "a int, b int, n long").coalesce(1).mapInArrow(go, "a int, b int, n long, room binary"), "walk-taken")
        room = np.frombuffer(zlib.decompress(done.where("room IS NOT NULL").first()["room"]), room.dtype)
        new = done.where("room IS NULL").select("a", "b", "n")
        taken = new if taken is None else taken.unionByName(new)
        left.unpersist()
    return taken, room
