"""Exact dedup by two passes of Bloom filtering.

Pass 1 fills a filter with two bits a cell, "seen" and "seen twice", from one
64-bit hash a text.  The filter is cut into segments by the hash, so that all cells of a hash are in
one segment; every task sends its distinct hashes (8 bytes a document), not its texts, and a segment is filled
and tested where its hashes meet.  A text that occurs twice has marked each of its cells twice, so it is always
found; about 0.5 % of the others are found with them.  Pass 2 is a filter of those possibly repeated hashes alone: it is
broadcast and every row is tested against it once.  A row that it clears passes straight through without a shuffle; the others
are grouped by the text itself, so that the result is exact.

The table is read twice, whatever its size.  The second filter takes 2 to 4 bytes a repeated hash and never more than
``max_filter_bytes``: beyond that it lets more rows through to the grouping, which costs time but changes nothing.

Defined cases: ids of any type that can be ordered; a NULL text is no copy of anything and stays; empty texts are
equal to one another; of equal texts the row with the smallest ``id`` stays
(NULL ids last), then the one that hashes lowest over its other columns; rows that
repeat entirely leave one; an empty table gives an empty table; other columns,
whatever their names, are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termgraph.llm.vectortext import mix, runs
from termgraph.storage import fresh_name, materialise

SEGMENT_BITS = 20  #: cells of one segment of a filter, as a power of two
PROBES = 3
CELLS_PER_ROW = 16
MAX_FILTER_BYTES = 512 << 20
_CELL = np.uint64((1 << SEGMENT_BITS) - 1)


def filter_bits(rows: int, cells_per_row: int = CELLS_PER_ROW) -> int:
    """log2 of the cells for so many rows, one segment at least."""
    return max(SEGMENT_BITS, (max(rows, 1) * cells_per_row - 1).bit_length())


def segment_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The segment of each hash: its top bits."""
    if bits == SEGMENT_BITS:
        return np.zeros(len(hashes), np.int64)
    return (hashes >> np.uint64(64 - (bits - SEGMENT_BITS))).astype(np.int64)


def cells_of(hashes: np.ndarray) -> np.ndarray:
    """(rows, PROBES) cells of each hash within its segment."""
    h = mix(hashes + np.uint64(0x9E3779B97F4A7C15))
    return np.stack([(h >> np.uint64(SEGMENT_BITS * k)) & _CELL for k in range(PROBES)], axis=1)


def sent(hashes: DataFrame, bits: int) -> DataFrame:
    """(segment, once, again): each task's distinct hashes by segment, those that it has once and those that it has more often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [mix(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) for b in batches if b.num_rows]
        if not parts:
            return
        h = np.sort(np.concatenate(parts))
        at = runs(h)
        h, many = h[at[:-1]], np.diff(at) > 1
        cut = runs(segment_of(h, bits))
        pick = lambda which: pa.array([h[a:b][which[a:b]].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(segment_of(h[cut[:-1]], bits)), pick(~many), pick(many)], names=["segment", "once", "again"])

    return hashes.mapInArrow(run, "segment long, once binary, again binary")


def repeated(hashes: DataFrame, bits: int) -> DataFrame:
    """(segment, hashes): the distinct (mixed) hashes whose cells were all seen twice."""

    def test(own: pd.DataFrame) -> pd.DataFrame:
        once, again = (np.frombuffer(b"".join(own[c]), np.uint64) for c in ("once", "again"))
        every = np.concatenate([once, again, again])
        seen = np.bincount(cells_of(every).ravel().astype(np.int64), minlength=1 << SEGMENT_BITS)
        twice = (seen > 1)[cells_of(every).astype(np.int64)].all(axis=1)
        return pd.DataFrame({"segment": own["segment"].iloc[:1], "hashes": [np.unique(every[twice]).tobytes()]})

    return sent(hashes, bits).groupBy("segment").applyInPandas(test, "segment long, hashes binary")


def second_filter(found: DataFrame, bits: int) -> np.ndarray:
    """The packed bits of the filter over the possibly repeated hashes: each row gives the segments that it marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.column(0).to_pylist():
                h = np.frombuffer(row, np.uint64)
                cut = runs(segment_of(h, bits))
                planes = []
                for x, y in zip(cut[:-1], cut[1:]):
                    plane = np.zeros(1 << SEGMENT_BITS, bool)
                    plane[cells_of(h[x:y]).astype(np.int64)] = True
                    planes.append(np.packbits(plane).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(segment_of(h[cut[:-1]], bits)), pa.array(planes, pa.binary())], names=["segment", "plane"])

    def unite(own: pd.DataFrame) -> pd.DataFrame:
        plane = np.zeros(1 << (SEGMENT_BITS - 3), np.uint8)
        for p in own["plane"]:
            plane |= np.frombuffer(p, np.uint8)
        return pd.DataFrame({"segment": own["segment"].iloc[:1], "plane": [plane.tobytes()]})

    planes = found.select("hashes").mapInArrow(run, "segment long, plane binary").groupBy("segment").applyInPandas(unite, "segment long, plane binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    width = 1 << (SEGMENT_BITS - 3)
    for row in materialise(planes, "second-filter").toLocalIterator():
        out[row.segment * width : (row.segment + 1) * width] = np.frombuffer(row.plane, np.uint8)
    return out


def passes(hashes: np.ndarray, packed: np.ndarray, bits: int) -> np.ndarray:
    """Which mixed hashes have all their cells set."""
    cells = cells_of(hashes) + (segment_of(hashes, bits).astype(np.uint64) << np.uint64(SEGMENT_BITS))[:, None]
    return ((packed[cells >> np.uint64(3)] >> (7 - (cells & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1)


def exact_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id", max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """``docs`` without the later copies of equal texts."""
    spark = docs.sparkSession
    hashed = fresh_name(docs, "hash")
    hashes = docs.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias(hashed))
    found = materialise(repeated(hashes, filter_bits(docs.count())), "repeated-hashes")
    again = (found.agg(F.sum(F.octet_length("hashes")).alias("b")).first().b or 0) // 8
    bits = min(filter_bits(again), max(SEGMENT_BITS, (max_filter_bytes * 8).bit_length() - 1))
    shared = spark.sparkContext.broadcast(second_filter(found, bits))

    @F.pandas_udf("boolean")
    def maybe_repeated(h: pd.Series) -> pd.Series:
        return pd.Series(passes(mix(h.to_numpy().view(np.uint64)), shared.value, bits))

    work = docs.withColumn(hashed, F.xxhash64(text))  # some number for NULL, which is asked for beside it
    possible = maybe_repeated(hashed) & F.col(text).isNotNull()
    rest = [c for c in docs.columns if c != text]
    rank = F.struct(F.col(id).isNull(), F.col(id), F.xxhash64(*rest))
    groups = work.where(possible).groupBy(hashed, text).agg(F.min_by(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)]), rank).alias("kept"))
    copies = groups.select(*[F.col(text) if c == text else F.col(f"kept.c{rest.index(c)}").alias(c) for c in docs.columns], hashed)
    return work.where(~possible).unionByName(copies).select(*docs.columns)


SQL = """
SELECT doc_id, text, lang, source, n_chars
FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS place FROM documents)
WHERE place = 1 OR text IS NULL
"""
