"""Packs of neighbouring documents along a space-filling curve.

A document's words are hashed to 2**16 buckets (weight 1 + ln count, unit length) and the
vector is projected to four dimensions by a fixed random matrix; the four numbers, quantised to
12 bits, give a Hilbert index.  Documents are laid end to end in the order of (index, id), each
with an end mark, and the line is cut every ``capacity`` tokens, so that a pack holds neighbours
and only the last one is not full.  A token is a word as the tokeniser of ``vectortext`` finds it.

The text is read once and never shuffled: what moves is (id, index, length).  The running total
has two levels over ranges of equal size, so no task sees the whole order, however the documents crowd.

Defined cases: ids of any type that can be ordered; a NULL or empty text is at the origin of the projection and takes one token, its
end mark; documents at the same place are ordered by id (NULL first); rows that repeat an id
and a text follow each other; a document longer than a pack continues in the next ones, with its offset;
an empty table gives no packs; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termgraph.llm.hilbert import hilbert_index, running_total
from termgraph.llm.vectortext import chunks, distinct_pairs, segment_sum, words

BUCKET_BITS = 16
DIMS, BITS = 4, 12
CAPACITY = 4096


@lru_cache(maxsize=1)
def _matrix() -> np.ndarray:
    return np.random.default_rng(20).standard_normal((1 << BUCKET_BITS, DIMS)).astype(np.float32)


def curve_and_length(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(Hilbert index, tokens with the end mark) of each text."""
    places, lengths = np.zeros(len(column), np.int64), np.ones(len(column), np.int64)
    for first, last, raw, offsets in chunks(column):
        n = last - first
        h, owner, _ = words(raw, offsets)
        lengths[first:last] += np.bincount(owner, minlength=n)
        doc, bucket, count = distinct_pairs(owner, h >> np.uint64(64 - BUCKET_BITS), BUCKET_BITS)
        weight = (1 + np.log(count)).astype(np.float32)
        point = segment_sum(_matrix()[bucket] * weight[:, None], doc, n)
        norm = np.sqrt(np.maximum(segment_sum(weight * weight, doc, n), 1))
        cell = np.clip((point / norm[:, None] + 3) / 6 * (1 << BITS), 0, (1 << BITS) - 1)
        places[first:last] = hilbert_index(cell.astype(np.int64), BITS)
    return places, lengths


def places(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, curve, tokens) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                curve, tokens = curve_and_length(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(curve), pa.array(tokens)], names=["id", "curve", "tokens"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, curve long, tokens long")


def pack(docs: DataFrame, capacity: int = CAPACITY, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(pack_id, doc_ids, offsets, lengths, n_tokens): a row a pack, its pieces in order; ``offsets`` are
    the tokens of the document that earlier packs hold."""
    one = places(docs, text, id).groupBy("curve", "id").agg(F.collect_list("tokens").alias("each"), F.sum("tokens").alias("tokens"))
    line = running_total(one, "curve", "id", "tokens", "start")
    # rows that repeat an id at one place are laid one after the other
    each = line.select("id", "start", F.posexplode(F.array_sort("each")).alias("nth", "length"), "each").select(
        "id", "length", (F.col("start") + F.aggregate(F.slice(F.array_sort("each"), 1, F.col("nth")), F.lit(0).cast("long"), lambda a, x: a + x)).alias("start")
    )
    div = lambda c: F.floor(c / F.lit(capacity)).cast("long")
    parts = each.withColumn("pack_id", F.explode(F.sequence(div(F.col("start")), div(F.col("start") + F.col("length") - 1))))
    begin = F.greatest(F.col("start"), F.col("pack_id") * capacity)
    end = F.least(F.col("start") + F.col("length"), (F.col("pack_id") + 1) * capacity)
    pieces = parts.select("pack_id", F.struct(begin.alias("at"), F.col("id"), (begin - F.col("start")).alias("offset"), (end - begin).alias("length")).alias("piece"))
    packs = pieces.groupBy("pack_id").agg(F.array_sort(F.collect_list("piece")).alias("p"))
    return packs.select("pack_id", F.col("p.id").alias("doc_ids"), F.col("p.offset").alias("offsets"), F.col("p.length").alias("lengths"), F.aggregate("p.length", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_tokens"))
