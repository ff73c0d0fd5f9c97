"""Hilbert curve indices, and running totals along the curve without a global sort."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termgraph.storage import materialise

RANGE_ROWS = 500_000  #: rows of one range of the running total


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Curve position of each row of ``points`` (n, dims), whole numbers under 2**bits; dims*bits <= 62.

    Skilling's transform, all rows at once."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, dims):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros(len(points), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    index = np.zeros(len(points), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            index = (index << 1) | (((x[i] ^ turn) >> b) & 1)
    return index


def running_total(rows: DataFrame, curve: str, id: str, weight: str, out: str) -> DataFrame:
    """``rows`` (one for each curve position and id) with ``out``, the weight of all rows before it (NULL ids first).

    Two levels: the rows are written in ranges of about ``RANGE_ROWS`` rows each, whatever their places; a range's
    total is one number, and a window goes over one range.  Only narrow rows are shuffled."""
    held = materialise(rows, "curve-rows")
    parts = max(1, -(-held.count() // RANGE_ROWS))
    ranged = materialise(held.repartitionByRange(parts, F.col(curve).asc(), F.col(id).asc_nulls_first()).withColumn("_range", F.spark_partition_id()), "curve-ranges")
    totals = ranged.groupBy("_range").agg(F.sum(weight).alias("_sum"))
    before = totals.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(weight).over(Window.partitionBy("_range").orderBy(F.col(curve).asc(), F.col(id).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_inside", inside).join(F.broadcast(before), "_range").withColumn(out, F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before")
