"""Shards cut from a Hilbert curve over the documents' metadata.

Source, language, length and id are quantised to 12 bits each, in their own order: numbers by their distance from the
least one (length by its logarithm), strings by the six bytes that follow what all values begin with; a document's place
is the Hilbert index of the four.  Runs of ``target_bytes`` along the curve are the
shards, so that each shard spans a small box of every dimension, a box is a range of values, and a reader with a
condition on any of them opens few files (minimum and maximum are in the manifest).  A table of less than
``MIN_SHARDS`` such runs is cut into that many.

The cut is found on narrow rows (place, id, bytes).  What comes back to the driver is
the first key of each shard (some 24 bytes each), where there are at most ``MAX_SHARDS``; of more, rows get their shard by a join on (place, id).  Each text
is moved once, to its shard.

Defined cases: ids are numbers or strings; a NULL in a dimension has coordinate 0; a NULL or empty text weighs 0
bytes; documents at the same place are ordered by id (NULL first); rows that repeat an
id at the same place are not parted; a single distinct value has coordinate 0; an empty table
gives an empty table; columns already named ``curve`` or ``shard`` stay and the new
ones get leading underscores.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from termgraph.llm.hilbert import hilbert_index, running_total
from termgraph.storage import fresh_name, materialise

BITS = 12
DIMS = 4
TARGET_BYTES = 32 << 20
MAX_SHARDS = 4_000_000
MAX_TASKS = 200_000
MIN_SHARDS = 64


_TOP = (1 << BITS) - 1


def common_start(low: str | None, high: str | None) -> int:
    """How many characters all strings from ``low`` to ``high`` begin with."""
    return next((i for i, (a, b) in enumerate(zip(low or "", high or "")) if a != b), min(len(low or ""), len(high or "")))


def coordinate(c: str, low, high) -> Column:
    """0 to 2**BITS - 1 in the order of the column, whose least and greatest values are given."""
    if low is None:
        return F.lit(0)
    if isinstance(low, str):
        skip = common_start(low, high)
        first, last = (_prefix(x, skip) for x in (low, high))
        return F.coalesce(F.expr(f"CAST(({_sql_number(c, skip)} - {first}) * {_TOP} div {max(1, last - first)} AS INT)"), F.lit(0))
    return F.coalesce(F.expr(f"CAST((CAST(`{c}` AS DECIMAL(38,0)) - {int(low)}) * {_TOP} div {max(1, int(high) - int(low))} AS INT)"), F.lit(0))


def _prefix(x: str, skip: int) -> int:
    return int.from_bytes(x[skip:].encode()[:6].ljust(6, b"\0"), "big")


def _sql_number(c: str, skip: int) -> str:
    """Six bytes of a string after ``skip`` characters, as a number in the strings' order."""
    return f"CAST(conv(rpad(substring(hex(substring(`{c}`, {skip + 1})), 1, 12), 12, '0'), 16, 10) AS BIGINT)"


@F.pandas_udf(LongType())
def curve_place(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index(np.stack([a, b, c, d], axis=1), BITS))


def placed(docs: DataFrame, out: str, source: str = "source", lang: str = "lang", n_chars: str = "n_chars", id: str = "doc_id") -> DataFrame:
    """``docs`` with its place on the curve."""
    ends = docs.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate((source, lang, id)) for k, f in (("low", F.min), ("high", F.max))], F.max(n_chars).alias("longest")).first()
    size = F.floor(_TOP * F.log(F.greatest(F.col(n_chars), F.lit(0)) + F.lit(1.0)) / F.lit(float(np.log(1.0 + max(1, ends.longest or 1)))))
    a, b, d = (coordinate(c, ends[f"low{i}"], ends[f"high{i}"]) for i, c in enumerate((source, lang, id)))
    return docs.withColumn(out, curve_place(a, b, F.coalesce(size.cast("int"), F.lit(0)), d))


def run_bytes(docs: DataFrame, target_bytes: int = TARGET_BYTES, text: str = "text") -> int:
    """Bytes of a shard."""
    total = docs.agg(F.sum(F.octet_length(text)).alias("b")).first().b or 0
    return max(1, min(target_bytes, -(-total // MIN_SHARDS)))


def keyed(docs: DataFrame, run: int, text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", id: str = "doc_id") -> DataFrame:
    """(_curve, _i, shard and the manifest's figures) of each place and id."""
    narrow = placed(docs.select(F.col(source).alias("_s"), F.col(lang).alias("_l"), F.col(n_chars).alias("_n"), F.col(id).alias("_i"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("_b")), "_curve", "_s", "_l", "_n", "_i")
    keys = narrow.groupBy("_curve", "_i").agg(
        F.sum("_b").alias("_bytes"), F.count(F.lit(1)).alias("_docs"), *[f(c).alias(f"{p}_{k}") for k, c in (("source", "_s"), ("lang", "_l"), ("n_chars", "_n")) for p, f in (("min", F.min), ("max", F.max))]
    )
    return running_total(keys, "_curve", "_i", "_bytes", "_start").withColumn("shard", F.floor(F.col("_start") / run).cast("long"))


def manifest(keys: DataFrame) -> DataFrame:
    """A row a shard, from ``keyed``: first key, documents, bytes, and the least and greatest value of each dimension."""
    return keys.groupBy("shard").agg(
        F.min(F.struct("_curve", F.col("_i").isNotNull().alias("_has"), "_i")).alias("first"), F.sum("_docs").alias("docs"), F.sum("_bytes").alias("bytes"), F.min("_i").alias("min_doc_id"), F.max("_i").alias("max_doc_id"),
        *[f(f"{p}_{k}").alias(f"{p}_{k}") for k in ("source", "lang", "n_chars") for p, f in (("min", F.min), ("max", F.max))],
    )


def shard(docs: DataFrame, target_bytes: int = TARGET_BYTES, text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", id: str = "doc_id", max_shards: int = MAX_SHARDS) -> DataFrame:
    """``docs`` with ``curve`` and ``shard``, laid out so that a shard is in one partition, in curve order."""
    keys = materialise(keyed(docs, run_bytes(docs, target_bytes, text), text, source, lang, n_chars, id).select("_curve", "_i", "shard"), "shard-keys")
    n = (keys.agg(F.max("shard").alias("n")).first().n or 0) + 1
    curve_name, shard_name = fresh_name(docs, "curve"), fresh_name(docs, "shard")
    out = placed(docs, curve_name, source, lang, n_chars, id)
    if n > max_shards:
        key = keys.select(F.col("_curve").alias("_at"), F.col("_i").alias("_key"), F.col("shard").alias(shard_name))
        out = out.join(key, (F.col(curve_name) == F.col("_at")) & F.col(id).eqNullSafe(F.col("_key"))).select(*docs.columns, curve_name, shard_name)
    else:
        rows = keys.groupBy("shard").agg(F.min(F.struct("_curve", F.col("_i").isNotNull().alias("_has"), "_i")).alias("first")).collect()
        first = sorted((r.first["_curve"], r.first["_has"], r.first["_i"] if r.first["_has"] else 0, r.shard) for r in rows)
        shared = docs.sparkSession.sparkContext.broadcast((np.array([f[0] for f in first] or [0], np.int64), [f[1:3] for f in first], np.array([f[3] for f in first] or [0], np.int64)))

        @F.pandas_udf("long")
        def shard_of(curve: pd.Series, key: pd.Series) -> pd.Series:
            at, ids, names = shared.value
            c = curve.to_numpy(np.int64)
            low, high = np.searchsorted(at, c, "left"), np.searchsorted(at, c, "right")
            for i in np.flatnonzero(high > low):  # shards that begin at this very place
                k = key.iloc[i]
                high[i] = low[i] + bisect.bisect_right(ids[low[i] : high[i]], (False, 0) if k is None or k != k else (True, k))
            return pd.Series(names[np.maximum(high - 1, 0)])

        out = out.withColumn(shard_name, shard_of(curve_name, id))
    tasks = min(n, MAX_TASKS)  # a shard a task, or runs of them: hashing would put several in one by chance
    return out.repartitionById(tasks, F.floor(F.col(shard_name) * tasks / n).cast("int")).sortWithinPartitions(shard_name, curve_name, id)


def _sql_coordinate(c: str) -> str:
    """The coordinate of a string column, with the least and greatest values as lo_<c> and hi_<c>."""
    skip = f"len(list_filter(range(1, 1 + CAST(least(length(lo_{c}), length(hi_{c})) AS INT)), lambda i: left(lo_{c}, i) = left(hi_{c}, i)))"
    n = lambda x: f"CAST('0x' || rpad(left(hex(substr({x}, 1 + {skip})), 12), 12, '0') AS BIGINT)"
    return f"coalesce(({n(c)} - {n('lo_' + c)}) * 4095 // greatest(1, {n('hi_' + c)} - {n('lo_' + c)}), 0)"


SQL = f"""
WITH RECURSIVE stats AS (SELECT coalesce(min(doc_id), 0) AS low, coalesce(max(doc_id), 0) AS high, greatest(1, coalesce(max(n_chars), 1)) AS longest,
    min(source) AS lo_source, max(source) AS hi_source, min(lang) AS lo_lang, max(lang) AS hi_lang, greatest(1, least({TARGET_BYTES}, (coalesce(sum(strlen(text)), 0) + 63) // 64)) AS run FROM documents),
cells AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS bytes,
    CAST({_sql_coordinate("source")} AS BIGINT) AS a,
    CAST({_sql_coordinate("lang")} AS BIGINT) AS b,
    CAST(coalesce(floor(4095 * ln(greatest(n_chars, 0) + 1.0) / ln(1.0 + longest)), 0) AS BIGINT) AS c,
    CAST(coalesce((doc_id - low) * 4095 // greatest(1, high - low), 0) AS BIGINT) AS d
  FROM documents, stats),
turns(doc_id, bytes, q, axis, a, b, c, d) AS (
  SELECT doc_id, bytes, 2048, 0, a, b, c, d FROM cells
  UNION ALL
  SELECT doc_id, bytes, CASE WHEN axis = 3 THEN q // 2 ELSE q END, (axis + 1) % 4,
    CASE WHEN (x & q) <> 0 THEN xor(a, q - 1) ELSE xor(a, t) END,
    CASE WHEN axis = 1 AND (x & q) = 0 THEN xor(b, t) ELSE b END,
    CASE WHEN axis = 2 AND (x & q) = 0 THEN xor(c, t) ELSE c END,
    CASE WHEN axis = 3 AND (x & q) = 0 THEN xor(d, t) ELSE d END
  FROM (SELECT *, xor(a, x) & (q - 1) AS t FROM (SELECT *, CASE axis WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN c ELSE d END AS x FROM turns WHERE q > 1))),
gray AS (
  SELECT doc_id, bytes, a, xor(a, b) AS b, xor(xor(a, b), c) AS c, xor(xor(xor(a, b), c), d) AS d
  FROM turns WHERE q = 1 AND axis = 0),
flipped AS (
  SELECT doc_id, bytes, xor(a, t) AS a, xor(b, t) AS b, xor(c, t) AS c, xor(d, t) AS d
  FROM (SELECT *, {"xor(" * 10}{", ".join(["0"] + [f"CASE WHEN (d & {1 << k}) <> 0 THEN {(1 << k) - 1} ELSE 0 END)" for k in range(1, 11)])} AS t10 FROM gray) AS g,
    LATERAL (SELECT xor(CAST(t10 AS BIGINT), CASE WHEN (d & 2048) <> 0 THEN 2047 ELSE 0 END) AS t) AS l),
curved AS (
  SELECT doc_id, bytes, {" + ".join(f"((({v} >> {k}) & 1) << {4 * k + 3 - i})" for k in range(12) for i, v in enumerate("abcd"))} AS curve
  FROM flipped)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.curve, c.shard
FROM documents d JOIN (
  SELECT doc_id, curve, CAST((sum(bytes) OVER (ORDER BY curve, doc_id) - bytes) // run AS BIGINT) AS shard FROM curved, stats
) c USING (doc_id)
"""
