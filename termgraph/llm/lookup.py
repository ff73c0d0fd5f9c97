"""Joining rows with a table that has one row a key, when a key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20


def table_bytes(table: DataFrame) -> int:
    """About the bytes of a small table, from above: those of its rows as JSON."""
    return table.agg(F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("b")).first().b or 0


def lookup(rows: DataFrame, table: DataFrame, sizes: DataFrame, on: list[str], spread: str, how: str = "left", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` with the columns of their key's row in ``table``.

    A table of more than ``broadcast_bytes`` isn't broadcast but joined by a shuffle.  There a key with over a thousandth of the
    rows (``sizes`` has n for each key; at most a thousand keys are such) is salted by ``spread``, so that none of its
    parts is larger than that share."""
    if table_bytes(table) <= broadcast_bytes:
        return rows.join(F.broadcast(table), on, how)
    total = sizes.agg(F.sum("n").alias("n")).first().n
    big = sizes.where(F.col("n") * 1000 > total).select(*on, F.ceil(F.col("n") * 1000 / total).cast("int").alias("_salts"))
    one = F.coalesce("_salts", F.lit(1))
    salted = rows.join(F.broadcast(big), on, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), one).cast("int")).drop("_salts")
    copies = table.join(F.broadcast(big), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_salts")
    return salted.join(copies.hint("shuffle_hash"), [*on, "_salt"], how).drop("_salt")
