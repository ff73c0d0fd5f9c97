"""Writers of graphs and dictionaries as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(lines: DataFrame, path: str, column: str = "line", order: list[str] | None = None) -> None:
    """One line a row; with ``order`` the files, read by name, are in that order (range partitions, no single task)."""
    out = lines.repartitionByRange(*order).sortWithinPartitions(*order) if order else lines
    out.select(column).write.text(path)


def synonym_lines(dictionary: DataFrame) -> DataFrame:
    """(line): ``surface<TAB>rep1 rep2`` with the representatives in order."""
    return dictionary.select(F.concat_ws("\t", "surface", F.array_join(F.array_sort("reps"), " ")).alias("line"))
