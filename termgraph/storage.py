"""Where intermediate tables live between the jobs of one operator.

A table that several later plans read is written once to the folder that every
executor can reach (``spark.checkpoint.dir``) and read back as Parquet.  Losing
an executor then costs a re-read, never a result.  The tables of a driver process lie in one folder, which it
removes when it ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; one of our own only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="termgraph-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


_RUN = uuid.uuid4().hex
_written: set[str] = set()


def table_path(spark: SparkSession, label: str) -> str:
    """A new path among this process's tables."""
    own = f"{shared_dir(spark)}/tables/{_RUN}"
    if not _written:
        atexit.register(discard, spark)
    _written.add(own)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession) -> None:
    """Remove every table that this process has written; nothing that was read from them can be read again."""
    for own in list(_written):
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(own)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the JVM has gone before: the folder's name tells that it is left over
            pass
        _written.discard(own)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back (lineage cut)."""
    spark = df.sparkSession
    path = table_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
