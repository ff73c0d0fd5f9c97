"""Structured Streaming forms: citations with a carried tail, co-occurrence counts, growing class tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from termgraph.operators.citations import ARTICLE, CARRY, OTHER_SCOPE

def _files(spark: SparkSession, where: str):
    """(Hadoop file system, path) of a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


REFERENCES = "doc_id string, grp string, ref string, seq long, at long"


def citation_references(chunks: DataFrame, pattern: str = ARTICLE, mask: str | None = OTHER_SCOPE, idle: str | None = None) -> DataFrame:
    """New references (doc_id, grp, ref, seq, at) of a stream of chunks (doc_id, law, text, seq).

    The state of a document is its tail of ``CARRY`` characters and the references seen; chunks of one trigger are put in the
    order of ``seq``.  ``idle`` (say ``1 hour``) forgets a document that has had no chunk for so long."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tail, seen = state.get if state.exists else ("", "")
        known = set(filter(None, seen.split("\x01")))
        find, hide = re.compile(pattern), re.compile(mask) if mask else None
        out = []
        for law, text, seq in pd.concat(list(frames)).sort_values("seq")[["law", "text", "seq"]].itertuples(index=False):
            law, text = law or "", text or ""
            whole = tail + text
            if hide:
                whole = hide.sub(lambda m: " " * len(m.group()), whole)
            for m in find.finditer(whole):
                mark = f"{law}\x02{m.group()}"
                if m.end() > len(tail) and mark not in known:
                    known.add(mark)
                    out.append((key[0], law, m.group(), seq, m.start() - len(tail)))
            tail = text[-CARRY:] or tail
        state.update((tail, "\x01".join(sorted(known))))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=["doc_id", "grp", "ref", "seq", "at"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    rows = chunks.select(F.col("doc_id").cast("string").alias("doc_id"), "law", "text", F.col("seq").cast("long").alias("seq"))
    return rows.groupBy("doc_id").applyInPandasWithState(run, REFERENCES, "tail string, seen string", "append", timeout)


class CountStore:
    """Counts kept as Parquet, one folder a batch, so that a batch that is run again replaces itself.

    ``fold`` writes the counts of a batch; ``total`` adds them up.  ``compact`` puts all batches in one folder when they are many."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], value: str = "n"):
        self.spark, self.path, self.keys, self.value = spark, path.rstrip("/"), keys, value

    def fold(self, counts: DataFrame, batch: int) -> None:
        counts.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def _parts(self) -> tuple[int, list[str]]:
        """(last batch that a sum covers or -1, folders to read): the newest finished sum and the batches after it."""
        fs, path = _files(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = max([int(n[4:]) for n in names if n.startswith("sum-") and fs.exists(path.suffix(f"/{n}/_SUCCESS"))], default=-1)
        later = [n for n in names if n.startswith("batch=") and int(n[6:]) > done]
        return done, [f"{self.path}/{n}" for n in ([f"sum-{done}"] if done >= 0 else []) + later]

    def compact(self, upto: int) -> None:
        """Fold the batches up to ``upto`` (none of which will be run again) into one sum.  The sum counts from the moment it is
        finished, instead of what it covers; only then are those folders removed, so a loss at any point changes no total."""
        done, parts = self._parts()
        covered = [p for p in parts if "/sum-" in p or int(p.rsplit("=", 1)[1]) <= upto]
        if upto > done and len(covered) > 1:
            self._sum(covered).write.mode("overwrite").parquet(f"{self.path}/sum-{upto}")
        fs, path = _files(self.spark, self.path)
        keep = {p.rsplit("/", 1)[1] for p in self._parts()[1]}
        for s in fs.listStatus(path):
            if s.getPath().getName() not in keep:
                fs.delete(s.getPath(), True)

    def _sum(self, parts: list[str]) -> DataFrame:
        return self.spark.read.parquet(*parts).groupBy(*self.keys).agg(F.sum(self.value).alias(self.value))

    def total(self) -> DataFrame:
        return self._sum(self._parts()[1])


def cooccurrence_sink(spark: SparkSession, path: str, max_entities: int = 60):
    """A ``foreachBatch`` function over mentions (chunk_id, key), and the function that gives (kept mentions' pair counts, key counts, chunks).

    All mentions of a chunk must come in one trigger; feed it a stream deduplicated by chunk within its watermark."""
    from termgraph.operators import cooccur

    pairs, keys, chunks = CountStore(spark, f"{path}/pairs", ["a", "b"]), CountStore(spark, f"{path}/keys", ["key"]), CountStore(spark, f"{path}/chunks", ["one"])

    def sink(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        kept = cooccur.kept_mentions(batch.where("key IS NOT NULL"), max_entities)
        everything = batch.agg(F.count_distinct("chunk_id").alias("n"))
        pairs.fold(cooccur.edges(kept, everything, min_pair_df=1, lift_k=0.0), number)
        keys.fold(kept.groupBy("key").agg(F.count(F.lit(1)).alias("n")), number)
        chunks.fold(everything.select(F.lit(1).alias("one"), "n"), number)
        batch.unpersist()

    return sink, lambda: (pairs.total(), keys.total(), chunks.total())


def edges_from_counts(pairs: DataFrame, keys: DataFrame, chunks: DataFrame, min_pair_df: int = 3, lift_k: float = 2.0) -> DataFrame:
    """The edges that a batch run over all chunks would give."""
    df = lambda c: keys.select(F.col("key").alias(c), F.col("n").alias(f"df_{c}"))
    j = pairs.where(F.col("n") >= min_pair_df).join(df("a"), "a").join(df("b"), "b").crossJoin(F.broadcast(chunks.select(F.col("n").alias("_all"))))
    return j.where(F.col("n") * F.col("_all") > F.lit(lift_k) * F.col("df_a") * F.col("df_b")).select("a", "b", "n")


def class_sink(spark: SparkSession, path: str):
    """A ``foreachBatch`` function over class mentions (name, chunk_id), and the function that gives the classes so far."""
    from termgraph.operators import nouns

    def sink(batch: DataFrame, number: int) -> None:
        nouns.accumulate_classes(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    def classes() -> DataFrame:
        all_ = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
        return nouns.accumulate_classes(all_.select("name", F.explode_outer("source_chunks").alias("chunk_id")))

    return sink, classes
