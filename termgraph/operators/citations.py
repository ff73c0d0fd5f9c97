"""Citations between documents: scoped references resolved to the documents they name."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termgraph.functions import text as T

ARTICLE = "제\\d+조(?:의\\d+)?"
OTHER_SCOPE = f"「[^」]{{1,80}}」\\s*(?:{ARTICLE})?|(?:같은|동)\\s*법(?:\\s*시행(?:령|규칙))?\\s*{ARTICLE}"
CARRY = 100
CITES = "cites"
NAMESPACE = "https://example.org/kg#"


def _c(name: Column | str | None) -> Column:
    return F.lit("") if name is None else F.coalesce(T.lit_or_col(name).cast("string"), F.lit(""))


def references(chunks: DataFrame, pattern: str = ARTICLE, mask: str | None = OTHER_SCOPE, doc: str = "doc_id", group: str | None = "law", text: str = "text", seq: str = "seq") -> DataFrame:
    """(doc_id, grp, ref, ord): the references of each document, in order of their first place.

    A reference may be split across two chunks: each chunk is read after the last ``CARRY`` characters of the nearest
    chunk before it that has a text, and matches that end inside those are the earlier chunk's.  Spans of ``mask``
    (other scopes) are blanked at equal length.  The offsets need a scan of each text, hence Arrow batches."""
    before = F.last(F.nullif(_c(text), F.lit("")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    rows = chunks.select(F.col(doc).alias("doc_id"), _c(group).alias("grp"), F.col(text).alias(text) if text != "text" else F.col("text"), F.col(seq).cast("long").alias("seq"))
    rows = rows.where("doc_id IS NOT NULL").withColumn("carry", F.right(F.coalesce(before, F.lit("")), F.lit(CARRY))).select("doc_id", "grp", "seq", "carry", _c(text).alias("raw"))
    kind = chunks.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, hide = re.compile(pattern), re.compile(mask) if mask else None
        for b in batches:
            out = []
            for d, g, s, carry, raw in b.itertuples(index=False):
                whole = carry + raw
                if hide:
                    whole = hide.sub(lambda m: " " * len(m.group()), whole)
                out += [(d, g, m.group(), s, m.start() - len(carry)) for m in find.finditer(whole) if m.end() > len(carry)]
            yield pd.DataFrame(out, columns=["doc_id", "grp", "ref", "seq", "at"])

    found = rows.mapInPandas(run, f"doc_id {kind}, grp string, ref string, seq long, at long")
    return found.groupBy("doc_id", "grp", "ref").agg(F.min(F.struct("seq", "at")).alias("ord"))


def whole_references(docs: DataFrame, pattern: str, doc: str = "doc_id", group: str | None = None, text: str = "text") -> DataFrame:
    """The same over whole documents with a pattern that needs no mask, on the JVM alone: (doc_id, grp, ref, ord)."""
    found = docs.select(F.col(doc).alias("doc_id"), _c(group).alias("grp"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("at", "ref"))
    return found.groupBy("doc_id", "grp", "ref").agg(F.min("at").alias("ord"))


def owners(docs: DataFrame, doc: str = "doc_id", group: str | None = "law", key: str = "article_no", seq: str = "seq") -> DataFrame:
    """(grp, ref, owner): the first document of each (group, key); a document's key is its first that isn't empty."""
    rows = docs.select(F.col(doc).alias("doc_id"), _c(group).alias("grp"), T.strip(_c(key)).alias("ref"), F.col(seq).alias("seq")).where("ref <> '' AND doc_id IS NOT NULL")
    first = rows.groupBy("doc_id").agg(F.min_by(F.struct("grp", "ref"), F.struct("seq", "grp", "ref")).alias("k"), F.min("seq").alias("seq"))
    return first.groupBy("k.grp", "k.ref").agg(F.min_by("doc_id", F.struct("seq", "doc_id")).alias("owner"))


def pairs(refs: DataFrame, keys: DataFrame) -> DataFrame:
    """(src, dst, ord): distinct citing and cited documents, none of itself."""
    joined = refs.join(keys, ["grp", "ref"]).where("owner <> doc_id")
    return joined.groupBy(F.col("doc_id").alias("src"), F.col("owner").alias("dst")).agg(F.min("ord").alias("ord"))


def citation_pairs(docs: DataFrame, pattern: str = ARTICLE, mask: str | None = OTHER_SCOPE, doc: str = "doc_id", group: str | None = "law", key: str = "article_no", text: str = "text", seq: str = "seq") -> DataFrame:
    return pairs(references(docs, pattern, mask, doc, group, text, seq), owners(docs, doc, group, key, seq))


def _statement(namespace: str, predicate: str) -> Column:
    return F.concat(F.lit("<"), T.doc_uri(namespace, "src"), F.lit(f"> <{namespace}{predicate}> <"), T.doc_uri(namespace, "dst"), F.lit("> ."))


def turtle_lines(found: DataFrame, namespace: str = NAMESPACE, predicate: str = CITES) -> DataFrame:
    """(src, dst, line): a Turtle statement a pair; ``write.text`` of ``line`` is the file."""
    return found.select("src", "dst", _statement(namespace, predicate).alias("line"))


def insert_updates(found: DataFrame, graph: str, order: list[str], namespace: str = NAMESPACE, predicate: str = CITES, drop_first: bool = True, batch: int = 5000) -> DataFrame:
    """(step, statement): SPARQL updates, at most ``batch`` pairs each, after one that drops the graph.

    Batches are numbered by range partitions: counts of the partitions give each its first number, so no task
    sorts all pairs."""
    spark = found.sparkSession
    lines = found.select(*order, _statement(namespace, predicate).alias("line"))
    placed = lines.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    from termgraph.storage import materialise

    placed = materialise(placed, "citation-lines")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    numbered = placed.join(F.broadcast(starts), "part").withColumn("row", F.col("start") + F.col("nth"))
    body = numbered.groupBy(F.floor(F.col("row") / batch).cast("int").alias("b")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("row", "line")))["line"], " ").alias("v"))
    stmts = body.select((F.col("b") + 1).alias("step"), F.concat(F.lit(f"INSERT DATA {{ GRAPH <{graph}> {{ "), "v", F.lit(" } }")).alias("statement"))
    return stmts.unionByName(spark.createDataFrame([(0, f"DROP SILENT GRAPH <{graph}>")], "step int, statement string")) if drop_first else stmts
