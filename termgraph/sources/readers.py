"""Readers of chunks, dictionaries, lexicons and gold sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termgraph.functions import text as T


def chunks_of(docs: DataFrame, doc: str = "doc_id", text: str = "text", max_chars: int | None = None) -> DataFrame:
    """(doc_id, doc_seq, chunk_id, chunk_seq, chunk_text) of documents; whole texts, or pieces of ``max_chars``; blank pieces go."""
    whole = F.array(F.col(text)) if max_chars is None else F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(max_chars)), lambda i: F.substr(F.col(text), i + 1, F.lit(max_chars)))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc).cast("string").alias("doc_id"), F.col(doc).cast("long").alias("doc_seq"), F.posexplode(whole).alias("chunk_seq", "chunk_text"))
    return rows.where(~T.is_blank("chunk_text")).select("doc_id", "doc_seq", F.concat_ws("#", "doc_id", F.col("chunk_seq").cast("string")).alias("chunk_id"), "chunk_seq", "chunk_text")


def chunk_table(spark: SparkSession, path: str) -> DataFrame:
    """Chunks with a text from Parquet."""
    return spark.read.parquet(path).where(~T.is_blank("chunk_text"))


def synonym_rows(lines: DataFrame, value: str = "value", order: Column | str | None = None) -> DataFrame:
    """(surface, reps) of lines ``surface<TAB>rep1 rep2``: two columns, the second not empty; the last line of a surface wins."""
    parts = F.split(F.regexp_replace(F.col(value), "[\\r\\n]+\\z", ""), "\t", -1)
    rows = lines.withColumn("_p", parts).where((F.size("_p") == 2) & (F.get("_p", F.lit(1)) != ""))
    ord_ = F.monotonically_increasing_id() if order is None else T.lit_or_col(order)
    reps = F.array_distinct(F.filter(F.split(T.squash(F.get("_p", F.lit(1))), " "), lambda x: x != ""))
    return rows.select(F.get("_p", F.lit(0)).alias("surface"), reps.alias("reps"), ord_.alias("_o")).groupBy("surface").agg(F.max_by("reps", "_o").alias("reps"))


def synonym_file(spark: SparkSession, path: str) -> DataFrame:
    """The dictionary of one file.  Line numbers follow the byte offsets of the splits, so one file keeps its order."""
    if not path:
        raise ValueError("a synonym dictionary needs a path")
    return synonym_rows(spark.read.text(path))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(label, key, concept, conf, src, place) of a JSON array (gzip is read by its ending); place 1 is the surest concept of a label."""
    from pyspark.sql import Window

    rows = spark.read.schema("label string, concept string, conf double, src string").option("multiLine", True).json(path)
    keyed = rows.withColumn("key", T.unspaced(F.coalesce("label", F.lit(""))))
    return keyed.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc(F.coalesce("conf", F.lit(0.0))), "concept")))


def gold_rows(spark: SparkSession, path: str, sample: int | None = None, seed: int = 42) -> DataFrame:
    """Labelled rows from Parquet, or a seeded sample of them (the ``sample`` smallest hashes, the same however it is split)."""
    df = spark.read.parquet(path)
    return df if sample is None else df.orderBy(F.xxhash64(F.lit(seed), *df.columns)).limit(sample)


def text_lines(spark: SparkSession, path: str, key: str = "text", limit: int | None = None) -> DataFrame:
    """(text) of JSON lines that have one."""
    df = spark.read.schema(f"`{key}` string").json(path).select(F.col(key).alias("text")).where(~T.is_blank("text"))
    return df if limit is None else df.limit(limit)


def dictionary_relations(pages: DataFrame, kind: str, value: str = "value") -> DataFrame:
    """(word, related) of dictionary XML (one file a row): the words of relations of type ``kind`` in each item."""
    grab = lambda c, tag: F.regexp_extract_all(c, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    bare = lambda c: T.strip(F.regexp_replace(c, "<!\\[CDATA\\[|\\]\\]>", ""))
    items = pages.select(F.explode(grab(F.col(value), "item")).alias("item"))
    rows = items.select(bare(F.get(grab(F.col("item"), "word"), F.lit(0))).alias("word"), F.explode(grab(F.col("item"), "relation_info")).alias("rel"))
    return rows.where(bare(F.get(grab(F.col("rel"), "type"), F.lit(0))) == kind).select("word", bare(F.get(grab(F.col("rel"), "word"), F.lit(0))).alias("related")).where("word <> '' AND related <> ''")


def annotated_terms(pages: DataFrame, tag: str = "term", doc: str = "doc_id", value: str = "value") -> DataFrame:
    """(term, df): terms marked in XML documents, with the number of documents."""
    found = pages.select(F.col(doc).alias("doc"), F.explode(F.regexp_extract_all(F.col(value), F.lit(f"(?s)<{tag}\\b[^>]*>(.*?)</{tag}>"), F.lit(1))).alias("t"))
    return found.select("doc", T.squash(F.regexp_replace("t", "<[^>]*>", "")).alias("term")).where("term <> ''").groupBy("term").agg(F.count_distinct("doc").alias("df"))
