"""Readers, sentence splits and renames over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termgraph.operators import dedup, entities, relations
from termgraph.plans.registry import query, table
from termgraph.sources import readers
from termgraph.storage import table_path

S = SparkSession


@query("""SELECT surface, list_aggregate(list_sort(list_distinct(string_split(reps, ' '))), 'string_agg', ' ') AS reps
FROM (SELECT p_brand AS surface, arg_max(p_type, p_partkey) AS reps FROM part GROUP BY 1)""")
def synonym_lines(spark: S, d: str) -> DataFrame:
    """SRC-3: a dictionary line a part, of which the last of each surface wins."""
    lines = table(spark, d, "part").select(F.concat("p_brand", F.lit("\t"), "p_type").alias("value"), "p_partkey")
    return readers.synonym_rows(lines, order="p_partkey").select("surface", F.array_join(F.array_sort("reps"), " ").alias("reps"))


@query("SELECT text, count(*) AS n FROM documents WHERE regexp_matches(text, '\\S') GROUP BY text")
def text_lines_read(spark: S, d: str) -> DataFrame:
    """SRC-6: the documents as JSON lines, written and read again."""
    path = table_path(spark, "lines")
    table(spark, d, "documents").select("text", "lang").write.json(path)
    return readers.text_lines(spark, path).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


_MENTIONS = "SELECT DISTINCT doc_id, unnest(regexp_extract_all(substr(text, {}, 1200), '[A-Z][a-z]+')) AS entity FROM documents"


@query(f"""WITH one AS ({_MENTIONS.format(1)}), two AS ({_MENTIONS.format(1201)})
SELECT doc_id AS chunk_id, entity, true AS placed FROM one UNION ALL SELECT doc_id, entity, false FROM two WHERE (doc_id, entity) NOT IN (SELECT (doc_id, entity) FROM one)""")
def two_passes(spark: S, d: str) -> DataFrame:
    """NER-2: capitalised words of the second 1200 characters that the first don't have, without a place."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    found = lambda at: docs.select("chunk_id", F.explode(F.regexp_extract_all(F.substring("text", at, 1200), F.lit("[A-Z][a-z]+"), F.lit(0))).alias("entity")).distinct().select("chunk_id", "entity", F.lit(0).alias("start"), F.lit(1).alias("end"))
    return entities.two_pass(found(1), found(1201)).select("chunk_id", "entity", F.col("start").isNotNull().alias("placed"))


@query("""WITH cut AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([!?])\\s', '\\1' || chr(1), 'g'), '다\\.(\\s)', '다' || chr(1) || '\\1', 'g') AS t FROM documents),
one AS (SELECT doc_id, unnest(string_split(t, chr(1))) AS s FROM cut)
SELECT doc_id, count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS chars FROM one WHERE regexp_matches(s, '\\S') GROUP BY doc_id""")
def sentences_split(spark: S, d: str) -> DataFrame:
    """REL-6: sentences of every document."""
    one = table(spark, d, "documents").select("doc_id", F.explode(relations.split_sentences("text")).alias("s"))
    return one.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("s")).alias("chars"))


@query("""WITH a AS (SELECT p_name AS old, min(p_brand) AS canonical FROM part WHERE p_size < 25 GROUP BY 1),
b AS (SELECT p_name AS old, min(p_type) AS canonical FROM part GROUP BY 1 UNION ALL SELECT p_brand, min(p_name) FROM part GROUP BY 1)
SELECT old, canonical FROM a UNION ALL SELECT old, canonical FROM b WHERE old NOT IN (SELECT old FROM a) AND (canonical, old) NOT IN (SELECT (old, canonical) FROM a)""")
def renames_merged(spark: S, d: str) -> DataFrame:
    """DED-3: rename maps by priority, without what is renamed already and what would turn a rename round."""
    p = table(spark, d, "part")
    by = lambda rows, old, new: rows.groupBy(F.col(old).alias("old")).agg(F.min(new).alias("canonical"))
    return dedup.merge_renames([by(p.where("p_size < 25"), "p_name", "p_brand"), by(p, "p_name", "p_type").union(by(p, "p_brand", "p_name"))])


_LINKED = "SELECT p_partkey AS name, [p_type, p_brand] AS ids FROM part"


@query(f"""WITH l AS ({_LINKED}) SELECT x.name AS a, y.name AS b, list_has_any(x.ids, y.ids) AS meet, x.ids[1] = y.ids[1] AS top FROM l x JOIN l y ON y.name = x.name + 1""")
def linked_pairs(spark: S, d: str) -> DataFrame:
    """DED-12: each part and the next, by their ids: whether any meet, whether the first are equal."""
    links = table(spark, d, "part").select(F.col("p_partkey").alias("name"), F.array("p_type", "p_brand").alias("ids"))
    pairs = links.select(F.col("name").alias("a"), (F.col("name") + 1).alias("b")).join(links.select(F.col("name").alias("b")), "b")
    both = dedup.linked_same(dedup.linked_same(pairs, links).withColumnRenamed("same", "meet"), links, top_only=True)
    return both.select("a", "b", "meet", F.col("same").alias("top"))


@query("""WITH p AS (SELECT p_partkey AS k, p_brand, p_type, p_size FROM part)
SELECT x.k AS a, y.k AS b, x.p_brand = y.p_brand OR x.p_type = y.p_type OR x.p_size = y.p_size AS same FROM p x JOIN p y ON y.k = x.k + 1""")
def channels_united(spark: S, d: str) -> DataFrame:
    """DED-13: a pair is one where any of three channels says so, whichever way round it gives it."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_brand", "p_type", "p_size")
    side = lambda s: p.select(*[F.col(c).alias(f"{s}_{c}") for c in p.columns])
    both = side("x").join(side("y"), F.col("y_k") == F.col("x_k") + 1)
    said = lambda c: both.where(F.col(f"x_{c}") == F.col(f"y_{c}"))
    channels = [said("p_brand").select(F.col("x_k").alias("a"), F.col("y_k").alias("b")), said("p_type").select(F.col("y_k").alias("a"), F.col("x_k").alias("b")), said("p_size").select(F.col("x_k").alias("a"), F.col("y_k").alias("b"))]
    return dedup.same_by_any(both.select(F.col("x_k").alias("a"), F.col("y_k").alias("b")), channels)
