"""Types of entities: from definitional sentences and from an occupation lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termgraph import vocab
from termgraph.functions import text as T

WINDOW = 15
SHORT = 3


def _key(c: Column | str) -> Column:
    return F.replace(F.coalesce(T.lit_or_col(c), F.lit("")), F.lit(" "), F.lit(""))


def best_parents(evidence: DataFrame, entities: DataFrame) -> DataFrame:
    """(child_key, parent, n): of each entity the parent with most evidence, then the longest, then the last in order."""
    known = entities.select(_key("entity").alias("child_key")).where("child_key <> ''").distinct()
    pairs = evidence.withColumn("child_key", _key("child")).join(known, "child_key", "left_semi").groupBy("child_key", "parent").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("child_key").agg(F.max(F.struct("n", F.length("parent").alias("len"), "parent")).alias("b")).select("child_key", "b.parent", "b.n")


def definitional_types(pairs: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(remaining class pairs, entities with new classes, (child, parent) edges to the coarse class).

    A pair whose child is an entity types it instead.  A parent that is an entity's name needs two children; only
    entities whose coarse class is that of the parent's majority change (ties: the first in order), and
    the parent is put under the coarse class if two or more agree."""
    e = entities.withColumn("_k", _key("entity"))
    known = e.where("_k <> ''").select("_k").distinct()
    remaining = pairs.withColumn("_k", _key("child")).join(known, "_k", "left_anti").drop("_k")
    best = best_parents(pairs, entities)
    counts = e.where("_k <> '' AND class IS NOT NULL AND class <> ''").groupBy("_k", "class").agg(F.count(F.lit(1)).alias("n"))
    coarse = counts.groupBy("_k").agg(F.max_by("class", F.struct("n", F.lit(0) - F.ascii("class"))).alias("x"), F.max("n").alias("top")).join(counts, "_k").where("n = top").groupBy("_k").agg(F.min("class").alias("coarse"))
    members = best.join(coarse, F.col("child_key") == F.col("_k"), "left").select("child_key", "parent", "coarse")
    size = members.groupBy("parent").agg(F.count_distinct("child_key").alias("kids"))
    valid = size.join(known.select(F.col("_k").alias("pk")), _key("parent") == F.col("pk"), "left").where("pk IS NULL OR kids >= 2").select("parent")
    m = members.join(valid, "parent", "left_semi").where("coarse IS NOT NULL")
    per = m.groupBy("parent", "coarse").agg(F.count(F.lit(1)).alias("n"))
    major = per.withColumn("place", F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("n"), "coarse"))).where("place = 1").select("parent", F.col("coarse").alias("major"), "n")
    change = m.join(major, "parent").where("coarse = major").select(F.col("child_key").alias("_k"), F.col("coarse").alias("_from"), F.col("parent").alias("_to"))
    typed = e.join(change, (e["_k"] == change["_k"]) & (e["class"] == change["_from"]), "left").withColumn("class", F.coalesce("_to", "class")).select(*entities.columns)
    return remaining, typed, major.where("n >= 2").select(F.col("parent").alias("child"), F.col("major").alias("parent"))


def selected_types(evidence: DataFrame, labels: DataFrame) -> DataFrame:
    """(child_key, parent, n): the best supported type; a parent that is itself a label (``label``, without blanks) needs two children."""
    ev = evidence.select(T.unspaced("child").alias("child_key"), "parent").groupBy("child_key", "parent").agg(F.count(F.lit(1)).alias("n"))
    kids = ev.groupBy(T.unspaced("parent").alias("pk")).agg(F.count_distinct("child_key").alias("kids"))
    j = ev.withColumn("pk", T.unspaced("parent")).join(kids, "pk").join(labels.select(F.col("label").alias("pk")).distinct().withColumn("is_label", F.lit(True)), "pk", "left")
    good = j.where("is_label IS NULL OR kids >= 2")
    return good.groupBy("child_key").agg(F.max(F.struct("n", F.length("parent").alias("len"), "parent")).alias("b")).select("child_key", "b.parent", "b.n")


def class_head(forms: Column, classes: Column) -> Column:
    """The longest ending of the noun forms that is a promoted class, or an empty string."""
    n = F.size(forms)
    ends = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(forms, i, n), ""))
    return F.when(n > 0, F.coalesce(F.get(F.filter(ends, lambda e: F.array_contains(classes, e)), F.lit(0)), F.lit(""))).otherwise("")


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("\\Q"), c, F.lit("\\E"))


def evidence_ok(candidates: DataFrame, chunks: DataFrame, mode: str = "adj", text: str = "chunk_text") -> DataFrame:
    """(label, concept) of ``candidates`` for which the corpus speaks.

    ``adj``: a cue of the concept within 15 characters of the label; ``doc``: both in a chunk; labels of more than three
    Hangul letters pass, but with ``adjdoc`` they need both in a chunk; ``off``: all pass."""
    one = candidates.select("label", "concept").distinct()
    if mode == "off":
        return one
    long_ = F.length(F.regexp_replace("label", "[^가-힣]", "")) > SHORT
    cues = F.create_map(*[x for k, v in vocab.EVIDENCE.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    asked = one.withColumn("long", long_).withColumn("cue", F.explode(F.coalesce(cues[F.col("concept")], F.array("concept"))))
    label = F.concat(F.lit("(?<![가-힣])"), _quoted(F.col("label")), F.lit("(?=[가과나는도든랑로를서에와은을의이]|[^가-힣]|$)"))
    cue = _quoted(F.col("cue"))
    gap = F.lit(f".{{0,{WINDOW}}}")
    near = F.rlike(text, F.concat(cue, gap, label, F.lit("|"), label, gap, cue))
    same = F.rlike(text, label) & F.rlike(text, F.concat(F.lit("(?<![가-힣])"), cue))
    test = F.when(F.col("long"), same).otherwise(same if mode == "doc" else near)
    free = asked.where("long" if mode != "adjdoc" else "false").select("label", "concept")
    rest = asked.where("NOT long" if mode != "adjdoc" else "true")
    # labels and texts meet by the label's first two characters; containment is a cheap filter before the patterns
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.col(text).substr(i, F.lit(2)))
    grams = chunks.select(text, F.explode(F.array_distinct(F.concat(pairs, F.transform(pairs, lambda x: F.substring(x, 1, 1))))).alias("_gram"))
    keyed = rest.withColumn("_gram", F.substring("label", 1, 2))
    hit = keyed.join(grams.join(keyed.select("_gram").distinct(), "_gram", "left_semi"), "_gram").where(F.contains(text, F.col("label")) & F.contains(text, F.col("cue")) & test).select("label", "concept")
    return free.unionByName(hit).distinct()


def person_labels(entities: DataFrame, person: str = vocab.PERSON) -> DataFrame:
    """(key) of labels of which no class is more frequent than person."""
    n = entities.select(T.unspaced("entity").alias("key"), F.coalesce("class", F.lit("")).alias("class")).where("key <> ''").groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("key").agg(F.max("n").alias("top"), F.max(F.when(F.col("class") == person, F.col("n"))).alias("p")).where("p = top").select("key")


def occupation_types(entities: DataFrame, lexicon: DataFrame, chunks: DataFrame | None, mode: str = "adj", person: str = vocab.PERSON) -> tuple[DataFrame, DataFrame]:
    """(entities with occupations as classes and a record more for each further occupation, (child, parent) edges to person).

    ``entities`` has ``doc_id`` and ``ord``; ``lexicon`` is (label, concept, conf).  Without ``chunks`` no evidence is asked for."""
    lex = lexicon.select(T.unspaced("label").alias("key"), "concept", F.coalesce("conf", F.lit(0.0)).alias("conf")).distinct()
    e = entities.withColumn("key", T.unspaced(F.coalesce("entity", F.lit(""))))
    asked = e.where(F.col("class") == person).join(person_labels(entities, person), "key", "left_semi").join(lex, "key").select("doc_id", "ord", "key", F.col("entity").alias("label"), "concept", "conf")
    if chunks is not None:
        asked = asked.join(evidence_ok(asked, chunks, mode), ["label", "concept"], "left_semi")
    ranked = asked.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "ord").orderBy(F.desc("conf"), "concept")))
    main = ranked.where("place = 1").select("doc_id", "ord", F.col("concept").alias("_c"))
    extra = ranked.where("place > 1").groupBy("key", "concept").agg(F.min(F.struct("doc_id", "ord")).alias("f")).select("f.doc_id", "f.ord", F.col("concept").alias("_c"))
    typed = entities.join(main, ["doc_id", "ord"], "left").withColumn("class", F.coalesce("_c", "class")).select(*entities.columns)
    more = entities.join(extra, ["doc_id", "ord"]).withColumn("class", F.col("_c")).select(*entities.columns)
    edges = main.select("_c").unionByName(extra.select("_c")).distinct().select(F.col("_c").alias("child"), F.lit(person).alias("parent"))
    return typed.unionByName(more), edges
