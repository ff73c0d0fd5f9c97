"""Which class candidates become classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termgraph import vocab
from termgraph.functions import text as T

GATE_CHUNKS = 500
CORPUS_GATE_CHUNKS = 5000


def build_gate(classes: DataFrame, hierarchy: DataFrame, entities: DataFrame, n_chunks: int, gate_chunks: int = GATE_CHUNKS) -> DataFrame:
    """``classes`` (name, source_chunks) with ``verdict``: kept, dropped_ner_dup or dropped_df1_orphan.

    A class of the hierarchy stays; another goes if an entity bears its name, or, in a corpus of ``gate_chunks`` chunks
    or more, if fewer than two chunks have it."""
    members = hierarchy.select(F.explode(F.array("parent", "child")).alias("name")).distinct().withColumn("_in", F.lit(True))
    taken = entities.select(F.replace("entity", F.lit(" "), F.lit("")).alias("_key")).where("_key <> ''").distinct().withColumn("_taken", F.lit(True))
    j = classes.join(members, "name", "left").withColumn("_key", F.replace("name", F.lit(" "), F.lit(""))).join(taken, "_key", "left")
    verdict = F.when(F.col("_in"), "kept").when(F.col("_taken"), "dropped_ner_dup").when(F.lit(n_chunks >= gate_chunks) & (F.size("source_chunks") < 2), "dropped_df1_orphan").otherwise("kept")
    return j.select(*classes.columns, verdict.alias("verdict"))


def gate_stats(judged: DataFrame, n_chunks: int, gate_chunks: int = GATE_CHUNKS) -> DataFrame:
    n = lambda v: F.coalesce(F.sum(F.when(F.col("verdict") == v, 1).otherwise(0)), F.lit(0)).cast("long").alias(v)
    return judged.agg(n("kept"), n("dropped_df1_orphan"), n("dropped_ner_dup")).withColumn("df_gate_active", F.lit(n_chunks >= gate_chunks))


def noun_reading(readings: Column | str) -> Column:
    """Of up to three readings the first that ends nominally and has a content noun, else the first."""
    r = F.slice(T.lit_or_col(readings), 1, 3)
    good = F.filter(r, lambda t: (F.size(t) > 0) & F.element_at(t, -1)["tag"].isin(*vocab.NOUNISH) & F.exists(t, lambda x: x["tag"].isin(*vocab.CONTENT_NOUNS)))
    return F.when(F.size(good) > 0, F.get(good, F.lit(0))).otherwise(F.get(r, F.lit(0)))


def reason(corpus_chunks: int | None, label: str = "name", tokens: str = "tokens", english_tag: str = "en_tag", wordnet: str = "wordnet", min_df: int = 2, gate_chunks: int = CORPUS_GATE_CHUNKS) -> Column:
    """Why a label is dropped, or an empty string: shape, person, gate, repeat, relhead, deictic, overjoin.

    Columns beside ``label``: ``df``, ``has_rel``, ``has_kid``, ``has_inst``, ``person_dom``; ``tokens`` (NULL: no reading, grammar passes);
    ``english_tag``, the part of speech of a Latin label's last word (NULL: no tagger); ``wordnet``, whether it is a common noun there (NULL: unknown)."""
    c = T.strip(F.coalesce(F.col(label), F.lit("")))
    gate = corpus_chunks is not None and corpus_chunks >= gate_chunks
    hangul = T.has(c, T.HANGUL)
    words = F.split(T.squash(c), " ")
    single_lower = T.is_lower(c) & (F.size(words) == 1)
    tag, known = F.col(english_tag), F.col(wordnet)
    latin = (
        F.when(F.element_at(words, -1).rlike("\\A\\p{Lu}") & ~T.is_upper(c), "")
        .when(tag.isNull(), "")
        .when(~tag.startswith("NN"), "shape")
        .when((F.length(c) <= 2) | (single_lower & (F.length(c) <= 3)), "shape")
        .when(single_lower & ~F.coalesce(known, F.lit(True)), "shape")
        .otherwise("")
    )
    t = F.col(tokens)
    first, last = F.get(t, F.lit(0)), F.element_at(t, -1)
    nouns = F.size(F.filter(t, lambda x: x["tag"].isin("NNG", "NNP")))
    korean = (
        F.when(t.isNull(), "")
        .when((F.size(t) == 0) | ~F.exists(t, lambda x: x["tag"].isin(*vocab.CONTENT_NOUNS)) | ~last["tag"].isin(*vocab.NOUNISH), "shape")
        .when(last["form"].isin(*vocab.RELATIVE_HEADS) | c.isin(*vocab.RELATIVE_HEADS), "relhead")
        .when((F.size(t) >= 2) & first["form"].isin(*vocab.DEICTIC), "deictic")
        .when(F.lit(gate) & (nouns >= 4) & (F.col("df") <= 2) & (F.length(c) >= 10), "overjoin")
        .otherwise("")
    )
    yes = lambda n: F.coalesce(F.col(n), F.lit(False))
    return (
        F.when(c == "", "shape")
        .when(yes("person_dom") & ~(~hangul & F.coalesce(known, F.lit(False))), "person")
        .when(F.lit(gate) & ~((F.coalesce(F.col("df"), F.lit(1)) >= min_df) | yes("has_rel") | yes("has_kid") | yes("has_inst")), "gate")
        .when(T.doubled(c), "repeat")
        .when(~hangul, latin)
        .otherwise(korean)
    )


def decided(items: DataFrame, corpus_chunks: int | None, **names) -> DataFrame:
    """``items`` with ``decision``, a struct of ``keep`` and ``reason``."""
    r = reason(corpus_chunks, **names)
    return items.withColumn("_r", r).withColumn("decision", F.struct((F.col("_r") == "").alias("keep"), F.col("_r").alias("reason"))).drop("_r")


def partition(items: DataFrame, corpus_chunks: int | None, **names) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped with ``reason``)."""
    d = decided(items, corpus_chunks, **names)
    return d.where("decision.keep").drop("decision"), d.where("NOT decision.keep").withColumn("reason", F.col("decision.reason")).drop("decision")
