"""Renames: names that mean the same, and their effect on every table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termgraph.functions import text as T
from termgraph.storage import materialise

SEPARATORS = "(?U)[\\s()（）「」『』【】\\[\\]•·/_\\\\-]+"
ENGLISH_NOISE = "belongs|connection|reference|relation|mapping|from|link|with|have|the|has|and|for|are|by|is|of|or|to"
HUB = 5000


def noun_key(name: Column | str, tokens: Column | str | None = None, strip_noise: bool = False) -> Column:
    """Key of a name: its nouns and foreign words together in lower case; without a reading, the name without separators.

    No word of the noise pattern begins another, so their order doesn't matter; ``to`` inside a word goes too."""
    cleaned = F.regexp_replace(T.strip(F.coalesce(T.lit_or_col(name), F.lit(""))), SEPARATORS, "")
    if tokens is None:
        return F.lower(cleaned)
    nouns = F.array_join(F.transform(F.filter(T.lit_or_col(tokens), lambda t: t["tag"].startswith("N") | t["tag"].isin("SH", "SL", "SW")), lambda t: t["form"]), "")
    key = F.lower(nouns)
    if strip_noise:
        key = F.regexp_replace(key, ENGLISH_NOISE, "")
    return F.when(cleaned == "", F.lit("")).when(nouns != "", key).otherwise(F.lower(cleaned))


def rename_by_key(names: DataFrame, name: str = "name", key: str = "key", order: str = "ord") -> DataFrame:
    """(old, canonical): names whose key another name had first."""
    rows = names.where((F.col(name) != "") & (F.col(key) != "")).groupBy(F.col(key).alias("k"), F.col(name).alias("old")).agg(F.min(order).alias("o"))
    first = F.first("old").over(Window.partitionBy("k").orderBy("o", "old"))
    found = rows.withColumn("canonical", first).where("old <> canonical")
    return found.groupBy("old").agg(F.max_by("canonical", "o").alias("canonical"))


def merge_renames(parts: list[DataFrame]) -> DataFrame:
    """One table of several (old, canonical): the earlier part wins; a later row goes if its name is renamed already or
    if the reverse is."""

    def add(a: DataFrame, b: DataFrame) -> DataFrame:
        back = a.select(F.col("canonical").alias("old"), F.col("old").alias("canonical"))
        return a.unionByName(b.join(a.select("old"), "old", "left_anti").join(back, ["old", "canonical"], "left_anti"))

    return reduce(add, parts)


def _chain_ends(base: DataFrame) -> tuple[DataFrame, bool]:
    """(``base`` with each target replaced by the end of its chain, whether some chain has no end).

    Once a round's targets that still lead on are as many as the round's before, every one of them lies on a cycle (a jump maps them onto
    themselves), and further rounds find no end.  The joins are merges: no table goes through the driver."""
    ptr, domain = base, base.select(F.col("old").alias("canonical"))
    lasting = None
    while True:
        on = ptr.select("canonical").distinct().join(domain.hint("merge"), "canonical", "left_semi").count()
        if on == 0 or on == lasting:
            return ptr, on > 0
        lasting = on
        hop = ptr.select(F.col("old").alias("canonical"), F.col("canonical").alias("to"))
        ptr = materialise(ptr.join(hop.hint("merge"), "canonical", "left").select("old", F.coalesce("to", "canonical").alias("canonical")), "rename-ends")


def flatten_renames(renames: DataFrame) -> DataFrame:
    """(old, canonical): every chain followed to its end, none to itself.

    Pointers jump to their target's target, so rounds grow with the logarithm of the longest chain.  A name on a cycle
    maps to nothing; a name that leads into one maps to the name at which it enters."""
    base = materialise(renames.where("old <> '' AND canonical <> '' AND old <> canonical"), "renames")
    ends, endless = _chain_ends(base)
    if endless:  # what isn't at an end is on a cycle, and every name of a cycle is reached
        cycle = materialise(ends.select(F.col("canonical").alias("old")).distinct().join(base.select("old").hint("merge"), "old", "left_semi"), "rename-cycles")
        ends, _ = _chain_ends(materialise(base.join(cycle.hint("merge"), "old", "left_anti"), "rename-chains"))
    return ends.where("old <> canonical")


def renamed(df: DataFrame, renames: DataFrame, column: str) -> DataFrame:
    """``df`` with the names of ``column`` replaced; the table of renames is broadcast by size by the optimizer."""
    r = renames.select(F.col("old").alias("_old"), F.col("canonical").alias("_new"))
    return df.join(r, df[column] == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def apply_to_classes(classes: DataFrame, renames: DataFrame, order: str = "ord", unite_chunks: bool = False) -> DataFrame:
    """(name, source_chunks, ord): the first class of each new name; the chunks of the others are lost unless united."""
    r = renamed(classes.where("name IS NOT NULL AND name <> ''"), renames, "name")
    chunks = F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_chunks")))) if unite_chunks else F.min_by("source_chunks", order)
    return r.groupBy("name").agg(chunks.alias("source_chunks"), F.min(order).alias(order))


def apply_to_hierarchy(hierarchy: DataFrame, renames: DataFrame) -> DataFrame:
    r = renamed(renamed(hierarchy.select("parent", "child"), renames, "parent"), renames, "child")
    return r.where("NOT parent <=> child").distinct()


def apply_to_entities(entities: DataFrame, renames: DataFrame) -> DataFrame:
    return renamed(renamed(entities, renames, "entity"), renames, "class")


def apply_to_relations(relations: DataFrame, renames: DataFrame) -> DataFrame:
    """Triples with new names, without those that became loops (if there is no rename at all, nothing changes)."""
    out = relations
    for c in ("subject", "predicate", "object"):
        out = renamed(out, renames, c)
    any_ = renames.agg((F.count(F.lit(1)) > 0).alias("_any"))
    return out.crossJoin(F.broadcast(any_)).where("NOT _any OR NOT subject <=> object").drop("_any")


def rename_by_synonym(names: DataFrame, dictionary: DataFrame, name: str = "name", order: str = "ord") -> DataFrame:
    """(old, canonical): names whose sets of representatives are identical."""
    keyed = names.withColumn("surface", T.surface_key(name)).join(dictionary, "surface").withColumn("key", F.array_join(F.array_sort(F.array_distinct("reps")), "\x01"))
    return rename_by_key(keyed, name, "key", order)


def are_synonyms(pairs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``synonyms``: whether their sets of representatives meet."""
    d = lambda c: dictionary.select(F.col("surface").alias(f"_s{c}"), F.col("reps").alias(f"_r{c}"))
    j = pairs.join(d("a"), T.surface_key("a") == F.col("_sa"), "left").join(d("b"), T.surface_key("b") == F.col("_sb"), "left")
    return j.withColumn("synonyms", F.coalesce(F.arrays_overlap("_ra", "_rb"), F.lit(False))).drop("_sa", "_sb", "_ra", "_rb")


def class_synonym_candidates(labels: DataFrame, dictionary: DataFrame, hub: int = HUB) -> DataFrame:
    """(a, b, inst_a, inst_b, deny) of ``labels`` (label, inst, ord) that share a representative; ``deny`` says why not."""
    own = labels.withColumn("surface", T.surface_key("label")).groupBy("surface").agg(F.min_by(F.struct("label", "inst"), "ord").alias("l"))
    known = own.join(dictionary, "surface").select("surface", "l", "reps")
    by_rep = known.select(F.explode("reps").alias("rep"), "surface")
    pairs = by_rep.alias("x").join(by_rep.alias("y"), F.expr("x.rep = y.rep AND x.surface < y.surface")).select(F.col("x.surface").alias("sa"), F.col("y.surface").alias("sb")).distinct()
    j = pairs.join(known.select(F.col("surface").alias("sa"), F.col("l").alias("la"), F.size("reps").alias("na")), "sa").join(known.select(F.col("surface").alias("sb"), F.col("l").alias("lb"), F.size("reps").alias("nb")), "sb")
    ia, ib = F.col("la.inst"), F.col("lb.inst")
    deny = F.array_compact(
        F.array(
            F.when(F.contains("sa", F.col("sb")) | F.contains("sb", F.col("sa")), "substr"),
            F.when((F.col("na") > 1) | (F.col("nb") > 1), "ambig"),
            F.when(F.greatest(ia, ib) > hub, "hub"),
            F.when((ia == 0) & (ib == 0), "zero"),
        )
    )
    return j.select(F.col("la.label").alias("a"), F.col("lb.label").alias("b"), ia.alias("inst_a"), ib.alias("inst_b"), deny.alias("deny"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): connected components of ``edges`` (a, b) by least labels and pointer jumps."""
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "er-edges")
    labels = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "node"), "er-labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
        moved = materialise(step.join(up, "root", "left").select("node", "was", F.least("root", F.coalesce("up", "root")).alias("root")), "er-labels")
        labels = moved.select("node", "root")
        if moved.where("root <> was").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def synonym_sets(edges: DataFrame, max_size: int = 30) -> DataFrame:
    """(surface, reps): the sets of synonyms by word sense (``word#sense`` nodes), without those under two or over ``max_size``."""
    c = components(edges).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("root"))).where(F.col("n").between(2, max_size))
    return c.groupBy(T.surface_key(F.regexp_replace("node", "#.*", "")).alias("surface")).agg(F.array_sort(F.collect_set("root")).alias("reps"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def embedding_synonyms(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """``pairs`` (a, b) of ids with ``similarity`` and ``same`` from ``vectors`` (id, vec)."""
    v = lambda c: vectors.select(F.col("id").alias(c), F.col("vec").alias(f"_{c}"))
    j = pairs.join(v("a"), "a").join(v("b"), "b").withColumn("similarity", cosine(F.col("_a"), F.col("_b")))
    return j.withColumn("same", F.coalesce(F.col("similarity") >= threshold, F.lit(False))).drop("_a", "_b")


def same_by_any(pairs: DataFrame, channels: list[DataFrame]) -> DataFrame:
    """``pairs`` (a, b) with ``same``: whether any of ``channels`` (tables of pairs that one resolver holds to be one) has the pair, either way round."""
    ordered = lambda d: d.select(F.least("a", "b").alias("_x"), F.greatest("a", "b").alias("_y"))
    said = reduce(DataFrame.union, [ordered(c) for c in channels]).distinct().withColumn("_said", F.lit(True))
    j = pairs.withColumns({"_x": F.least("a", "b"), "_y": F.greatest("a", "b")}).join(said, ["_x", "_y"], "left")
    return j.select(*pairs.columns, F.coalesce("_said", F.lit(False)).alias("same"))


def linked_same(pairs: DataFrame, links: DataFrame, top_only: bool = False) -> DataFrame:
    """``pairs`` (a, b) with ``same``: whether their knowledge-base ids (``links``: name, ids in rank order) meet, or the first are equal."""
    v = lambda c: links.select(F.col("name").alias(c), F.col("ids").alias(f"_{c}"))
    test = F.get("_a", F.lit(0)) == F.get("_b", F.lit(0)) if top_only else F.arrays_overlap("_a", "_b")
    return pairs.join(v("a"), "a", "left").join(v("b"), "b", "left").withColumn("same", F.coalesce(test, F.lit(False))).drop("_a", "_b")
