"""Co-occurrence edges: support, lift, and a greedy cap of the degree."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termgraph import vocab
from termgraph.functions import text as T
from termgraph.operators import paircount
from termgraph.storage import materialise

LEVEL = 1 / 4  #: share of all pairs that a level of ``capped_edges`` may form, about

PREDICATE, PREDICATE_KO, PREDICATE_EN = "coOccursWith", "함께언급", "co-occurs with"


def label_fits(label: Column | str) -> Column:
    """Whether a label has the form of a name, in any language."""
    c = T.strip(F.coalesce(T.lit_or_col(label), F.lit("")))
    letters = F.array_join(F.regexp_extract_all(c, F.lit(T.LETTERS), F.lit(0)), "")
    words = F.split(T.squash(c), " ")
    hangul, cjk = T.has(c, T.HANGUL), T.has(c, T.CJK)
    longest = F.aggregate(F.regexp_extract_all(c, F.lit(T.LETTERS + "+"), F.lit(0)), F.lit(0), lambda a, x: F.greatest(a, F.length(x)))
    first_latin = F.regexp_extract(c, "[A-Za-z]", 0)
    bad = (
        (F.length(letters) < 2)
        | T.doubled(c)
        | letters.rlike(T.greedy_units(sorted(vocab.CALENDAR)))
        | T.has(c, "[()\\[\\]{}]|\\A[\"“”'‘’]|[‘’'“”\"]\\z")
        | T.has(c, "\\A[.,:;-]|[!,:;-]\\z")
        | ((F.size(words) >= 2) & hangul & F.exists(words, lambda w: w.rlike("(?U)\\A\\d+\\z")))
        | (~cjk & T.full(c, "[A-Za-z]" + T.LETTERS) & ~T.is_upper(c))
        | (~cjk & first_latin.rlike("[a-z]") & (longest <= 2))
    )
    # a word of small Latin letters can only be doubled: none of the other patterns need be tried
    return F.when(T.lit_or_col(label).rlike("\\A[a-z]{3,}\\z"), ~T.doubled(label)).otherwise((c != "") & ~bad)


def korean_label_fits(label: Column | str, tokens: Column | str) -> Column:
    """The same, and not a bound noun alone nor a label that ends in a particle; without a reading it passes."""
    t = T.lit_or_col(tokens)
    last = F.element_at(t, -1)["tag"]
    bad = (F.size(t) > 0) & (((F.size(t) == 1) & (last == "NNB")) | last.startswith("J"))
    return label_fits(label) & (~T.has(label, T.HANGUL) | ~F.coalesce(bad, F.lit(False)))


def kept_mentions(mentions: DataFrame, max_entities: int | None = 60, fits: Column | None = None, chunk: str = "chunk_id", key: str = "key") -> DataFrame:
    """(chunk, key): the accepted keys of each chunk, each once, the first ``max_entities`` in order, or all (None)."""
    rows = mentions.where(F.coalesce(fits, F.lit(False))) if fits is not None else mentions
    one = rows.select(F.col(chunk).alias("chunk"), F.col(key).alias("key")).distinct()
    if max_entities is None:
        return one
    place = F.row_number().over(Window.partitionBy("chunk").orderBy("key"))
    return one.withColumn("_n", place).where(F.col("_n") <= max_entities).drop("_n")


def _sets(kept: DataFrame, min_pair_df: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """((k): the numbers of each chunk's keys, (key, id), each number's chunks), for keys frequent enough for any pair."""
    kept = materialise(kept.where("key IS NOT NULL"), "cooccur-kept")
    df = kept.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_pair_df)  # a pair is no more frequent than its ends
    names = materialise(paircount.numbered(df, "key"), "cooccur-names")
    each = names.select("id", "df").toPandas()  # eight bytes for each key go to the driver and from there to the workers
    many = np.zeros(len(each), np.int64)
    many[each["id"].to_numpy()] = each["df"].to_numpy()
    sets = kept.join(names.select("key", "id"), "key").groupBy("chunk").agg(F.sort_array(F.collect_list("id")).alias("k")).where(F.size("k") > 1).select("k")
    return materialise(sets, "cooccur-sets"), names.select("key", "id"), many


def _named(pairs: DataFrame, names: DataFrame) -> DataFrame:
    end = lambda c: names.select(F.col("id").alias(f"_{c}"), F.col("key").alias(c))
    numbers = pairs.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "n")
    return numbers.join(end("a"), "_a").join(end("b"), "_b").select("a", "b", "n")


def _without(found: DataFrame, exclude: DataFrame | None) -> DataFrame:
    if exclude is None:
        return found
    gone = exclude.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return found.join(gone, ["a", "b"], "left_anti")


def edges(kept: DataFrame, n_chunks: DataFrame, min_pair_df: int = 3, lift_k: float = 2.0, exclude: DataFrame | None = None) -> DataFrame:
    """(a, b, n) with a < b: pairs in ``min_pair_df`` chunks or more whose lift is above ``lift_k``.

    ``n_chunks`` is one row, ``n``: all chunks, those without a mention too.  Keys become numbers in their order; the pairs of the sets of
    numbers are counted in arrays (``paircount``), and only edges get their names back."""
    sets, names, df = _sets(kept, min_pair_df)
    found = paircount.counts(sets, df, n_chunks.first()["n"], paircount.total_pairs(sets), min_pair_df, lift_k)
    return _without(_named(found, names), exclude)


def capped_edges(kept: DataFrame, n_chunks: DataFrame, min_pair_df: int = 3, lift_k: float = 2.0, max_degree: int = 30) -> DataFrame:
    """``cap_degree`` of ``edges``, without forming the pairs that the cap drops.

    The walk goes down in n, so it is done in levels of n, the highest first: a level needs the pairs of keys that are frequent enough for
    it and not full yet, and no other.  Where most keys are full, little of a long chunk is left."""
    sets, names, df = _sets(kept, min_pair_df)
    n, pairs, mass = n_chunks.first()["n"], paircount.total_pairs(sets), max(1, int(df.sum()))
    room, taken, most = np.full(len(df), max_degree, np.int32), [], int(df.max(initial=0)) + 1
    while most > min_pair_df:
        free = np.sort(df[room > 0])
        heavy = np.cumsum(free[::-1])  # mentions of the most frequent free keys
        fits = int(np.searchsorted(heavy, mass * LEVEL**0.5, "right"))
        least = min_pair_df if fits >= len(free) else min(int(free[::-1][fits]) + 1, most * 3 // 4)
        least = max(min_pair_df, min(least, most - 1))
        wanted = (room > 0) & (df >= least)
        share = float(df[wanted].sum()) / mass
        found = materialise(paircount.counts(sets, df, n, pairs * share * share, least, lift_k, most, wanted), "cooccur-level")
        new, room = paircount.walk(found, room)
        taken += [new] if new is not None else []
        most = least
    return _named(reduce(DataFrame.unionByName, taken), names) if taken else _named(paircount.counts(sets, df, n, pairs, min_pair_df, lift_k, 0), names)


def cap_degree(found: DataFrame, max_degree: int | None = 30) -> DataFrame:
    """``found`` as a walk down (n descending, a, b) would leave it that skips an edge with an end already at ``max_degree``.

    Ends become numbers in their order and the walk goes over ranges of ranked edges, a range at a time (``paircount.walk``)."""
    if max_degree is None:
        return found
    left = materialise(found, "degree-left")
    names = materialise(paircount.numbered(left.select(F.col("a").alias("key")).unionByName(left.select(F.col("b").alias("key"))).distinct(), "key"), "degree-names")
    end = lambda c: names.select(F.col("key").alias(c), F.col("id").alias(f"_{c}"))
    ranked = materialise(left.join(end("a"), "a").join(end("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"), F.col("n").cast("long").alias("n")), "degree-ranked")
    taken, _ = paircount.walk(ranked, np.full(names.count(), max_degree, np.int32))
    return left if taken is None else _named(taken, names)


def triples(found: DataFrame) -> DataFrame:
    """Both directions of each edge as (subject, predicate, object)."""
    one = found.select(F.col("a").alias("subject"), F.lit(PREDICATE).alias("predicate"), F.col("b").alias("object"))
    return one.unionByName(found.select(F.col("b").alias("subject"), F.lit(PREDICATE).alias("predicate"), F.col("a").alias("object")))


def ingest_stats(mentions: DataFrame, fits: Column, max_entities: int = 60, chunk: str = "chunk_id", key: str = "key") -> DataFrame:
    """One row: chunks, rejected records, truncated chunks."""
    m = mentions.withColumn("_ok", F.coalesce(fits, F.lit(False)))
    per = m.groupBy(F.col(chunk).alias("chunk")).agg(F.sum(F.when(F.col("_ok") | F.col(key).isNull(), 0).otherwise(1)).alias("rejected"), F.count_distinct(F.when(F.col("_ok"), F.col(key))).alias("kept"))
    return per.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("rejected"), F.lit(0)).alias("entities_rejected"), F.coalesce(F.sum(F.when(F.col("kept") > max_entities, 1).otherwise(0)), F.lit(0)).alias("chunks_truncated"))
