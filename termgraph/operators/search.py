"""Search over the graph: closure of the hierarchy, instances, blended scores, neighbours, nearest vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termgraph.functions import text as T
from termgraph.operators.dedup import cosine
from termgraph.storage import materialise

BLOCK, TILE = 16_384, 2048  #: vectors of a block, of which a group holds two, and of a tile, which is computed at once


def closure(hierarchy: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(child, ancestor): one or more steps of (child, parent), cycles allowed.

    Paths double each round (a pair joined with all pairs), so the rounds grow with the logarithm of the depth."""
    base = hierarchy.select("child", F.col("parent").alias("ancestor")).where("child IS NOT NULL AND parent IS NOT NULL").distinct()
    reach = materialise(base, "closure")
    n = reach.count()
    for _ in range(max_rounds):
        further = reach.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("top"))
        reach = materialise(reach.unionByName(reach.join(further, "ancestor").select("child", F.col("top").alias("ancestor"))).distinct(), "closure")
        m = reach.count()
        if m == n:
            return reach
        n = m
    raise RuntimeError("the hierarchy is deeper than 2**max_rounds")


def class_instances(instances: DataFrame, hierarchy: DataFrame, transitive: bool = True) -> DataFrame:
    """(class, entity): direct instances, and through the hierarchy those of every class below."""
    own = instances.select("class", "entity").distinct()
    if not transitive:
        return own
    up = closure(hierarchy)
    return own.unionByName(own.join(up, own["class"] == up.child).select(F.col("ancestor").alias("class"), "entity")).distinct()


def instances_pattern(transitive: bool = True) -> str:
    """The same as a SPARQL group pattern."""
    below = [("?sub", "rdfs:subClassOf*", "?c")] if transitive else []
    own = [("?i", "rdf:type", "?sub" if transitive else "?c"), ("?i", "rdfs:label", "?il")]
    return " . ".join(" ".join(t) for t in below + own)


def blend(vscore: Column | str, knorm: Column | str, vmin: Column | str, vrng: Column | str, w_vec=0.7, w_key=0.3) -> Column:
    """Vector score, normalised, and keyword score; where the vector score is missing or has no range, the keyword score for both."""
    v, k = T.lit_or_col(vscore), T.lit_or_col(knorm)
    normal = (v.cast("double") - T.lit_or_col(vmin)) / F.nullif(T.lit_or_col(vrng).cast("double"), F.lit(0.0))
    return w_vec * F.coalesce(normal, k) + w_key * k


def blended(scores: DataFrame, query: list[str]) -> DataFrame:
    """``scores`` (query keys, vscore, knorm) with ``score``; least score and range are those of the query's candidates."""
    w = Window.partitionBy(*query)
    return scores.withColumns({"_min": F.min("vscore").over(w), "_rng": F.max("vscore").over(w) - F.min("vscore").over(w)}).withColumn("score", blend("vscore", "knorm", "_min", "_rng")).drop("_min", "_rng")


def label_search(labels: DataFrame, words: str, limit: int = 10) -> DataFrame:
    """(label, score): labels that contain the words, or are like them, the best ``limit``."""
    low, w = F.lower("label"), F.lower(F.lit(words))
    longest = F.greatest(F.length(low), F.length(w))
    score = F.when(low == w, 1.0).when(F.contains(low, w), 0.9).otherwise(1 - F.levenshtein(low, w) / F.nullif(longest, F.lit(0)))
    return labels.select("label", score.alias("score")).orderBy(F.desc("score"), "label").limit(limit)


def neighbours(triples: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """(node, hop): nodes within ``hops`` steps of the seeds, in either direction, at their least distance."""
    both = triples.select(F.col("subject").alias("a"), F.col("object").alias("b")).unionByName(triples.select(F.col("object").alias("a"), F.col("subject").alias("b"))).distinct()
    seen = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    for h in range(1, hops + 1):
        new = seen.where(F.col("hop") == h - 1).join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        seen = materialise(seen.unionByName(new.withColumn("hop", F.lit(h))), "neighbours")
    return seen


def node(triples: DataFrame, name: str) -> DataFrame:
    """Every triple that the node is in."""
    return triples.where((F.col("subject") == name) | (F.col("object") == name))


def class_counts(instances: DataFrame) -> DataFrame:
    return instances.groupBy("class").agg(F.count_distinct("entity").alias("n"))


def _unit(vecs: pd.Series) -> np.ndarray:
    width = max((len(x) for x in vecs if x is not None), default=1)
    m = np.stack([np.asarray(x, np.float64) if x is not None else np.full(width, np.nan) for x in vecs])
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def nearest_of_every(vectors: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(q, id, similarity, place): ``nearest`` with every vector (id, vec) as a query."""
    return nearest(vectors.select(F.col("id").alias("q"), "vec"), vectors, k, block)


def _parts(n: int, block: int) -> int:
    """Blocks of ``n`` rows: as few as may be, but four keep the workers busy where there are as many tiles."""
    return max(1, -(-n // block), min(4, -(-n // min(block, TILE))))


def _blocks(a: DataFrame, b: DataFrame, block: int) -> tuple:
    """Both tables (their first column is the id, the second the vector) in blocks of about ``block`` rows, each block beside each of the other's.

    Every row goes to as many groups as the other table has blocks, so what is shuffled grows with the square of the rows over ``block``:
    blocks are large, and what a group computes at once are tiles (``_tiles``)."""
    na, nb = _parts(a.count(), block), _parts(b.count(), block)
    place = lambda d, n: F.expr(f"CAST(pmod(hash(`{d.columns[0]}`), {n}) AS INT)")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # own names on each side: columns of one table aren't told apart in a cogroup
    left = a.select(F.col(a.columns[0]).alias("q"), F.col(a.columns[1]).alias("qvec"), place(a, na).alias("qb"), every(nb).alias("vb"))
    right = b.select(F.col(b.columns[0]).alias("key"), F.col(b.columns[1]).alias("kvec"), every(na).alias("ob"), place(b, nb).alias("kb"))
    return left.groupBy("qb", "vb").cogroup(right.groupBy("ob", "kb"))


def _tiles(a: pd.DataFrame, b: pd.DataFrame, tile: int = TILE):
    """(rows of ``a``, [(keys, similarities of those rows and keys, six places), ...]): tiles of a pair of blocks, keys ascending."""
    keys = b["key"].to_numpy()
    right = [(keys[j : j + tile], _unit(b["kvec"].iloc[j : j + tile])) for j in range(0, len(b), tile)]
    for i in range(0, len(a), tile):
        left = _unit(a["qvec"].iloc[i : i + tile])
        yield a["q"].to_numpy()[i : i + tile], ((k, np.round(left @ m.T, 6)) for k, m in right)


def _best(q: np.ndarray, key: np.ndarray, s: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` highest of each row of ``s`` (rows ``q``, columns ``key``, ascending), ties by key."""
    least = min(k, len(key))
    row, col = np.nonzero(s >= np.partition(s, len(key) - least, axis=1)[:, len(key) - least, None])
    order = np.lexsort((col, -s[row, col], row))
    row, col = row[order], col[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < least
    row, col = row[first], col[first]
    return pd.DataFrame({"q": q[row], "id": key[col], "similarity": s[row, col]})


def links(vectors: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(id, links, least): for each vector (id, vec) that has any, the number of others whose cosine (six places) is ``threshold`` or more, and
    the least id among them; by products of blocks."""
    kind = vectors.schema["id"].dataType.simpleString()
    v = vectors.select("id", "vec")

    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "n": [], "least": []})
        b = b.sort_values("key", kind="stable", ignore_index=True)
        keys = b["key"].to_numpy()
        out = []
        for q, tiles in _tiles(a, b):
            n, least = np.zeros(len(q), np.int64), np.empty(len(q), b["key"].to_numpy().dtype)
            for keys, s in tiles:
                near = (s >= threshold) & (q[:, None] != keys[None])
                new = near.any(axis=1)
                first = new & (n == 0)  # keys ascend from tile to tile
                least[first] = keys[near.argmax(axis=1)[first]]
                n += near.sum(axis=1)
            out.append(pd.DataFrame({"id": q[n > 0], "n": n[n > 0], "least": least[n > 0]}))
        return pd.concat(out, ignore_index=True)

    found = _blocks(v, v, block).applyInPandas(count, f"id {kind}, n long, least {kind}")
    return found.groupBy("id").agg(F.sum("n").alias("links"), F.min("least").alias("least"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(q, id, similarity, place): the exact ``k`` nearest vectors (id, vec) of each query (q, vec) by cosine, ties by id, NULL last.

    Products of a block of queries and a block of vectors, tile by tile; each block leaves ``k`` rows a query, and a window takes the best of those."""
    types = queries.schema["q"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q": [], "id": [], "similarity": []})  # a block without vectors comes without columns
        b = b.sort_values("key", kind="stable", ignore_index=True)
        out = []
        for q, tiles in _tiles(a, b):
            found = []
            for keys, s in tiles:
                s[np.isnan(s)] = -np.inf  # NULL comes last
                found.append(_best(q, keys, s, k))
            every = pd.concat(found, ignore_index=True)  # k of each tile: each query's rows keep their place below
            row = np.concatenate([np.repeat(np.arange(len(q)), min(k, len(keys))) for keys in (b["key"].to_numpy()[j : j + TILE] for j in range(0, len(b), TILE))])
            order = np.lexsort((every["id"].to_numpy(), -every["similarity"].to_numpy(), row))
            row, every = row[order], every.iloc[order]
            out.append(every[np.arange(len(row)) - np.searchsorted(row, row) < k])
        return pd.concat(out, ignore_index=True)

    found = _blocks(queries.select("q", "vec"), vectors.select("id", "vec"), block).applyInPandas(best, f"q {types[0]}, id {types[1]}, similarity double")
    found = found.withColumn("similarity", F.when(F.col("similarity") >= -2, F.col("similarity")))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc_nulls_last("similarity"), "id"))).where(F.col("place") <= k)


def fetch(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids, "id", "left_semi")
