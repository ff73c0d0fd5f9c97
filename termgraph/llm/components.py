"""Connected components of an edge table, as joins that converge in a few rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termgraph.storage import materialise


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least node of each node's component, for edges a-b over 0..n-1 (numpy, one machine)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def connected(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root): the least node of the component of each node that has an edge.

    Every round takes the least label among the neighbours and then the label of that label, so the
    rounds grow with the logarithm of a component's width.  Each round's table is written to the shared
    folder, which cuts the lineage and survives the loss of executors."""
    sym = materialise(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a))).where("x <> y").distinct(), "edges")
    labels = materialise(sym.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("root")), "labels")
    for _ in range(max_rounds):
        near = sym.join(labels, sym.y == labels.node).groupBy("x").agg(F.min("root").alias("near"))
        step = labels.join(near, labels.node == near.x).select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("node").alias("up"), F.col("root").alias("up_root"))
        jumped = materialise(step.join(up, step.root == up.up, "left").select("node", "was", F.least("root", F.coalesce("up_root", "root")).alias("root")), "labels")
        labels = jumped.select("node", "root")
        if jumped.where("root <> was").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
