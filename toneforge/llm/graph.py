"""Connected components over an edge table, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spool

#: Edges that one task takes to the end: some 100 MB of its memory.
AT_ONCE = 1 << 20


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """edges: (src, dst), longs, any order. Returns (node, label): label is the smallest node reachable. Nodes without an edge to another one don't appear; repeated edges and self-loops do no harm; an empty table gives an empty one.

    A round points every node to its least neighbour, if smaller, follows the pointers to their ends by doubling,
    and replaces each edge's ends by these; what is left are the edges between different ends, fewer than half as
    many nodes. So every edge is joined twice, and the rest of the work is on shrinking graphs. What a round
    yields is written to the shared folder, which cuts lineage. Once at most AT_ONCE edges are left, one task does the
    rest: each round is a dozen jobs, whose plans, threads and shuffles take the driver's memory. No side of a join has a bound, and files of equal
    labels are far smaller than their rows: hints keep all of them from the driver, at any size.
    """
    left = spool(edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), f"{tag}-edges")
    found: DataFrame | None = None
    for k in range(200):
        many = left.count()
        if found is not None and not many:
            return found
        if many <= AT_ONCE:
            ends = spool(_settled(left), f"{tag}-{k}-settled")
            return ends if found is None else spool(_onward(found, ends), f"{tag}-{k}-found")
        near = left.select(F.col("b").alias("node"), F.col("a").alias("to")).union(left.select("a", "a"))
        ends = _followed(spool(near.groupBy("node").agg(F.min("to").alias("to")), f"{tag}-{k}-near"), f"{tag}-{k}")
        if found is None:
            found = ends.select("node", F.col("to").alias("label"))
        else:
            found = spool(_onward(found, ends.withColumnRenamed("to", "label")), f"{tag}-{k}-found")
        one = left.join(ends.select(F.col("node").alias("a"), F.col("to").alias("x")).hint("merge"), "a")
        both = one.join(ends.select(F.col("node").alias("b"), F.col("to").alias("y")).hint("merge"), "b")
        left = spool(both.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{tag}-{k}-edges")
    raise RuntimeError("components did not settle")


def _onward(found: DataFrame, ends: DataFrame) -> DataFrame:
    """found with its labels' own labels, where ends has some. Both: (node, label)."""
    ends = ends.select(F.col("node").alias("at"), F.col("label").alias("to"))
    return found.join(ends.hint("merge"), F.col("label") == F.col("at"), "left").select("node", F.coalesce("to", "label").alias("label"))


def _settled(edges: DataFrame) -> DataFrame:
    """(node, label) of all components of edges (a, b), in one task: each round hangs the greater root of an edge on the lesser one, until no edge has two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [np.stack([c.to_numpy() for c in b.columns]) for b in batches]
        if not pairs:
            return
        nodes, at = np.unique(np.concatenate(pairs, axis=1), return_inverse=True)
        a, b = at.reshape(2, -1)
        root = np.arange(len(nodes))
        while len(a):
            x, y = root[a], root[b]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
        for k in range(0, len(nodes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + 100_000]), pa.array(nodes[root[k : k + 100_000]])], ["node", "label"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, label long")


def _followed(to: DataFrame, tag: str) -> DataFrame:
    """to: (node, to) with to <= node, every to a node too. Each node's last pointer."""
    for k in range(200):
        step = to.select(F.col("node").alias("to"), F.col("to").alias("next"))
        after = spool(to.join(step.hint("merge"), "to").select("node", "to", "next"), f"{tag}-jump{k}")
        to = after.select("node", F.col("next").alias("to"))
        if after.where("to <> next").isEmpty():
            return to
    raise RuntimeError("pointers did not settle")
