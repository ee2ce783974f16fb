"""Connected components of a graph of links, by repeated contraction.

In each round every node moves to the neighbour (or itself) with the least hash, hashed anew each round;
links between nodes that met vanish, the others link what their ends moved to. A constant share of the
nodes that still have links disappears in each round, whatever the shape of the graph. Before each round
each partition replaces its links by a spanning forest of stars. Nothing is collected: labels and links
are tables in the shared folder, and the hot node of a star is reduced by partial aggregation.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.storage import materialize, release_table


class Forest:
    """Union-find over integers; the root of a set is its smallest member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (p := self.parent.get(root, root)) != root:
            root = p
        while x != root:
            self.parent[x], x = root, self.parent.get(x, x)
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def stars(self) -> Iterator[tuple[int, int]]:
        for x in list(self.parent):
            if (root := self.find(x)) != x:
                yield x, root


BATCH = 1 << 16


def _stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces links, a bounded number at a time, by stars that connect the same nodes."""
    forest = Forest()

    def flush() -> pa.RecordBatch:
        pairs = np.array(list(forest.stars()), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        if len(forest.parent) > BATCH:
            yield flush()
            forest = Forest()
    yield flush()


def connected_components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """node, label (the least node reachable) for each node of links (a, b: long), a table in the shared
    folder. Links of a node with itself, repeated links and either direction are fine; rows with a null
    are skipped; no links give no rows.
    """
    both = lambda x: x.select("a", "b").unionByName(x.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(links.where("a is not null and b is not null").selectExpr("cast(a as long) a", "cast(b as long) b"), "links")
    nodes = both(edges).select(F.col("a").alias("node")).distinct()
    current = materialize(edges.where("a <> b").mapInArrow(_stars, "a long, b long").distinct(), "links")
    labels = materialize(nodes.withColumn("label", F.col("node")), "labels")
    release_table(edges)
    for i in range(rounds):
        if current.isEmpty():
            break
        seed = F.lit(i)
        moves = both(current).groupBy("a").agg(F.min(F.struct(F.xxhash64("b", seed).alias("h"), F.col("b").alias("to"))).alias("m"))
        moves = moves.select(F.col("a").alias("from"), F.when(F.xxhash64("a", seed) <= F.col("m.h"), F.col("a")).otherwise(F.col("m.to")).alias("to"))
        moves = materialize(moves, "moves")
        labels2 = materialize(labels.join(moves, labels.label == moves["from"], "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        left, right = moves.toDF("a", "a2"), moves.toDF("b", "b2")
        moved = current.join(left, "a").join(right, "b").select(F.col("a2").alias("a"), F.col("b2").alias("b")).where("a <> b")
        next_links = materialize(moved.mapInArrow(_stars, "a long, b long").distinct(), "links")
        for old in (labels, current, moves):
            release_table(old)
        labels, current = labels2, next_links
    else:
        raise RuntimeError(f"links remain after {rounds} rounds")
    least = materialize(labels.groupBy("label").agg(F.min("node").alias("least")), "least")
    out = materialize(labels.join(least, "label").select("node", F.col("least").alias("label")), "components")
    for old in (labels, current, least):
        release_table(old)
    return out
