"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import give_back, table

#: Edges that a task contracts together.
EDGES_AT_ONCE = 500_000


class Forest:
    """The least index that links reach, for indices below n; a batch of links at a time."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            if (x == y).all():
                return
            low = np.minimum(x, y)
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
            while (root[root] != root).any():
                root[:] = root[root]


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of some edges, each node but the least of its component, and that least one: as many edges as a spanning forest has."""
    nodes, of = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = Forest(len(nodes))
    forest.link(of[: len(a)], of[len(a) :])
    some = np.flatnonzero(forest.root != np.arange(len(nodes)))
    return nodes[some], nodes[forest.root[some]]


def _contracted(batches):
    held, n = [], 0

    def flush():
        a, b = contracted(*(np.concatenate([h[k] for h in held]) for k in range(2)))
        return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    for batch in batches:
        held.append([batch.column(k).to_numpy() for k in range(2)])
        n += batch.num_rows
        if n >= EDGES_AT_ONCE:
            yield flush()
            held, n = [], 0
    if n:
        yield flush()
    give_back()


def _stamp(edges: DataFrame) -> tuple:
    """Changes if the set of edges does."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Gives id, root for every id in an edge between two different ids; root is the component's least id.

    Each task contracts the EDGES_AT_ONCE edges that it takes to a spanning forest, so there are never more of them than nodes in its share,
    however many links a group has. While they fill more than one task, alternating large and small stars (Kiveris and others, 2014) hang each node's
    neighbours on the least of them and the tasks contract again: a step is an aggregation to a minimum, which starts inside the tasks, and inner joins on a
    node, which Spark's skew join splits where a node has many neighbours. Each round is written to the shared folder. Nothing is collected but the
    edge set's count and checksum. No edges: no rows.
    """
    e, before = table(edges.select("a", "b").filter(F.col("a") != F.col("b")), "edges"), None
    parts = _tasks(e.count())
    while True:
        e = table(e.coalesce(parts).mapInArrow(_contracted, "a long, b long"), "forest")
        if parts == 1:  # one task has seen all edges
            break
        if (now := _stamp(e)) == before:
            break
        before, parts = now, _tasks(now[0])
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = table(small.distinct(), "edges")
    roots = e.select("a", "b")
    return roots.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def _tasks(edges: int) -> int:
    return max(1, -(-edges // EDGES_AT_ONCE))


def joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """The components (id, root) after further edges (a, b): only the edges between components found before are looked at."""
    of = lambda end: roots.select(F.col("id").alias(end), F.col("root").alias(f"{end}_root"))
    between = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    merged = table(components(between), "merged").select(F.col("id").alias("old"), F.col("root").alias("new"))
    moved = roots.join(merged, F.col("root") == F.col("old"), "left").select("id", F.coalesce("new", "root").alias("root"))
    return moved.unionByName(merged.select(F.col("old").alias("id"), F.col("new").alias("root")).join(roots.select("id"), "id", "left_anti"))
