"""Connected components of an edge table, distributed: nothing of the graph reaches the driver but counts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins what a task holds in bounded pieces: each piece of edges becomes stars around its smallest nodes."""
    def emit(parent: dict) -> pa.RecordBatch:
        def root(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x
        pairs = [(x, r) for x in parent if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], kind), pa.array([b for _, b in pairs], kind)], names=["u", "v"])

    parent: dict = {}
    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for x in (a, b):
                parent.setdefault(x, x)
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            while parent[b] != b:
                parent[b] = b = parent[parent[b]]
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 200_000:
            yield emit(parent)
            parent = {}
    if parent:
        yield emit(parent)


def connected_components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """node, component (the smallest node reachable) for each node that an edge between two different nodes touches.

    Large-star and small-star steps in turn until the edges are stars; each round is stored in the shared folder.
    Edges with a null end are no edges; repeated edges and loops change nothing.
    """
    kind = edges.schema[u].dataType.simpleString()
    pairs = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v")
    now = stored(pairs.mapInArrow(_local_stars, f"u {kind}, v {kind}").distinct(), "edges")
    while True:
        # Large star: the larger neighbours of a node move to its smallest neighbour (or itself).
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the smaller neighbours of a node, and the node, move to the smallest of them.
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(moved.union(small).distinct(), "edges")
        # Stars: no node is both a leaf of one and the centre of another, and each leaf has one centre.
        leaves = after.groupBy("u").agg(F.count("*").alias("n"))
        bad = leaves.where("n > 1").select("u").union(after.select("v").distinct().join(leaves.select(F.col("u").alias("v")), "v", "left_semi")).limit(1).count()
        dropped(now)
        now = after
        if not bad:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
