"""Connected components of a graph that no single task needs to hold."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def forest(edges: Iterator[tuple]) -> dict:
    """Union-find over edges: each vertex's root, the least vertex of its tree."""
    up: dict = {}

    def root(x):
        r = x
        while up.setdefault(r, r) != r:
            r = up[r]
        while up[x] != r:
            up[x], x = r, up[x]
        return r

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kind = batch.schema.field("a").type
        tree = forest(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True))
        links = [(x, r) for x, r in tree.items() if x != r]
        yield pa.record_batch([pa.array([x for x, _ in links], kind), pa.array([r for _, r in links], kind)], ["a", "b"])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """From edges a, b (of one orderable type) to vertex and root, the least vertex of its component.

    Vertices without an edge to another are not in the result. Alternates large and small stars: each vertex links its
    larger neighbours, then its smaller ones, to the least vertex near it, until only stars are left. The least is found by
    an aggregate and given back by a join with one row for each vertex, so that hubs are spread over tasks.
    """
    kind = edges.schema["a"].dataType.simpleString()
    now = scratch.keep(edges.where("a <> b").mapInArrow(_thinned, f"a {kind}, b {kind}").distinct())
    while True:
        ends = now.select(F.col("a").alias("v"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(now.select("b", F.lit(0), F.lit(1)))
        loose = ends.groupBy("v").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down > 0 and up > 0)")
        if not loose.take(1):  # every vertex points at one root, and no root points on
            return now.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.keep(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = scratch.keep(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        scratch.drop(now, large)
        now = nxt
