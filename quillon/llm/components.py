"""Connected components of an edge table: local union-find first, then alternating large and small stars.

Defined results: repeated edges, and edges both ways, count once; an edge of a node to itself says nothing; an empty table
gives an empty result; edges with a null are the caller's to leave out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import drop, written

#: Nodes a local union-find holds before it emits its forest; that many forest edges or fewer are finished in one task.
LOCAL = 400_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the edges of a partition by (node, smallest node of its tree); holds LOCAL edges at most."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def flush() -> pa.RecordBatch:
        pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
        parent.clear()
        u, v = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) >= LOCAL:
            yield flush()
    yield flush()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: long) but the smallest of each component, which names it.

    Every round is written to the shared folder; the rounds grow with the logarithm of a component's diameter. A forest
    whose counted edges fit one bounded union-find is finished there; star rounds do the rest at any size.
    """
    now = written(edges.mapInArrow(_forest, "u long, v long"), "forest")
    while now.count() > LOCAL // 2:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select("u", F.col("m").alias("v")).union(joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        small = written(small, "small")
        drop(now)
        drop(large)
        now = small
        parents = now.groupBy("u").agg(F.count("*").alias("n"))
        if parents.where("n > 1").isEmpty() and now.join(parents.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return written(now.coalesce(1).mapInArrow(_forest, "node long, component long"), "forest")
