"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tierlens.llm.common import written


def _with_smallest(pairs: DataFrame) -> DataFrame:
    """(node, other) with the smallest of node and its others; the minimum is taken map-side, so a hub is no single task's group."""
    smallest = pairs.groupBy("node").agg(F.min("other").alias("low")).withColumn("low", F.least("low", "node"))
    return pairs.join(smallest, "node")


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "other").cast("decimal(20,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (two columns of one orderable type); root is the smallest node of its component.

    Alternates the large-star and small-star steps: each hangs the neighbours
    of every node on its smallest neighbour, first those above the node, then
    those below.  The table of edges never grows, the number of rounds follows
    the logarithm of the longest path, and each round is a written table.
    Loops, repeated edges and rows with a null are ignored; no edges give no rows.
    """
    a, b = edges.columns
    current = written(
        edges.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("other"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("node") != F.col("other")))
        .distinct(),
        "edges",
    )
    before = _signature(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("other").alias("node"), F.col("node").alias("other")))
        large = (
            _with_smallest(both).where(F.col("other") > F.col("node"))
            .select(F.col("other").alias("node"), F.col("low").alias("other")).distinct()
        )
        hung = _with_smallest(large)
        small = (
            hung.where(F.col("other") != F.col("low")).select(F.col("other").alias("node"), F.col("low").alias("other"))
            .unionByName(hung.select("node", F.col("low").alias("other"))).distinct()
        )
        current = written(small, "edges")
        after = _signature(current)
        if after == before:
            break
        before = after
    roots = current.select("other").distinct()
    return current.select("node", F.col("other").alias("root")).unionByName(
        roots.select(F.col("other").alias("node"), F.col("other").alias("root"))
    )
