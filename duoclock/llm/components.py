"""Connected components by alternating large-star and small-star steps, each a few group-bys and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _large_star(edges: DataFrame, tasks: int | None) -> DataFrame:
    """Each node's greater neighbours go to the least of its neighbours and itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # stored, so that the partition of a node with very many neighbours can be split in the join
    least = staged(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least", tasks)
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, tasks: int | None) -> DataFrame:
    """Each node and its smaller neighbours go to the least of those."""
    least = staged(edges.groupBy("u").agg(F.min("v").alias("m")), "least", tasks)
    rest = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v"))).distinct()


def _summary(edges: DataFrame) -> tuple:
    """Number and checksums of the edges, from a scan."""
    key = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(key), F.sum(key.bitwiseAND(F.lit((1 << 32) - 1)))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", tasks: int | None = None) -> DataFrame:
    """(node, component) for each node of the undirected edges that isn't its component's least node.

    Null ends, loops and repeated edges are ignored. Steps go on until one changes nothing.
    tasks: that so many can write the table of edges.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} <> {b}").distinct()
    now = staged(pairs, "edges", tasks)
    before = _summary(now)
    while before[0]:
        # a large step keeps the ties of what is joined already, as each node holds on to its group's least node
        now = staged(_small_star(staged(_large_star(now, tasks), "edges", tasks), tasks), "edges", tasks)
        after = _summary(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
