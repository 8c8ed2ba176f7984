"""Connected components of an undirected graph that lives in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.storage import materialise


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is the smallest node that can be reached.

    Alternating large-star and small-star steps: each round links every neighbour of a node to the smallest node
    around it, so that paths shrink by a factor and long chains need a logarithmic number of rounds. Minima are taken
    by an aggregate with a map-side part and joined back, never over a collected neighbour list, so that a hub is no
    task's burden. Each round is written to the shared folder, which bounds the lineage. The driver sees counts only.

    Self loops, repeated edges and either direction are allowed; edges with a null end are ignored. An empty graph has
    no components. Raises if ``max_rounds`` do not suffice.
    """
    a, b = F.col(src), F.col(dst)
    links = edges.where(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    given = materialise(links, "links")
    loops = given.where("u = v").select(F.col("u").alias("node"))
    now = given.where("u != v")
    before = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # Small star: all smaller neighbours of u, and u itself, are linked to the smallest of them.
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
            single = loops.join(now.select(F.col("u").alias("node")), "node", "left_anti").select("node", F.col("node").alias("component"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).union(single).distinct()
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
