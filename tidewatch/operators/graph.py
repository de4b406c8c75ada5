"""Graph operators shared by near-duplicate clustering and entity graphs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


#: Edges that one task joins into a forest; more are contracted in rounds.
SMALL = 500_000


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, component) of all edges (u, v): each node points to a smaller one of its tree, paths are halved on the way."""
    up: dict = {}
    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            ends = []
            for x in (u, v):
                up.setdefault(x, x)
                while up[x] != x:
                    up[x] = x = up[up[x]]
                ends.append(x)
            up[max(ends)] = min(ends)
    nodes, tops = list(up), []
    for x in nodes:
        while up[x] != x:
            up[x] = x = up[up[x]]
        tops.append(x)
    yield pd.DataFrame({"node": nodes, "component": tops})


def connected_components(edges: DataFrame, a: str, b: str, small: int = SMALL) -> DataFrame:
    """Components of an undirected graph: (node, component), component = smallest node.

    Up to ``small`` edges are joined in one task. More of them are contracted in rounds:
    large-star and small-star alternate until no edge changes; every step is a
    min-aggregation and an equi-join, so a hub is combined map-side and its join is
    split by AQE. Only nodes with at least one edge to another node are returned. The
    driver sees a count and a checksum per round, never edges.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = cut(e)
    before = _state(e)
    if before[0] <= small:
        kind = e.schema["u"].dataType.simpleString()
        return e.coalesce(1).mapInPandas(_forest, f"node {kind}, component {kind}")
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        after = _state(e)
        if after == before:
            break
        before = after
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
