"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b") % 65_521))
    return tuple(row.first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node on an edge of ``edges(a, b)``: the smallest node that
    can be reached.

    Alternates two steps that keep components as they are: each node ties its larger neighbours
    to the smallest node it sees, then its smaller ones, until every component is a star around
    its smallest node. That takes a number of rounds that grows with the logarithm of the nodes.
    Minima are partial aggregates, and a node with very many edges meets a side that has it once,
    so its rows can be dealt out. Rows with a null end are no edges; loops and repeated edges
    change nothing.
    """
    a, b = F.col("a"), F.col("b")
    edges = stored(
        edges.filter(a != b)
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct(),
        "edges",
    )
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.join(least, "a")
            .filter(b > a)
            .select(b.alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        large = stored(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        edges = stored(small.unionByName(least.withColumnRenamed("m", "b")).distinct(), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    members = edges.select(a.alias("node"), b.alias("component"))
    return members.unionByName(edges.select(b, b).distinct().toDF("node", "component"))
