"""Connected components of a graph given by its edges, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envtally.llm.storage import written


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges (u, v)``; component is its smallest node.

    Alternating stars: the large star links every larger neighbour of a node to its smallest
    neighbour, the small star does so with the smaller ones. Both keep the components; when
    nothing changes any more, every node hangs on its smallest one. A hub never gathers its
    neighbours in one row: the smallest one is a partial aggregate, and the join back is one
    that adaptive execution splits. Each round is checkpointed. Loops and repeated edges are
    allowed; without edges the result is empty.
    """
    edges = edges.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).where("u != v").distinct()
    edges, state = _counted(edges)
    while state[0]:
        edges, new_state = _counted(_small_star(_large_star(edges)))
        if new_state == state:
            break
        state = new_state
    hanging = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return hanging.unionByName(roots)


def _counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    edges = written(edges)
    mark = F.xxhash64("u", "v")
    row = edges.agg(
        F.count(F.lit(1)), F.sum(mark.cast("decimal(38,0)")), F.bit_xor(mark)
    ).first()
    return edges, tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    ).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
