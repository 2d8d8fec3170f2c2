"""Connected components of a graph of links, by large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(arcs: DataFrame, large: bool) -> DataFrame:
    """Links the neighbours ``v`` of each ``u`` to the least of them and u; of the larger neighbours only, if ``large``.

    The least one is a pre-aggregated minimum, and the join back splits skewed nodes.
    """
    least = arcs.groupBy("u").agg(F.min("v").alias("_v")).select(F.col("u").alias("_u"), F.least("u", "_v").alias("m"))
    met = arcs.join(least, arcs["u"] == least["_u"])
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.where("v < u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.select(F.col("_u").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (u, v: long); a component's number is its least node.

    Edges may repeat, go either way or be loops. Nodes without an edge to another node are not in the result.
    Rounds end when the edges no longer change; each leaves at most as many edges as it found.
    """
    arcs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    arcs = cut(arcs)
    state = _state(arcs)
    while state[0]:
        arcs = cut(_star(_star(_both(arcs), True), False))
        now = _state(arcs)
        if now == state:
            break
        state = now
    nodes = arcs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(arcs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
