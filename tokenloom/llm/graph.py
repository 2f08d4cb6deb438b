"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import stage_table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over edges (u, v), u > v.

    The minimum of a node's neighbours comes from an aggregation and is joined back, so that a
    node with very many neighbours is combined before the shuffle and split by the skew join.
    """
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = near.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(joined.where("m < u").select("u", F.col("m").alias("v")))
    else:
        out = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """(node, component) for every node of `links`; a component is named by its smallest node.

    Alternates large-star and small-star steps until the edges no longer change; each round is
    written to the scratch folder. Null ends and self links are left out; repeated links count once.
    """
    edges = links.where(f"{a} is not null and {b} is not null and {a} != {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = stage_table(edges, "edges")
    mark = None
    for _ in range(rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        edges = stage_table(_star(_star(edges, True), False), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
