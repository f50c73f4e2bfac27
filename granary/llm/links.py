"""Connected components of links, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: larger neighbours go to the least of the closed neighbourhood; small star: the smaller ones and itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).hint("merge")
        moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m")).hint("merge")
        moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def connected_components(links: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(id, group) for every id in a link; ``group`` is the least id reached. Lineage is cut after every round."""
    edges = cut_lineage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(rounds):
        edges = cut_lineage(_star(_star(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("group"))
    return found.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("group")).distinct())
