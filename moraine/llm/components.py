"""Connected components by alternating large and small stars, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, few, keep, loose


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the least node of its component) of every node of edges (u long, v long).

    Null ends and loops are dropped, repeated edges count once; no edges, no
    rows. A round is two joins and a table in the shared folder.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = keep(few(e), "edges")
    mark = None
    for _ in range(most_rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        mark = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(loose(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))  # every larger neighbour to the least one
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(loose(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before, e = e, keep(few(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), "edges")
        drop(before)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
