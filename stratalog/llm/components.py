"""Connected components of a link table, distributed: alternating large-star and small-star rounds over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import measured, stage, unstage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (u, v), both long: root is the component's smallest node. Nodes without links
    aren't in it. Hot nodes: minima combine on the map side, and joins on a node may be split."""
    pair = lambda a, b: (F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    # a sum of hashes that is found while a round is written tells whether it changed anything
    written = lambda edges: stage(edges.distinct(), True, F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    edges = written(links.where("u <> v").select(*pair(F.col("u"), F.col("v"))))
    while measured(edges)[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(nearest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, written(small.unionAll(nearest.select("u", F.col("m").alias("v"))))
        same = (before._measured, before._also) == (edges._measured, edges._also)
        unstage(before)
        if same:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
