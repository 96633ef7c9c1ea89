"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import drop_stage, stage


def _with_min(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the least of u and its neighbours; the aggregate combines before it shuffles, so a hub costs little."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` undirected -> ``(node, root)`` with root the least node of the component, for every node with an edge.

    Alternating large-star and small-star rounds; each round is written to the shared folder, so the lineage
    stays short, and the rounds grow with the logarithm of the longest chain. Null ends and loops are dropped,
    repeated edges count once; no edges give no rows.
    """
    now = stage(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _with_min(large)
        small = small.select("v", "m").union(small.select("u", "m")).toDF("u", "v").where("u <> v").distinct()
        after = stage(small, "edges")
        drop_stage(now)
        now = after
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
