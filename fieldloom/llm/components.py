"""Connected components of a graph given as an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node that can be reached.

    Alternating large-star and small-star steps; each ends in a table in the shared folder. Every step
    is an aggregate and a join back, so a node with very many edges is pre-aggregated and its join split.
    """
    now = cut_lineage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.hash("u", "v").cast("bigint")), F.lit(0)),
                       F.coalesce(F.sum(F.col("v") % 1_000_003), F.lit(0))).first()
        if mark == before or mark[0] == 0:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b"))))
        small = large.join(lower, "u").select(pairs.alias("p")).select(F.col("p.a").alias("u"), F.col("p.b").alias("v"))
        now = cut_lineage(small.where("u <> v").distinct())
