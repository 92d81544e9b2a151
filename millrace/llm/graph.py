"""Connected components by alternating large-star and small-star steps, all in DataFrame operations.

No step holds a node's neighbours together: minima are aggregated before the shuffle and written, and the edges of a hub, which all end
at its smallest node, are joined to them from a plain shuffle that Spark can split. Each round is written to the shared folder, so its
lineage ends there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v: long) -> (node, root) for every node but the smallest of each component, which is the root.

    Loops, repeated and reversed edges don't matter; null ends are no edges; no edges give no rows.
    """
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, before = common.cut(e, "edges"), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        below = common.cut(e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), "m"), "below")
        large = e.join(below, F.col("v") == F.col("node"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, common.cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        common.discard(old, below)
