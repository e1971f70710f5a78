"""Connected components of a link table, by alternating large and small stars.

Every round replaces the links by links to smaller nodes, two joins over what
is left of them, and is written to the shared folder. The number of rounds grows
with the logarithm of the longest path. Nothing but counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every end of a link. links: x, y; nulls and loops are ignored."""
    found = shared.table(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("x <> y").distinct(), "links")
    mark = None
    while True:
        both = found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(low, "u")
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        last, found = found, shared.table(small, "links")
        shared.drop(last)
        now = tuple(found.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            break
        mark = now
    roots = found.select(F.col("v").alias("node")).distinct()
    return found.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
