"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.workspace import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node that can be reached); nodes without links are left out.

    Alternates two steps: each node hands the least node it knows to its larger neighbours, then to
    its smaller ones. Both keep the components and shorten the paths, so the number of rounds grows
    with the logarithm of their length, and the links left are one for each node. Every aggregate is
    a minimum with partial results before the shuffle; a node with many links is never gathered.
    Each round is written to the shared folder; only its number of changes comes to the driver.
    """
    edges = stored(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "links")
    while True:
        large = stored(_star(edges, larger=True), "links")
        small = stored(_star(large, larger=False), "links")
        if _same(edges, small):
            return small.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
                small.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
            )
        edges = small


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Links of each node's larger (or smaller) neighbours to the least node it knows."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not larger:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if larger:
        return joined.where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
    own = least.select(F.col("m").alias("u"), F.col("u").alias("v"))
    return joined.select(F.col("m").alias("u"), "v").unionByName(own).where("u <> v").distinct()


def _same(one: DataFrame, two: DataFrame) -> bool:
    count = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(count(one)) == tuple(count(two))
