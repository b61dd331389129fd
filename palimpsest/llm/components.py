"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import Workspace


def components(links: DataFrame, space: Workspace) -> DataFrame:
    """(id, component) for every end of a link (a, b); the component is its smallest id.

    Alternating large-star and small-star steps: each replaces a vertex's links by links
    to the smallest of its neighbours, so every component ends as one star.  The steps
    are groupings and joins of links, whose number never grows; each is written.
    """
    smaller, larger = F.least("a", "b").alias("to"), F.greatest("a", "b").alias("id")
    edges = space.written(links.filter(F.col("a") != F.col("b")).select(larger, smaller).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("to").alias("id"), F.col("id").alias("to")))
        # Written, so that the links of a hub can be split in the join.
        least = space.written(both.groupBy("id").agg(F.least(F.min("to"), F.col("id")).alias("m")))
        large = both.join(least, "id").filter(F.col("to") > F.col("id")).select(F.col("to").alias("id"), F.col("m").alias("to"))
        large = large.filter(F.col("id") != F.col("to")).distinct()
        least = large.groupBy("id").agg(F.min("to").alias("m"))
        small = large.join(least, "id")
        edges = space.written(
            small.filter(F.col("to") != F.col("m")).select(F.col("to").alias("id"), F.col("m").alias("to"))
            .union(least.select("id", F.col("m").alias("to")))
            .distinct()
        )
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("id", "to").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select("id", F.col("to").alias("component")).union(
        edges.select(F.col("to").alias("id"), F.col("to").alias("component")).distinct()
    )
