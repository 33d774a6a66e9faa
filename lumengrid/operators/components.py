"""Connected components of a link table, by star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengrid.session import materialise


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node it reaches) of every node in links (a, b), except for the roots themselves.

    Alternates two star contractions, each of which hangs the neighbours of a node on the smallest of them, until nothing
    moves. Both sides of each join are tables of their own, so that AQE can split a hub's partition.
    """
    star = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        # larger neighbours go to the smallest neighbour
        star = materialise(star.select(F.col("b").alias("a"), F.col("a").alias("v")).join(low, "a").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        low = materialise(star.groupBy("a").agg(F.min("b").alias("m")), "low")
        hung = star.join(low, "a")
        star = materialise(hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "small")
        now = star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return star.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
