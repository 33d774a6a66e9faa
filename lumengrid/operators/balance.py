"""Balanced split of a volume: nodes halved again and again at the exact median of one axis after the other.

A median is found by counting: rows of a node between two bounds are counted in bins, the bin that holds the median gives the
next bounds, and so on until few rows are between them. So a node may have any number of rows, in any distribution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumengrid.session import materialise

AXES = ("x", "y", "z")
#: Bins that rows between two bounds are counted in, and rows between them that are sorted in the end.
BINS, LIMIT = 1024, 4096


def narrowed(rows: DataFrame, bounds: DataFrame, limit: int) -> DataFrame:
    """bounds (node, k, before, inside, lo, hi) drawn in around the k-th of each node's rows (node, v), until they hold at most limit rows or one value."""
    while True:
        wide = bounds.where((F.col("inside") > limit) & (F.col("lo") < F.col("hi")))
        if wide.isEmpty():
            return bounds
        near = rows.join(F.broadcast(wide), "node").where(F.col("v").between(F.col("lo"), F.col("hi")))  # a row of bounds for each node
        at = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
        bins = near.groupBy("node", "k", "before", at.alias("bin")).agg(F.count("*").alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.col("before") + F.sum("inside").over(Window.partitionBy("node").orderBy("bin"))
        held = bins.withColumn("upto", upto).where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("inside") < F.col("k")))
        drawn = held.select("node", "k", (F.col("upto") - F.col("inside")).alias("before"), "inside", "lo", "hi")
        bounds = materialise(bounds.join(F.broadcast(wide.select("node")), "node", "left_anti").unionByName(drawn), "bounds")


def last_of_lower_half(rows: DataFrame, axis: str, limit: int) -> DataFrame:
    """node, v and p: the value on an axis and the pid of the row in the middle of each node, in the order of both."""
    half = F.ceil(F.count("*") / 2).cast("bigint")
    start = lambda r, v: r.groupBy("node").agg(half.alias("k"), F.lit(0).cast("bigint").alias("before"), F.count("*").alias("inside"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    bounds = materialise(narrowed(rows.select("node", F.col(axis).alias("v")), materialise(start(rows, axis), "bounds"), limit), "bounds")
    few, same = bounds.where(F.col("inside") <= limit), bounds.where(F.col("inside") > limit)
    place = Window.partitionBy("node").orderBy(axis, "pid")
    inside = rows.join(F.broadcast(few), "node").where(F.col(axis).between(F.col("lo"), F.col("hi")))
    out = inside.withColumn("at", F.col("before") + F.row_number().over(place)).where("at = k").select("node", F.col(axis).alias("v"), F.col("pid").alias("p"))
    if same.isEmpty():
        return out
    # very many rows with the median's value: the same again, by pid
    tied = rows.join(F.broadcast(same.select("node", "k", "before", "lo")), "node").where(F.col(axis) == F.col("lo"))
    by_pid = tied.groupBy("node", "k", "before", F.col("lo").alias("value")).agg(F.count("*").alias("inside"), F.min("pid").alias("lo"), F.max("pid").alias("hi"))
    found = narrowed(tied.select("node", F.col("pid").alias("v")), materialise(by_pid.drop("value"), "bounds"), limit)
    near = tied.drop("k", "before", "lo").join(F.broadcast(found), "node").where(F.col("pid").between(F.col("lo"), F.col("hi")))
    return out.unionByName(near.withColumn("at", F.col("before") + F.row_number().over(Window.partitionBy("node").orderBy("pid"))).where("at = k").select("node", F.col(axis).alias("v"), F.col("pid").alias("p")))


def balanced(points: DataFrame, levels: int, limit: int = LIMIT) -> DataFrame:
    """points with node, from 0 to 2**levels - 1: halves at the median of x, their halves at that of y, then z, x and so on.

    Of an odd number of rows the lower half has one more. Equal values go by pid.
    """
    rows = points.withColumn("node", F.lit(0))
    for level in range(levels):
        axis = AXES[level % 3]
        cut = materialise(last_of_lower_half(rows.select("node", "pid", axis), axis, limit), "medians")
        upper = (F.col(axis) > F.col("v")) | ((F.col(axis) == F.col("v")) & (F.col("pid") > F.col("p")))
        rows = materialise(rows.join(F.broadcast(cut), "node").withColumn("node", 2 * F.col("node") + upper.cast("int")).drop("v", "p"), "halves")
    return rows


def node_bounds(rows: DataFrame) -> DataFrame:
    """node, n, and the least and largest value on each axis of a node's rows."""
    return rows.groupBy("node").agg(F.count("*").alias("n"), *(f(a).alias(f"{name}_{a}") for a in AXES for name, f in (("low", F.min), ("high", F.max))))
