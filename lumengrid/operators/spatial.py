"""Spatial joins as equi joins on grid cells: densities of neighbours, links within a distance, members of spheres."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengrid.functions.kernels import norm2, spline, triangle
from lumengrid.operators.celltree import nearest

__all__ = ["around", "cells", "links", "mark_members", "nearest", "scatter_density", "smoothing_length", "sphere_members", "witnesses"]

AXES = ("x", "y", "z")
CELL = ["cx", "cy", "cz"]


def cells(edge: float, prefix: str = "c") -> list[Column]:
    return [F.floor(F.col(a) / F.lit(edge)).cast("bigint").alias(f"{prefix}{a}") for a in AXES]


def around(df: DataFrame, edge: float, reach: int = 1) -> DataFrame:
    """Every row once for each cell at most reach cells away on each axis."""
    out = df.select("*", *cells(edge, "_h"))
    for a in AXES:
        out = out.withColumn(f"c{a}", F.explode(F.sequence(F.col(f"_h{a}") - reach, F.col(f"_h{a}") + reach)))
    return out.drop(*(f"_h{a}" for a in AXES))


def _positive(rk: Column) -> Column:
    return F.when(rk > 0, rk).otherwise(F.raise_error(F.lit("coincident points: smoothing length 0")).cast("double"))


def smoothing_length(pairs: DataFrame) -> DataFrame:
    """pid and rk, the distance to the k-th neighbour; raises if it is 0."""
    return pairs.where("rn = 1").select("pid", _positive(F.col("rk")).alias("rk"))


def scatter_density(pairs: DataFrame, k: int = 33, kernel: str = "triangle") -> DataFrame:
    """pid, rk and dens: every row spreads a unit mass over its neighbours but the farthest; rows nobody reaches get 0.

    A pair gives its weight to nid, and a row's first pair its rk to pid, so that one aggregation has both.
    """
    h = _positive(F.col("rk"))
    w = triangle(F.col("dx"), F.col("dy"), F.col("dz"), h) if kernel == "triangle" else spline(F.col("d2"), h)
    given = F.array(F.struct(F.col("nid").alias("pid"), F.when(F.col("rn") < k, w).otherwise(0.0).alias("w"), F.lit(None).cast("double").alias("rk")))
    own = F.array(F.struct("pid", F.lit(0.0).alias("w"), h.alias("rk")))
    flat = pairs.select(F.explode(F.when(F.col("rn") == 1, F.concat(given, own)).otherwise(given)).alias("x")).select("x.*")
    return flat.groupBy("pid").agg(F.max("rk").alias("rk"), F.sum("w").alias("dens"))


def links(points: DataFrame, length: float) -> DataFrame:
    """Pairs a < b at most length apart."""
    left = around(points.select(F.col("pid").alias("a"), *AXES), length)
    right = points.select(F.col("pid").alias("b"), *(F.col(q).alias(f"n{q}") for q in AXES), *cells(length))
    near = left.join(right, CELL).where("a < b")
    return near.where(norm2(*(F.col(a) - F.col(f"n{a}") for a in AXES)) <= length * length).select("a", "b")


def witnesses(points: DataFrame, length: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs a < b at most length apart, of rows with the same keys, that connect the same rows as all such pairs.

    Rows of a cell whose diagonal is below length are friends: each is linked to the smallest of them. Of each two cells
    within reach one pair is kept, so a crowd leaves as many pairs as it has rows, not their square.
    """
    edge = length / math.sqrt(3.0) * (1 - 1e-9)
    here = [*keys, *CELL]
    own = points.select(*keys, "pid", *AXES, *cells(edge))
    named = own.groupBy(*here).agg(F.min("pid").alias("a"), F.max("pid").alias("z"))
    inside = own.join(named.where("a < z"), here).where("pid > a").select("a", F.col("pid").alias("b"))
    # half of the cells around, so that two cells meet once; cells are matched before their rows
    steps = [(i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3) if (i, j, k) > (0, 0, 0)]
    other = [*keys, *(f"o{a}" for a in AXES)]
    moved = named.select(*here, F.explode(F.array(*(F.struct(*(F.lit(x).alias(f"s{a}") for x, a in zip(s, AXES, strict=True))) for s in steps))).alias("s"))
    meet = moved.select(*here, *((F.col(f"c{a}") + F.col(f"s.s{a}")).alias(f"o{a}") for a in AXES)).join(named.select(*keys, *(F.col(f"c{a}").alias(f"o{a}") for a in AXES)), other)
    right = own.select(*keys, F.col("pid").alias("q"), *(F.col(a).alias(f"q{a}") for a in AXES), *(F.col(f"c{a}").alias(f"o{a}") for a in AXES))
    near = own.join(meet, here).join(right, other).where(norm2(*(F.col(a) - F.col(f"q{a}") for a in AXES)) <= length * length)
    first = near.groupBy(*here, *(f"o{a}" for a in AXES)).agg(F.min(F.struct(F.least("pid", "q").alias("a"), F.greatest("pid", "q").alias("b"))).alias("w"))
    return inside.unionByName(first.select("w.*"))


def sphere_members(points: DataFrame, halos: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (hid, pid) with the point strictly inside the halo's radius, of rows with the same keys.

    Halos stand on a hierarchy of grids, each on the one whose cells are its radius to twice that, so that any covers at
    most 27 of them. Points are looked up once on each level that has a halo.
    """
    placed = halos.where("r > 0").select(*keys, "hid", *(F.col(a).alias(f"h{a}") for a in AXES), "r", F.ceil(F.log2("r")).cast("int").alias("level"))
    levels = sorted(x.level for x in placed.select("level").distinct().collect())  # powers of two between the radii
    cover, edge = placed, F.pow(F.lit(2.0), F.col("level"))
    for a in AXES:
        cover = cover.withColumn(f"c{a}", F.explode(F.sequence(F.floor((F.col(f"h{a}") - F.col("r")) / edge), F.floor((F.col(f"h{a}") + F.col("r")) / edge))))
    probed = points.select(*keys, "pid", *AXES, F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("level"))
    probed = probed.withColumns({f"c{a}": F.floor(F.col(a) / edge) for a in AXES})
    inside = probed.join(cover, [*keys, "level", *CELL])
    return inside.where(norm2(*(F.col(a) - F.col(f"h{a}") for a in AXES)) < F.col("r") * F.col("r")).select("hid", "pid")


def mark_members(points: DataFrame, halos: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """points with igrp = -1 for rows in any halo, else 0."""
    inside = sphere_members(points, halos, keys).select("pid").distinct().withColumn("igrp", F.lit(-1))
    return points.join(inside, "pid", "left").withColumn("igrp", F.coalesce("igrp", F.lit(0)))
