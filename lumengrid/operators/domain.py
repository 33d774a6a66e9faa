"""Domain decomposition: node numbers, zones near faces, ghost rows, crop, fold and shift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def node_of(cx: Column, cy: Column, cz: Column, n: int) -> Column:
    """Node number of periodic cube coordinates, x fastest."""
    wrap = lambda c: F.pmod(c, F.lit(n))
    return (wrap(cx) + n * wrap(cy) + n * n * wrap(cz)).cast("int")


def to_nodes(points: DataFrame, edge: float, n: int) -> DataFrame:
    """Global positions as node and position within it."""
    c = {a: F.floor(F.col(a) / F.lit(edge)) for a in AXES}
    return points.withColumn("node", node_of(c["x"], c["y"], c["z"], n)).withColumns({a: F.col(a) - F.lit(edge) * c[a] for a in AXES})


def side(x: Column, boxsize: float, buffer_factor: float) -> Column:
    """0 near the lower face, 1 inside, 2 near the upper face."""
    low, high = buffer_factor * boxsize, (1.0 - buffer_factor) * boxsize
    return (x >= low).cast("int") + (x > high).cast("int")


def region(boxsize: float, buffer_factor: float) -> Column:
    """Code 0 to 26 of the zone that a row is in; 13 is the interior."""
    x, y, z = (side(F.col(a), boxsize, buffer_factor) for a in AXES)
    return x + 3 * y + 9 * z


def ghosts(points: DataFrame, boxsize: float, buffer_factor: float, n: int) -> DataFrame:
    """Copies of rows near faces for the nodes beyond, in those nodes' coordinates: 1 from a face, 3 from an edge, 7 from a corner."""
    out = points
    for a in AXES:
        s = side(F.col(a), boxsize, buffer_factor)
        out = out.withColumn(f"_d{a}", F.explode(F.when(s == 1, F.array(F.lit(0))).otherwise(F.array(F.lit(0), s - 1))))
    out = out.where("_dx <> 0 OR _dy <> 0 OR _dz <> 0")
    at = [(F.floor(F.col("node") / F.lit(n**k)) % n + F.col(f"_d{a}")) for k, a in enumerate(AXES)]
    moved = out.withColumn("node", node_of(*at, n)).withColumns({a: F.col(a) - F.col(f"_d{a}") * F.lit(boxsize) for a in AXES})
    return moved.drop("_dx", "_dy", "_dz").withColumn("is_ghost", F.lit(True))


def exchange(points: DataFrame, boxsize: float, buffer_factor: float, n: int) -> DataFrame:
    """Local rows and ghosts together."""
    return points.withColumn("is_ghost", F.lit(False)).unionByName(ghosts(points, boxsize, buffer_factor, n))


def padded(boxsize: float, buffer_factor: float) -> Column:
    """Strictly inside the box with its buffer."""
    low, high = -buffer_factor * boxsize, boxsize + buffer_factor * boxsize
    out = F.lit(True)
    for a in AXES:
        out = out & (F.col(a) > low) & (F.col(a) < high)
    return out


def crop(points: DataFrame, boxsize: float, buffer_factor: float) -> DataFrame:
    return points.where(padded(boxsize, buffer_factor))


def crop_counted(points: DataFrame, boxsize: float, buffer_factor: float, counts: Observation) -> DataFrame:
    """The crop of local rows and ghosts (is_ghost); counts gets kept, removed and removed_local from the job that first reads it."""
    inside, local = padded(boxsize, buffer_factor), ~F.col("is_ghost")
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return points.observe(counts, n(inside, "kept"), n(~inside, "removed"), n(~inside & local, "removed_local")).where(inside)


def owned(boxsize: float) -> Column:
    """Strictly inside the box: of a group's copies one node has its centre there."""
    out = F.lit(True)
    for a in AXES:
        out = out & (F.col(a) > 0) & (F.col(a) < boxsize)
    return out


def fold(x: Column, boxsize: float) -> Column:
    """Remainder with the sign of the dividend."""
    return x % F.lit(float(boxsize))


def shifted(points: DataFrame, shift: tuple[float, float, float]) -> DataFrame:
    """Positions less a shift, without wrapping."""
    return points.withColumns({a: F.col(a) - F.lit(float(s)) for a, s in zip(AXES, shift, strict=True)})
