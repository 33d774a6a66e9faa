"""Friends-of-friends groups and halo checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumengrid.functions.kernels import overdensity
from lumengrid.operators.components import components
from lumengrid.operators.domain import owned
from lumengrid.operators.spatial import witnesses
from lumengrid.session import materialise


def friends(points: DataFrame, length: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """pid and root, the smallest pid of its group; a row without a friend is its own group. Friends have the same keys."""
    roots = components(materialise(witnesses(points, length, keys), "friends"))
    return points.select("pid").join(roots.withColumnRenamed("node", "pid"), "pid", "left").select("pid", F.coalesce("root", "pid").alias("root"))


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows with name: 1, 2, ... in the order of key. Ranges of keys are numbered by tasks of their own, after the rows before them."""
    place = F.monotonically_increasing_id()
    ordered = rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("_part", F.shiftright(place, 33)).withColumn("_at", place.bitwiseAND(F.lit((1 << 33) - 1)))
    ordered = materialise(ordered, "ordered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ordered.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))  # one row for each range
    return ordered.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_before") + F.col("_at") + 1).cast("int")).drop("_part", "_at", "_before")


def large_groups(groups: DataFrame, least: int = 20) -> DataFrame:
    """pid and igrp: 1, 2, ... in the order of roots for groups of at least so many rows, else 0."""
    sizes = groups.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return groups.join(numbered(sizes.select("root"), "root", "igrp"), "root", "left").select("pid", F.coalesce("igrp", F.lit(0)).alias("igrp"))


def catalogue(points: DataFrame, tagged: DataFrame, boxsize: float) -> DataFrame:
    """Mean position and velocity, and size, of each group whose centre lies in the box."""
    means = [F.avg(c).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")]
    rows = points.join(tagged.where("igrp > 0"), "pid").groupBy("igrp").agg(*means, F.count("*").alias("nfof"))
    return rows.where(owned(boxsize))


def node_catalogue(points: DataFrame, tagged: DataFrame, boxsize: float) -> DataFrame:
    """The catalogue of each node (node, igrp): groups of its rows and ghosts whose centre lies in its box."""
    means = [F.avg(c).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")]
    rows = points.join(tagged.where("igrp > 0"), "pid").groupBy("node", "igrp").agg(*means, F.count("*").alias("nfof"))
    return rows.where(owned(boxsize))


def invalid_halos(halos: DataFrame, expected: float, tolerance: float = 10.0) -> DataFrame:
    """Halos with their overdensity and whether it is as expected."""
    d = overdensity(F.col("mass"), F.col("r"))
    return halos.select("hid", d.alias("delta"), (F.abs(d - F.lit(expected)) < tolerance).alias("ok"))


def require_valid(halos: DataFrame, expected: float, tolerance: float = 10.0) -> DataFrame:
    """halos; a halo whose overdensity is not as expected stops the job."""
    d = overdensity(F.col("mass"), F.col("r"))
    bad = F.concat(F.lit("halo "), F.col("hid").cast("string"), F.lit(": overdensity "), d.cast("string"), F.lit(f" is not {expected}"))
    return halos.withColumn("r", F.when(F.abs(d - F.lit(expected)) < tolerance, F.col("r")).otherwise(F.raise_error(bad).cast("double")))


def halo_mass_check(members: DataFrame, halos: DataFrame) -> DataFrame:
    """Marked rows, with their multiplicity, against the catalogue's mass in rows (mass / 8); ok within a fifth if that is over 100."""
    marked = members.agg(F.count("*").alias("marked"))
    return halos.agg(F.sum(F.col("mass") / 8.0).alias("expected")).crossJoin(F.broadcast(marked)).withColumn("ok", (F.col("expected") <= 100) | (F.abs(F.col("marked") / F.col("expected") - 1.0) < 0.2))
