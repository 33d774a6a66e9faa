"""Particles and halos that the queries derive from the given tables, for Spark and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengrid.session import table

BOX = 64.0
#: Half a cell of 1/128: positions are multiples of 1/256, so that squared distances are exact.
HALF = 0.00390625
#: Overdensity of a virialised halo at redshift 0 with a matter density of 0.308.
DELTA = 331.92592


def particles_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clustered particles: pid, x, y, z, vx, vy, vz from embeddings."""
    e = lambda i: F.col("embedding")[i].cast("double")
    place = [(F.floor((e(i) + 1.0) * 4096.0) / F.lit(128.0) + HALF).alias(a) for i, a in enumerate("xyz")]
    speed = [(F.floor(e(i + 3) * 4096.0) / F.lit(4096.0)).alias(f"v{a}") for i, a in enumerate("xyz")]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), *place, *speed)


def particles_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearly uniform particles: pid, x, y, z from events."""
    at = lambda a, b, name: (((F.col("event_id") * a + F.col("user_id") * b) % 8192) / F.lit(128.0) + HALF).alias(name)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("pid"), at(7919, 104729, "x"), at(6151, 15485863, "y"), at(3079, 32452843, "z"))


def halos_e(particles: DataFrame) -> DataFrame:
    """Every 50th particle as the centre of a halo; every third halo has half the mass that it should have."""
    r = 2.0 + (F.col("pid") % 3) * F.lit(0.5)
    return particles.where("pid % 50 = 0").select(F.col("pid").alias("hid"), "x", "y", "z", r.alias("r")).withColumn("mass", F.lit(DELTA * 4.0 / 3.0) * F.pi() * F.col("r") * F.col("r") * F.col("r") * F.when(F.col("hid") % 150 == 0, 0.5).otherwise(1.0))


PE = """pe AS (SELECT vec_id AS pid,
  floor((cast(embedding[1] AS DOUBLE) + 1e0) * 4096e0) / 128e0 + 0.00390625e0 AS x, floor((cast(embedding[2] AS DOUBLE) + 1e0) * 4096e0) / 128e0 + 0.00390625e0 AS y,
  floor((cast(embedding[3] AS DOUBLE) + 1e0) * 4096e0) / 128e0 + 0.00390625e0 AS z, floor(cast(embedding[4] AS DOUBLE) * 4096e0) / 4096e0 AS vx,
  floor(cast(embedding[5] AS DOUBLE) * 4096e0) / 4096e0 AS vy, floor(cast(embedding[6] AS DOUBLE) * 4096e0) / 4096e0 AS vz FROM embeddings)"""
PV = """pv AS (SELECT event_id AS pid, ((event_id * 7919 + user_id * 104729) % 8192) / 128e0 + 0.00390625e0 AS x,
  ((event_id * 6151 + user_id * 15485863) % 8192) / 128e0 + 0.00390625e0 AS y, ((event_id * 3079 + user_id * 32452843) % 8192) / 128e0 + 0.00390625e0 AS z FROM events)"""
HE = f"""he AS (SELECT pid AS hid, x, y, z, 2e0 + (pid % 3) * 0.5e0 AS r, {DELTA * 4.0 / 3.0!r}::DOUBLE * pi() * (2e0 + (pid % 3) * 0.5e0) * (2e0 + (pid % 3) * 0.5e0) * (2e0 + (pid % 3) * 0.5e0) * CASE WHEN pid % 150 = 0 THEN 0.5e0 ELSE 1e0 END AS mass
  FROM pe WHERE pid % 50 = 0)"""
