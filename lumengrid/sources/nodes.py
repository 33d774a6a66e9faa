"""Node files of a periodic volume read together: each node's own rows and its neighbours' within a buffer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengrid.functions.kernels import overdensity
from lumengrid.operators import domain
from lumengrid.sources import binary


def all_xv(spark: SparkSession, base: str, redshift: str, boxsize: float, nodes: int, buffer_factor: float, shift: tuple[float, float, float] = (0, 0, 0), order: str = "<") -> DataFrame:
    """Rows of all xv files by node, with those that a neighbour has within the buffer, in the node's coordinates, and is_ghost."""
    return domain.exchange(binary.read_xv(spark, base, redshift, shift, order), boxsize, buffer_factor, nodes)


def all_halos(spark: SparkSession, base: str, redshift: str, boxsize: float, nodes: int, buffer_factor: float, expected: float = 178.0, tolerance: float = 0.1, layout: int = binary.HALO17, **options) -> DataFrame:
    """Halos of all files by node and of their neighbours, strictly inside the padded box, with ok: whether their overdensity is as expected."""
    halos = binary.read_halos(spark, base, redshift, boxsize, layout=layout, **options)
    near = domain.exchange(halos, boxsize, buffer_factor, nodes).where(domain.padded(boxsize, buffer_factor))
    return near.withColumn("ok", F.abs(overdensity(F.col("mass"), F.col("r")) - expected) <= tolerance)
