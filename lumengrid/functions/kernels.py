"""Column expressions: distances, kernels, cosmology and memory sizes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm2(dx: Column, dy: Column, dz: Column) -> Column:
    return dx * dx + dy * dy + dz * dz


def triangle(dx: Column, dy: Column, dz: Column, h: Column) -> Column:
    """Separable triangular kernel of half-width h, normalised to one."""
    one = F.lit(1.0)
    return (one - F.abs(dx) / h) * (one - F.abs(dy) / h) * (one - F.abs(dz) / h) / (h * h * h)


def spline(d2: Column, h: Column) -> Column:
    """Cubic spline kernel with support h."""
    r = F.sqrt(d2) / h
    inner = 1.0 - 6.0 * r * r + 6.0 * r * r * r
    rest = 1.0 - r
    return F.when(r < 0.5, inner).otherwise(2.0 * rest * rest * rest) * (8.0 / math.pi) / (h * h * h)


def cumulative(t: Column) -> Column:
    """Integral of the unit triangle from its centre to t."""
    a = F.abs(t)
    return F.signum(t) * F.when(a < 1.0, a - a * a / 2.0).otherwise(0.5)


def cell_weight(i: Column, x: Column, h: Column, cell: float) -> Column:
    """Share of the triangle around x that lies in cell i of a grid with so large cells."""
    start = (i * F.lit(cell) - x) / h
    return cumulative(start + F.lit(cell) / h) - cumulative(start)


def virial_overdensity(z: Column, omega_m: Column) -> Column:
    """Overdensity of a virialised halo relative to the mean, in a flat universe (Bryan and Norman 1998)."""
    a = 1.0 / (1.0 + z)
    e = omega_m + (1.0 - omega_m) * a * a * a
    x = omega_m / e - 1.0
    return (18.0 * math.pi**2 + 82.0 * x - 39.0 * x * x) * e / omega_m


def overdensity(mass: Column, r: Column) -> Column:
    return mass / (F.lit(4.0 / 3.0 * math.pi) * r * r * r)


def tree_bytes(n: Column) -> Column:
    """Bytes of a bisection tree over n rows: 20 for each of 2 * leaves - 1 nodes, leaves a power of two of 16 rows."""
    leaves = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(n / F.lit(16.0))).cast("double")))
    return (20.0 * (2.0 * leaves - 1.0)).cast("bigint")


def particle_bytes(n: Column, buffer_factor: float) -> Column:
    return F.ceil(n * F.lit(36.0 * (1.0 + 2.0 * buffer_factor) ** 3)).cast("bigint")
