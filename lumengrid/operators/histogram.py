"""Fixed-width histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, x: Column, low: float, high: float, bins: int) -> DataFrame:
    """bin, n and total (sum of values) of the bins with rows in [low, high)."""
    b = ((x - low) / F.lit(high - low) * bins).cast("int")
    return df.where((x >= low) & (x < high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.sum(x).alias("total"))


def pdf(hist: DataFrame, rows: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """Density at bin centres, over all rows, those out of range included."""
    width = (high - low) / bins
    all_rows = F.broadcast(rows.agg(F.count("*").alias("ntot")))
    return hist.crossJoin(all_rows).select((F.lit(low) + (F.col("bin") + 0.5) * width).alias("centre"), (F.col("n") / F.col("ntot") / width).alias("density"))


def merge(*parts: DataFrame) -> DataFrame:
    """One histogram from several with the same bounds."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
