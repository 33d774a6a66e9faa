"""Assignment to regular grids by cell overlap, normalisation, merging of node grids, checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengrid.functions.kernels import cell_weight
from lumengrid.session import materialise

AXES = ("x", "y", "z")
#: Cells of a tile on an axis, rows of a tile that one group takes, and rows whose weights are multiplied at once.
TILE, MOST_IN_TILE, STEP = 16, 1 << 16, 512


def cell_range(a: str, cell: float, nc: int, periodic: bool) -> tuple[Column, Column]:
    """First cell that a row's kernel (half-width rk) overlaps on an axis, and the one after the last; periodic ones may lie outside the grid."""
    low, high = (F.col(a) - F.col("rk")) / cell, (F.col(a) + F.col("rk")) / cell
    if periodic:
        return F.floor(low).cast("int"), (F.ceil(high) + 1).cast("int")
    return F.greatest(F.lit(0), low.cast("int")), F.least(F.lit(nc), 1 + high.cast("int"))


def spread(rows: DataFrame, boxsize: float, nc: int, periodic: bool = False) -> DataFrame:
    """Every row once for each cell that its kernel overlaps, with ix, iy, iz and the weight w."""
    cell = boxsize / nc
    out = rows
    for a in AXES:
        lo, hi = cell_range(a, cell, nc, periodic)
        out = out.withColumn(f"_lo{a}", lo).withColumn(f"_hi{a}", hi).where(F.col(f"_lo{a}") < F.col(f"_hi{a}"))
    weight = F.lit(1.0)
    for a in AXES:
        out = out.withColumn(f"i{a}", F.explode(F.sequence(F.col(f"_lo{a}"), F.col(f"_hi{a}") - 1)))
        weight = weight * cell_weight(F.col(f"i{a}"), F.col(a), F.col("rk"), cell)
    out = out.withColumn("w", weight)
    if periodic:
        out = out.withColumns({f"i{a}": F.pmod(F.col(f"i{a}"), F.lit(nc)) for a in AXES})
    return out.drop(*(f"_{k}{a}" for a in AXES for k in ("lo", "hi")))


def dealt_to_tiles(rows: DataFrame, boxsize: float, nc: int, periodic: bool, tile: int) -> DataFrame:
    """Every row once for each tile of tile**3 cells that its kernel overlaps: lo, hi (cells), t (tile) and q (period) by axis."""
    cell, out = boxsize / nc, rows
    for a in AXES:
        lo, hi = cell_range(a, cell, nc, periodic)
        out = out.withColumn(f"lo{a}", lo).withColumn(f"hi{a}", hi).where(F.col(f"lo{a}") < F.col(f"hi{a}"))
    whole = lambda x, n: F.floor(x / F.lit(n)).cast("int")
    for a in AXES:
        lo, last = F.col(f"lo{a}"), F.col(f"hi{a}") - 1
        within = lambda q: F.transform(F.sequence(whole(F.greatest(lo - q * nc, F.lit(0)), tile), whole(F.least(last - q * nc, F.lit(nc - 1)), tile)), lambda t: F.struct(q.cast("int").alias("q"), t.alias("t")))  # noqa: B023, E731
        out = out.withColumn("_s", F.explode(F.flatten(F.transform(F.sequence(whole(lo, nc), whole(last, nc)), within)) if periodic else within(F.lit(0))))
        out = out.withColumn(f"q{a}", F.col("_s.q")).withColumn(f"t{a}", F.col("_s.t"))
    return out.drop("_s")


def _overlap(x: np.ndarray, h: np.ndarray, cells: np.ndarray, cell: float, inside: np.ndarray) -> np.ndarray:
    """Share of each row's triangle in each cell, 0 where the row doesn't reach."""

    def upto(t):
        a = np.abs(t)
        return np.sign(t) * np.where(a < 1, a - a * a / 2, 0.5)

    start = (cells * cell - x[:, None]) / h[:, None]
    return np.where(inside, upto(start + cell / h[:, None]) - upto(start), 0.0)


def _deposited(n_keys: int, names: list[str], cell: float, nc: int, tile: int):
    """Sums of tiles' rows: keys, tile, part, then by axis place, lo, hi and period, rk, quantities; in the order of the first ones.

    A row's weights in a tile are a product of three short vectors, so a tile's sums are products of matrices.
    """
    at, fixed = n_keys + 4, n_keys + 17

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, hits, size, kinds = None, None, None, None, []

        def close():
            iz, iy, ix = np.nonzero(hits)
            place = {a: pa.array((t * tile + i).astype(np.int32)) for a, t, i in zip(("ix", "iy", "iz"), now[n_keys : n_keys + 3], (ix, iy, iz), strict=True)}
            keys = {f"k{i}": pa.array(np.full(len(ix), now[i], kinds[i])) for i in range(n_keys)}
            return pa.RecordBatch.from_pydict(keys | place | {f"s{i}": pa.array(sums[i][iz, iy, ix]) for i in range(len(names))})

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
            kinds, changed = [c.dtype for c in cols[:n_keys]], np.zeros(batch.num_rows, bool)
            for c in cols[: n_keys + 4]:
                changed[1:] |= c[1:] != c[:-1]
            cuts = np.concatenate([[0], np.flatnonzero(changed), [batch.num_rows]])
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                key = [c[a].item() for c in cols[: n_keys + 4]]
                if key != now:
                    if now is not None:
                        yield close()
                    now = key
                    size = [min(tile, nc - t * tile) for t in key[n_keys : n_keys + 3]]
                    sums, hits = np.zeros((len(names), size[2], size[1], size[0])), np.zeros((size[2], size[1], size[0]))
                for s in range(a, z, STEP):
                    e = min(z, s + STEP)
                    weights, inside = [], []
                    for i in range(3):
                        x, lo, hi, q = (cols[at + 4 * i + j][s:e] for j in range(4))
                        cells = q[:, None].astype(np.int64) * nc + now[n_keys + i] * tile + np.arange(size[i])
                        inside.append((cells >= lo[:, None]) & (cells < hi[:, None]))
                        weights.append(_overlap(x, cols[fixed - 1][s:e], cells, cell, inside[-1]))
                    plane = lambda v: (v[1][:, :, None] * v[0][:, None, :]).reshape(e - s, -1)  # noqa: B023, E731
                    flat = plane(weights)
                    for k in range(len(names)):
                        sums[k] += ((weights[2] * cols[fixed + k][s:e, None]).T @ flat).reshape(hits.shape)
                    hits += (inside[2].astype(float).T @ plane([v.astype(float) for v in inside])).reshape(hits.shape)
        if now is not None:
            yield close()

    return run


def deposit(rows: DataFrame, boxsize: float, nc: int, values: dict[str, Column], periodic: bool = False, keys: tuple[str, ...] = (), tile: int = TILE, most: int = MOST_IN_TILE) -> DataFrame:
    """Sums of values, weighted by overlap, of each cell (keys, ix, iy, iz) that a row reaches.

    Rows are dealt to tiles, so as many are shuffled as there are rows and tiles that they reach, however many cells these
    have. Tiles with over most rows are dealt out in parts, whose sums are added.
    """
    named = rows.select(*keys, "pid", *AXES, "rk", *(v.cast("double").alias(f"_v{i}") for i, v in enumerate(values.values())))
    dealt = dealt_to_tiles(named, boxsize, nc, periodic, tile)
    own = [*keys, "tx", "ty", "tz"]
    full = materialise(dealt.groupBy(*own).agg(F.count("*").alias("_n")).where(F.col("_n") > most), "full-tiles")
    crowded = not full.isEmpty()
    parts = F.greatest(F.lit(1), F.ceil(F.col("_n") / most)) if crowded else F.lit(1)
    dealt = (dealt.join(full, own, "left") if crowded else dealt).withColumn("part", F.coalesce(F.pmod(F.xxhash64("pid"), parts), F.lit(0)).cast("bigint"))
    axes = [c for a in AXES for c in (F.col(a).cast("double"), f"lo{a}", f"hi{a}", f"q{a}")]
    sent = dealt.select(*own, "part", *axes, F.col("rk").cast("double"), *(f"_v{i}" for i in range(len(values))))
    sent = sent.repartition(*own, "part").sortWithinPartitions(*own, "part")
    kinds = dict(sent.dtypes)
    schema = ", ".join([*(f"k{i} {kinds[k]}" for i, k in enumerate(keys)), "ix int, iy int, iz int", *(f"s{i} double" for i in range(len(values)))])
    out = sent.mapInArrow(_deposited(len(keys), list(values), boxsize / nc, nc, tile), schema).toDF(*keys, "ix", "iy", "iz", *values)
    if crowded:
        out = out.groupBy(*keys, "ix", "iy", "iz").agg(*(F.sum(c).alias(c) for c in values))
    return out


def is_gas(sign: int) -> Column:
    """Rows that count as intergalactic: no group of the given sign."""
    return sign * F.col("igrp") <= 0


def assign(rows: DataFrame, boxsize: float, nc: int, sign: int = -1, periodic: bool = False, keys: tuple[str, ...] = (), tile: int = TILE, most: int = MOST_IN_TILE) -> DataFrame:
    """Per cell: n, c (density-weighted), v (momentum) of intergalactic rows, and halo, the weight of the others."""
    gas = F.when(is_gas(sign), 1.0).otherwise(0.0)
    of = lambda x: F.when(is_gas(sign), F.col(x)).otherwise(0.0)
    values = {"n": gas, "halo": 1.0 - gas, "c": of("dens")} | {f"v{a}": of(f"v{a}") for a in AXES}
    return deposit(rows, boxsize, nc, values, periodic, keys, tile, most)


def interior(rows: DataFrame, boxsize: float) -> DataFrame:
    """Rows with 0 <= position < boxsize on all axes: those that a global grid counts, ghosts left out."""
    for a in AXES:
        rows = rows.where((F.col(a) >= 0) & (F.col(a) < boxsize))
    return rows


def assign_density(rows: DataFrame, boxsize: float, nc: int, sign: int = -1) -> DataFrame:
    return deposit(rows.where(is_gas(sign)), boxsize, nc, {"n": F.lit(1.0)})


def normalise(mesh: DataFrame, boxsize: float, nc: int) -> DataFrame:
    """Clumping c * cell volume / n**2 and mean velocity where n > 0, else 0; n and halo in units of mass (8 each)."""
    volume, n = (boxsize / nc) ** 3, F.col("n")
    some = n > 0
    return mesh.withColumns({"c": F.when(some, F.col("c") * volume / (n * n)).otherwise(0.0)} | {f"v{a}": F.when(some, F.col(f"v{a}") / n).otherwise(0.0) for a in AXES} | {"n": n * 8.0, "halo": F.col("halo") * 8.0})


def merged(mesh: DataFrame, nc: int, nodes: int) -> DataFrame:
    """Cells of all nodes in one global grid: gx, gy, gz instead of node, ix, iy, iz."""
    at = [F.floor(F.col("node") / F.lit(nodes**k)).cast("int") % nodes for k in range(3)]
    return mesh.select(*((c * nc + F.col(f"i{a}")).cast("int").alias(f"g{a}") for c, a in zip(at, AXES, strict=True)), *(c for c in mesh.columns if c not in ("node", "ix", "iy", "iz")))


def momentum(mesh: DataFrame) -> DataFrame:
    """ntot = n + halo, and the velocity planes back as momentum."""
    return mesh.withColumn("ntot", F.col("n") + F.col("halo")).withColumns({f"v{a}": F.col(f"v{a}") * F.col("n") / 8.0 for a in AXES})


def totals(mesh: DataFrame) -> DataFrame:
    """Running totals of a merge: rows outside groups, and all rows (n / 8 and (n + halo) / 8 summed)."""
    return mesh.agg(F.sum(F.col("n") / 8.0).alias("n_rows"), F.sum((F.col("n") + F.col("halo")) / 8.0).alias("all_rows"))


def in_order(mesh: DataFrame, nc: int) -> DataFrame:
    """Cells of a global grid with at, their place in a file (x fastest), in that order."""
    return mesh.withColumn("at", (F.col("gz").cast("bigint") * nc + F.col("gy")) * nc + F.col("gx")).orderBy("at")


def slice_log(mesh: DataFrame, plane: int, mean: float, value: str = "n") -> DataFrame:
    """gx, gz and log10(value / mean) of the non-empty cells with gy = plane."""
    return mesh.where((F.col("gy") == plane) & (F.col(value) > 0)).select("gx", "gz", F.log10(F.col(value) / F.lit(float(mean))).alias("log_ratio"))


def mass_check(mesh: DataFrame, n_total: DataFrame) -> DataFrame:
    """total (mesh mass), expected (rows) and ok (within a thousandth), before normalisation."""
    return mesh.agg(F.sum(F.col("n") + F.col("halo")).alias("total")).crossJoin(F.broadcast(n_total.agg(F.count("*").alias("expected")))).withColumn("ok", F.abs(F.col("total") / F.col("expected") - 1.0) < 0.001)
