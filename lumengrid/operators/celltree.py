"""Nearest neighbours by a tree of cells that split where they are full.

Leaves are found from the top by counting cells of a few levels at a time. Each leaf gets, in one shuffle, its rows and those
within a margin around it, which is chosen from its own density, and finds its rows' nearest in one matrix. A row whose k-th
neighbour is nearer than the margin's edge is done. The others have a bound on that distance by then, from what they have seen
or from an ancestor that holds k rows, and meet the leaves within it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumengrid.functions.kernels import norm2
from lumengrid.session import materialise

AXES = ("x", "y", "z")
#: Levels of the tree: a cell's number on an axis takes so many bits.
DEPTH = 19
#: Rows of a leaf, unless it is at the last level, where rows (nearly) coincide.
MOST_IN_LEAF = 512
#: Distances of a leaf's rows that are held at once.
MATRIX = 1 << 22
#: Part of the whole side that makes up for rounding at cells' faces.
ROUNDING = 1e-9
FOUND = "tree bigint, leaf bigint, pid bigint, nid bigint, rn int, d2 double, dx double, dy double, dz double, far double"


class Frame:
    """The cube of all trees: its corner and side, chosen so that cells' faces are exact numbers."""

    def __init__(self, low: list[float], high: list[float]):
        span = max(h - a for a, h in zip(low, high, strict=True))
        self.side = 2.0 ** math.ceil(math.log2(max(span, 1e-300) * (1 + 1e-12))) if span > 0 else 1.0
        step = self.side / 64
        self.corner = [math.floor(a / step) * step for a in low]
        if any(h >= c + self.side for c, h in zip(self.corner, high, strict=True)):
            self.side *= 2

    def deep(self, a: str) -> Column:
        """The number of a row's cell on the last level."""
        at = F.floor((F.col(a) - F.lit(self.corner[AXES.index(a)])) / F.lit(self.side) * F.lit(float(1 << DEPTH)))
        return F.least(F.greatest(at, F.lit(0)), F.lit((1 << DEPTH) - 1)).cast("bigint")

    def low(self, key: Column, a: str) -> Column:
        return F.lit(self.corner[AXES.index(a)]) + cell_of(key, a) * self.edge(level_of(key))

    def edge(self, level: Column) -> Column:
        return F.lit(self.side) / F.pow(F.lit(2.0), level)


def cell_key(level: Column, cells: list[Column]) -> Column:
    """Level and cell in one number."""
    x, y, z = (c.cast("bigint") for c in cells)
    return F.shiftleft(level.cast("bigint"), 3 * DEPTH).bitwiseOR(F.shiftleft(x, 2 * DEPTH)).bitwiseOR(F.shiftleft(y, DEPTH)).bitwiseOR(z)


def level_of(key: Column) -> Column:
    return F.shiftright(key, 3 * DEPTH)


def cell_of(key: Column, a: str) -> Column:
    return F.shiftright(key, (2 - AXES.index(a)) * DEPTH).bitwiseAND(F.lit((1 << DEPTH) - 1))


def above(key: Column, level: Column) -> Column:
    """The ancestor of a cell on a level."""
    down = (level_of(key) - level).cast("int")
    return cell_key(level, [F.call_function("shiftright", cell_of(key, a), down) for a in AXES])


def placed_in_leaves(rows: DataFrame, n: int, most: int) -> DataFrame:
    """rows (tree, pid, x, y, z, ix, iy, iz) with leaf: the highest cell around a row that has at most most rows of its tree."""
    fine = min(DEPTH, max(2, math.ceil(math.log(max(1, n / most), 8)) + 2))
    base, todo, done = max(0, fine - 4), rows, []
    while True:
        named = todo.withColumn("cell", cell_key(F.lit(fine), [F.shiftright(f"i{a}", DEPTH - fine) for a in AXES]))
        cells = materialise(named.groupBy("tree", "cell").agg(F.count("*").alias("n")), "cells")
        levels, parts = range(base, fine + 1), ["tree"]
        for level in levels:
            cells = cells.withColumn(f"k{level}", above(F.col("cell"), F.lit(level)))
        for level in levels:  # a level's cells lie within those of the level before, so one shuffle serves all sums
            parts = [*parts, f"k{level}"]
            cells = cells.withColumn(f"n{level}", F.sum("n").over(Window.partitionBy(*parts)))
        fits = [F.when(F.col(f"n{level}") <= most, F.col(f"k{level}")) for level in levels]
        leaf = F.coalesce(*fits, F.col("cell")) if fine == DEPTH else F.coalesce(*fits)
        placed = materialise(named.join(cells.select("tree", "cell", leaf.alias("leaf")), ["tree", "cell"]).drop("cell"), "placed")
        done.append(placed.where("leaf IS NOT NULL"))
        todo = placed.where("leaf IS NULL").drop("leaf")
        if fine == DEPTH or todo.isEmpty():
            break
        base, fine = fine + 1, min(DEPTH, fine + 3)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("tree", "leaf", "pid", *AXES)


def touching(boxes: DataFrame, ancestors: DataFrame, frame: Frame) -> DataFrame:
    """boxes (tree, id, level, lx to hz) once for each leaf that they touch.

    A box is laid over cells of its level, which has cells about its size; leaves are those cells' descendants or ancestors.
    """
    out, edge, last = boxes, frame.edge(F.col("level")), F.pow(F.lit(2.0), F.col("level")) - 1
    for a, c in zip(AXES, frame.corner, strict=True):
        first, end = (F.floor((F.col(f"{s}{a}") - F.lit(c)) / edge) for s in "lh")
        out = out.withColumn(f"_{a}", F.explode(F.sequence(F.least(F.greatest(first, F.lit(0)), last).cast("bigint"), F.least(F.greatest(end, F.lit(0)), last).cast("bigint"))))
    cells = out.select("tree", "id", "level", cell_key(F.col("level"), [F.col(f"_{a}") for a in AXES]).alias("up"))
    down = cells.select("tree", "id", "up").join(ancestors.select("tree", "leaf", "up"), ["tree", "up"]).select("tree", "id", "leaf")
    wide = cells.where("level > 0").select("tree", "id", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("level") - 1), lambda v: above(F.col("up"), v))).alias("leaf"))
    own = ancestors.where("leaf = up").select("tree", "leaf")
    pairs = down.unionByName(wide.distinct().join(own, ["tree", "leaf"]).select("tree", "id", "leaf")).join(boxes, ["tree", "id"])
    for a in AXES:
        low = frame.low(F.col("leaf"), a)
        pairs = pairs.where((low <= F.col(f"h{a}")) & (low + frame.edge(level_of(F.col("leaf"))) >= F.col(f"l{a}")))
    return pairs


def _in_leaves(k: int, corner: list[float], side: float):
    """Rows (tree, id, own, pid, x, y, z, margin, in the order of leaf and pid): the nearest of each leaf's own rows."""

    def solved(tree: int, leaf: int, own, pid, at, margin) -> Iterator[pa.RecordBatch]:
        level = leaf >> (3 * DEPTH)
        edge = side / (1 << level)
        cell = np.array([(leaf >> ((2 - i) * DEPTH)) & ((1 << DEPTH) - 1) for i in range(3)])
        low, last = np.array(corner) + cell * edge, (1 << level) - 1
        mine = np.flatnonzero(own)
        for s in range(0, len(mine), step := max(1, MATRIX // len(pid))):
            q = mine[s : s + step]
            x = at[q]
            beyond = np.concatenate([np.where(cell > 0, x - low + margin, np.inf), np.where(cell < last, low + edge + margin - x, np.inf)], 1).min(1) - ROUNDING * side
            d = [x[:, i, None] - at[None, :, i] for i in range(3)]
            d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
            kth = np.partition(d2, k - 1, axis=1)[:, k - 1] if len(pid) >= k else np.full(len(q), np.inf)
            sure = (np.sqrt(kth) < beyond) & np.isfinite(kth)
            i, j = np.nonzero((d2 <= kth[:, None]) & sure[:, None])  # columns are in the order of pid
            by = np.lexsort((j, d2[i, j], i))
            i, j = i[by], j[by]
            rn = np.arange(len(i)) - np.searchsorted(i, i) + 1
            i, j, rn = i[rn <= k], j[rn <= k], rn[rn <= k]
            rest = np.flatnonzero(~sure)
            both = lambda a, b: pa.array(np.concatenate([a, b]))
            n = len(i) + len(rest)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, tree)), pa.array(np.full(n, leaf)), both(pid[q[i]], pid[q[rest]]), pa.array(np.concatenate([pid[j], np.zeros(len(rest), np.int64)]), mask=np.arange(n) >= len(i)), both(rn, np.zeros(len(rest))).cast(pa.int32()), both(d2[i, j], kth[rest]),
                    *(both(d[a][i, j], x[rest, a]) for a in range(3)), both(kth[i], kth[rest]),
                ],
                [c.split()[0] for c in FOUND.split(", ")],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close():
            cols = [np.concatenate([h[i] for h in held]) for i in range(6)]
            return solved(*now, cols[0].astype(bool), cols[1], np.stack(cols[2:5], 1), cols[5][0])

        for batch in batches:
            tree, leaf = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 8)]
            cuts = np.flatnonzero(np.concatenate([[True], (tree[1:] != tree[:-1]) | (leaf[1:] != leaf[:-1]), [True]])) if len(tree) else []
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                key = int(tree[a]), int(leaf[a])
                if key != now:
                    if held:
                        yield from close()
                    now, held = key, []
                held.append([c[a:z] for c in cols])
        if held:
            yield from close()

    return run


def nearest(points: DataFrame, k: int = 33, by: str | None = None, most: int = MOST_IN_LEAF) -> DataFrame:
    """The k nearest rows of every row, itself included: pid, nid, rn, d2, dx, dy, dz, rk (distance to the k-th); ties go to the smaller nid.

    With by, a column of whole numbers, only rows with its value are neighbours; pid must be unique over all. No leaf has more
    than most rows, unless they coincide. Raises ValueError if there are fewer than k rows to choose from.
    """
    tree = (F.lit(0) if by is None else F.col(by)).cast("bigint")
    points = points.select(tree.alias("tree"), "pid", *AXES)
    each = points.groupBy("tree").agg(F.count("*").alias("n"), *(f(a).alias(f"{f.__name__}_{a}") for a in AXES for f in (F.min, F.max)))
    s = each.agg(F.sum("n").alias("n"), F.min("n").alias("least"), *(F.min(f"min_{a}").alias(f"min_{a}") for a in AXES), *(F.max(f"max_{a}").alias(f"max_{a}") for a in AXES)).first()
    if (s.least or 0) < k:
        raise ValueError(f"{k} neighbours of {s.least or 0} rows")
    frame = Frame([s[f"min_{a}"] for a in AXES], [s[f"max_{a}"] for a in AXES])
    rows = placed_in_leaves(points.select("*", *(frame.deep(a).alias(f"i{a}") for a in AXES)), s.n, most)
    leaves = materialise(rows.groupBy("tree", "leaf").agg(F.count("*").alias("n")), "leaves")
    level = level_of(F.col("leaf"))
    ancestors = materialise(leaves.select("tree", "leaf", "n", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), level), lambda v: above(F.col("leaf"), v))).alias("up")), "ancestors")
    # a margin of about what holds k rows at the leaf's density, at most the leaf's edge
    margin = frame.edge(level) * F.least(F.lit(1.0), 1.2 * F.cbrt(F.lit(k * 3 / (4 * math.pi)) / F.col("n")))
    round_off = ROUNDING * frame.side
    boxes = leaves.select("tree", F.col("leaf").alias("id"), level.alias("level"), margin.alias("margin"))
    for a in AXES:
        low = frame.low(F.col("id"), a)
        boxes = boxes.withColumn(f"l{a}", low - F.col("margin") - round_off).withColumn(f"h{a}", low + frame.edge(F.col("level")) + F.col("margin") + round_off)
    near = touching(boxes, ancestors, frame).join(rows, ["tree", "leaf"])
    for a in AXES:
        near = near.where(F.col(a).between(F.col(f"l{a}"), F.col(f"h{a}")))
    dealt = near.select("tree", "id", (F.col("leaf") == F.col("id")).alias("own"), "pid", *AXES, "margin").repartition("tree", "id").sortWithinPartitions("tree", "id", "pid")
    found = materialise(dealt.mapInArrow(_in_leaves(k, frame.corner, frame.side), FOUND), "neighbours")
    out = ["pid", "nid", "rn", "d2", "dx", "dy", "dz", F.sqrt("far").alias("rk")]
    sure, rest = found.where("nid IS NOT NULL").select(*out), found.where("nid IS NULL")
    if rest.isEmpty():
        return sure
    return sure.unionByName(_within_bounds(rest, rows, ancestors, frame, k).select(*out))


def _within_bounds(rest: DataFrame, rows: DataFrame, ancestors: DataFrame, frame: Frame, k: int) -> DataFrame:
    """The nearest of rows that leave their margin: those of all leaves within a distance that is sure to hold k rows."""
    full = ancestors.groupBy("tree", "up").agg(F.sum("n").alias("held")).where(F.col("held") >= k).select("tree", "up")
    around = ancestors.select("tree", "leaf", "up").join(full, ["tree", "up"])
    corner = F.lit(0.0)
    for a in AXES:
        low = frame.low(F.col("up"), a)
        side = F.greatest(F.abs(F.col(f"d{a}") - low), F.abs(low + frame.edge(level_of(F.col("up"))) - F.col(f"d{a}")))
        corner = corner + side * side
    bound = F.sqrt(F.least(F.min("d2"), F.min(corner))) * (1 + 1e-9) + ROUNDING * frame.side
    own = [F.first(f"d{a}").alias(f"q{a}") for a in AXES]
    asked = rest.select("tree", "leaf", "pid", "d2", "dx", "dy", "dz").join(around, ["tree", "leaf"]).groupBy("tree", F.col("pid").alias("id")).agg(bound.alias("bound"), *own)
    level = F.least(F.greatest(F.floor(F.log2(F.lit(frame.side) / F.col("bound"))), F.lit(0)), F.lit(DEPTH)).cast("bigint")
    asked = asked.withColumn("level", level)
    for a in AXES:
        asked = asked.withColumn(f"l{a}", F.col(f"q{a}") - F.col("bound")).withColumn(f"h{a}", F.col(f"q{a}") + F.col("bound"))
    asked = materialise(asked, "asked")
    pairs = touching(asked, ancestors, frame)
    away = F.lit(0.0)
    for a in AXES:
        low = frame.low(F.col("leaf"), a)
        gap = F.greatest(low - F.col(f"q{a}"), F.col(f"q{a}") - low - frame.edge(level_of(F.col("leaf"))), F.lit(0.0))
        away = away + gap * gap
    pairs = pairs.where(away <= F.col("bound") * F.col("bound")).join(rows.withColumnRenamed("pid", "nid"), ["tree", "leaf"])
    seen = pairs.select("tree", F.col("id").alias("pid"), "nid", "bound", *((F.col(f"q{a}") - F.col(a)).alias(f"d{a}") for a in AXES)).withColumn("d2", norm2(F.col("dx"), F.col("dy"), F.col("dz")))
    best = seen.where(F.col("d2") <= F.col("bound") * F.col("bound")).withColumn("rn", F.row_number().over(Window.partitionBy("pid").orderBy("d2", "nid"))).where(F.col("rn") <= k)
    return best.withColumn("far", F.max("d2").over(Window.partitionBy("pid")))
