"""Writers of grids, catalogues, histograms and snapshots.

All but zipped snapshots go through Spark's data source writers (`sources/ranges.py`): tasks write ranges of a file side by
side. A node's zipped files come from one task, as their records have no place before the cells before them are counted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from lumengrid.sources import binary, ranges
from lumengrid.sources.binary import ZIP_HEADER_WORDS, opened

AXES = ("x", "y", "z")
WRITTEN = "path string, bytes bigint"
#: Records of a node that one task writes at least.
PER_TASK = 1 << 22


@dataclass
class Written:
    path: str
    bytes: int


class _File:
    def __init__(self, uri: str):
        self.store, self.path = opened(uri)
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.stream, self.size = self.store.open_output_stream(self.own), 0

    def write(self, content: bytes) -> None:
        self.stream.write(content)
        self.size += len(content)

    def done(self) -> pa.RecordBatch:
        self.stream.close()
        self.store.move(self.own, self.path)
        return pa.RecordBatch.from_pydict({"path": [self.path], "bytes": pa.array([self.size], pa.int64())})


def save(rows: DataFrame, source: type[DataSource], base: str, settings: dict | None = None, manifest: str | None = None, **options) -> list[Written]:
    """Writes rows with a data source; returns the files and their bytes, as the manifest has them.

    The manifest stays if its path is given.
    """
    spark = rows.sparkSession
    spark.dataSource.register(source)
    at = manifest or f"{base}.{uuid.uuid4().hex}.manifest"
    texts = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}
    rows.write.format(source.name()).mode("append").options(base=base, manifest=at, settings=json.dumps(settings or {}), **texts).save()
    files = ranges.committed(at)["files"]
    if not manifest:
        store, path = opened(at)
        store.delete_file(path)
    return [Written(opened(base + name)[1], size) for name, (size, _) in sorted(files.items())]


def by_slab(m: DataFrame, node: str | None, slab: str, *within: str) -> DataFrame:
    """Cells in runs as they stand in a file: a task has whole slabs of a node."""
    keys = [node, slab] if node else [slab]
    return m.repartition(*keys).sortWithinPartitions(*keys, *within)


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """rows with at, their place in their node (from 0, by order), and n, the node's rows.

    Ranges of order are numbered by tasks of their own, so a node may have any number of rows.
    """
    from lumengrid.session import materialise

    # range numbers of a node's rows, then rows before each range: nobody holds a node's rows in one task
    placed = rows.repartitionByRange("node", order).sortWithinPartitions("node", order).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    placed = materialise(placed, "numbered")
    parts = placed.groupBy("node", "_part").agg(F.count("*").alias("_rows"), F.min("_id").alias("_first"))  # a row for each range and node
    before = Window.partitionBy("node").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).withColumn("n", F.sum("_rows").over(Window.partitionBy("node")))
    out = placed.join(F.broadcast(parts.drop("_rows")), ["node", "_part"])
    return out.withColumn("at", F.col("_before") + F.col("_id") - F.col("_first")).drop("_part", "_id", "_first", "_before")


def ranges_of(rows: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """Numbered rows dealt by node and range of places."""
    return rows.withColumn("_r", F.floor(F.col("at") / per_task)).repartition("node", "_r").sortWithinPartitions("node", "at").drop("_r")


def write_grids(m: DataFrame, base: str, nc: int, order: str = "<", settings: dict | None = None, manifest: str | None = None) -> list[Written]:
    """Writes `<base>{n,h,c,vel}<node>.dat` of a normalised mesh (node, ix, iy, iz, n, halo, c, vx, vy, vz); missing cells are 0."""
    rows = m.select("node", "ix", "iy", "iz", "n", "halo", "c", "vx", "vy", "vz")
    return save(by_slab(rows, "node", "iz", "iy", "ix"), binary.GridSource, base, settings, manifest, nc=nc, order=order)


def write_combined(m: DataFrame, base: str, nc: int, boxsize: float, order: str = "<") -> list[Written]:
    """Writes `<base><node>.dat` of a mesh that is not normalised: nc, 6, the box's size, then planes n, halo and c and the momenta by cell."""
    rows = m.select("node", "ix", "iy", "iz", "n", "halo", "c", "vx", "vy", "vz")
    return save(by_slab(rows, "node", "iz", "iy", "ix"), binary.GridSource, base, nc=nc, order=order, layout="combined", boxsize=boxsize)


def write_global(m: DataFrame, path: str, nc: int, columns: list[str], order: str = "<") -> int:
    """Writes one file of a global grid (gx, gy, gz): three words nc, then the columns of each cell, x fastest; missing cells are 0. Returns its bytes.

    Tasks write slabs of z side by side into the one file.
    """
    rows = m.select("gx", "gy", "gz", *columns)
    return save(by_slab(rows, None, "gz", "gy", "gx"), binary.GridSource, path, nc=nc, order=order, layout="global", columns=",".join(columns))[0].bytes


def write_catalogue(groups: DataFrame, base: str, order: str = "<", settings: dict | None = None, manifest: str | None = None) -> list[Written]:
    """Writes `<base><node>.dat` of each node's groups: count, record size, records (mean position and velocity, size), count."""
    rows = numbered(groups.select("node", "igrp", "x", "y", "z", "vx", "vy", "vz", "nfof"), "igrp").drop("igrp")
    return save(ranges_of(rows), binary.CatalogueSource, base, settings, manifest, order=order)


def read_catalogue(spark, base: str, order: str = "<") -> DataFrame:
    """node, x, y, z, vx, vy, vz and nfof of the group catalogues `<base><node>.dat`. Raises if the counts at both ends differ."""
    return binary.load(spark, binary.CatalogueSource, base=base, order=order)


def write_xv(points: DataFrame, base: str, redshift: str, order: str = "<") -> list[Written]:
    """Writes `<base><node>/<redshift>xv<node>.dat` of points (node, pid, x, y, z, vx, vy, vz) in the order of pid."""
    rows = numbered(points.select("node", "pid", "x", "y", "z", "vx", "vy", "vz"), "pid").drop("pid")
    return save(ranges_of(rows), binary.XvSource, base, order=order, redshift=redshift)


def write_halos(halos: DataFrame, base: str, redshift: str, layout: int = 22, pids: bool = False, order: str = "<") -> list[Written]:
    """Writes `<base><node>/<redshift>halo<node>.dat` of halos (node, hid, x, y, z, r, mass): the columns that are read, zeros elsewhere."""
    rows = numbered(halos.select("node", "hid", "x", "y", "z", "mass", "r"), "hid").drop("hid")
    return save(ranges_of(rows), binary.HaloSource, base, order=order, redshift=redshift, layout=layout, pids=pids)


def write_histogram(hist: DataFrame, total: DataFrame, path: str, low: float, high: float, bins: int, order: str = "<") -> int:
    """Writes one histogram (bin, n, total) of total's rows: bounds, bins, all rows, sum of values, counts."""
    sums = hist.agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("total")).crossJoin(total.agg(F.count("*").alias("ntot"))).first()
    every = total.sparkSession.range(bins).select(F.col("id").alias("at")).join(hist.select(F.col("bin").cast("bigint").alias("at"), "n"), "at", "left").select("at", F.coalesce("n", F.lit(0)).alias("n"))
    return save(every.repartitionByRange("at").sortWithinPartitions("at"), binary.HistogramSource, path, order=order, low=low, high=high, bins=bins, ntot=sums.ntot, total=sums.total)[0].bytes


def read_histogram(spark, path: str, order: str = "<") -> DataFrame:
    """bin, low, high (bounds of the bin), n, ntot and total (of the whole histogram) of a histogram file."""
    return binary.load(spark, binary.HistogramSource, base=path, order=order)


def write_zip(points: DataFrame, base: str, redshift: str, nc_node_dim: int, mesh_scale: float, velocity_scale: float, order: str = "<") -> list[Written]:
    """Writes the four files of zipped snapshots of points (node, x, y, z, vx, vy, vz) that lie in their node's box.

    Positions are kept to 1/256 of a coarse cell, velocities to 1 / velocity_scale. Rows stand in the order of cells.
    """
    offset = lambda a: F.floor(F.col(a) / mesh_scale * 256.0).cast("bigint")
    o = {a: offset(a) for a in AXES}
    cell = F.shiftright(o["x"], 8) + nc_node_dim * (F.shiftright(o["y"], 8) + nc_node_dim * F.shiftright(o["z"], 8))
    rows = points.select("node", cell.alias("cell"), *((o[a] % 256).cast("int").alias(f"u{a}") for a in AXES), *(F.round(F.col(f"v{a}") * velocity_scale).cast("int").alias(f"i{a}") for a in AXES))
    rows = rows.join(F.broadcast(rows.groupBy("node").agg(F.count("*").alias("n"))), "node").select("node", "n", "cell", "ux", "uy", "uz", "ix", "iy", "iz")
    rows = rows.repartition("node").sortWithinPartitions("node", "cell", "ux", "uy", "uz", "ix", "iy", "iz")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, files, counts = None, [], np.zeros(0, np.int64)

        def close():
            large = np.flatnonzero(counts >= 255)
            files[2].write(np.minimum(counts, 255).astype(np.uint8).tobytes())
            files[3].write(counts[large].astype(f"{order}i4").tobytes())
            return [f.done() for f in files]

        for batch in batches:
            nodes = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1], [True]])) if len(nodes) else []
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if nodes[a] != now:
                    if now is not None:
                        yield from close()
                    now, counts = nodes[a], np.zeros(nc_node_dim**3, np.int64)
                    files = [_File(f"{base}{now}/{redshift}zip{k}_{now}.dat") for k in range(4)]
                    head = np.zeros(ZIP_HEADER_WORDS, f"{order}f4")
                    head[13] = velocity_scale
                    n = np.array([batch.column(1)[int(a)].as_py()], f"{order}i4").tobytes()
                    files[0].write(n + head.tobytes()[4:])
                    files[1].write(n + bytes(60))
                counts += np.bincount(batch.column(2).to_numpy()[a:z], minlength=len(counts))
                files[0].write(np.stack([batch.column(3 + i).to_numpy()[a:z] for i in range(3)], axis=1).astype(np.uint8).tobytes())
                files[1].write(np.stack([batch.column(6 + i).to_numpy()[a:z] for i in range(3)], axis=1).astype(f"{order}i2").tobytes())
        if now is not None:
            yield from close()

    return [Written(r.path, r.bytes) for r in rows.mapInArrow(run, WRITTEN).collect()]  # four rows for each node


def write_fields(mesh: DataFrame, path: str) -> None:
    """Grids as parquet, a folder for each redshift, grid size and node; existing ones are replaced."""
    mesh.write.mode("overwrite").partitionBy(*(c for c in ("redshift", "nc", "node") if c in mesh.columns)).parquet(path)


def write_ascii(points: DataFrame, path: str) -> None:
    """Six numbers a line."""
    points.select(F.format_string("%e %e %e %e %e %e", "x", "y", "z", "vx", "vy", "vz").alias("value")).write.mode("overwrite").text(path)
