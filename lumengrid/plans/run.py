"""The run of a whole field computation: node files of every redshift to grids, catalogues and a report."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lumengrid.config import RunConfig
from lumengrid.functions.kernels import virial_overdensity
from lumengrid.operators import domain, groups, mesh
from lumengrid.operators.spatial import sphere_members
from lumengrid.plans import fields
from lumengrid.session import materialise
from lumengrid.sources import binary, ranges, writers


class MassError(ValueError):
    """A grid or catalogue whose mass is not that of the rows."""


@dataclass
class Report:
    """Seconds and rows by redshift and phase."""

    rows: list[tuple[str, str, float, int]] = field(default_factory=list)

    def timed(self, redshift: str, phase: str, work):
        start = time.time()
        out, n = work()
        self.rows.append((redshift, phase, time.time() - start, int(n)))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """redshift, phase, seconds, rows and the phase's part of the redshift's seconds."""
        t = spark.createDataFrame(self.rows, "redshift string, phase string, seconds double, rows bigint")
        total = t.groupBy("redshift").agg(F.sum("seconds").alias("total"))
        return t.join(total, "redshift").select("redshift", "phase", "seconds", "rows", (F.col("seconds") / F.col("total")).alias("part"))


def snapshot(spark: SparkSession, c: RunConfig, redshift: str) -> tuple[DataFrame, tuple[float, float, float]]:
    """Rows of all node files of a redshift, in their nodes' boxes, and the shift that was taken off."""
    shift = binary.read_shift(spark, f"{c.shift_dir}/{redshift}shift.txt")
    if c.zipped:
        return binary.read_zip(spark, c.node_dir, redshift, c.nc_node_dim, c.mesh_scale, shift, c.order), shift
    return binary.read_xv(spark, c.node_dir, redshift, shift, c.order), shift


def _checked(ok: bool, what: str) -> None:
    if not ok:
        raise MassError(what)


def _counted(df: DataFrame, name: str, **sums) -> tuple[DataFrame, dict]:
    """df as a table, and sums over its rows from the job that writes it."""
    seen = Observation()
    out = materialise(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(v.alias(k) for k, v in sums.items())), name)
    return out, seen.get


def _settings(c: RunConfig, redshift: str, shift: tuple[float, float, float]) -> dict:
    """All that a redshift's results depend on: options, the shift, and each input's bytes and time."""
    names = [f"{redshift}zip{k}_{{}}.dat" for k in range(4)] if c.zipped else [f"{redshift}xv{{}}.dat"]
    store, inputs = binary.opened(c.node_dir)[0], {}
    for name in [*names, *([f"{redshift}halo{{}}.dat"] if c.halos else [])]:
        for path in binary.node_files(c.node_dir, name).values():
            info = store.get_file_info(path)
            inputs[path] = [info.size, info.mtime_ns]
    own = {k: v for k, v in c.__dict__.items() if k not in ("out_dir", "replace", "nc", "redshifts", "shift_dir")}
    return own | {"redshift": redshift, "shift": shift, "inputs": inputs}


def _place(c: RunConfig, redshift: str, kind: str, nc: int) -> str:
    return f"{c.out_dir}/{kind}/nc{nc}/{redshift}" if nc else f"{c.out_dir}/{kind}/{redshift}fof"


def _there(c: RunConfig, redshift: str, kind: str, nc: int, settings: dict) -> bool:
    """Whether a grid, or with nc 0 the catalogue, was committed from the same inputs and options and is there as committed."""
    return not c.replace and ranges.stale(f"{_place(c, redshift, kind, nc)}.manifest", settings | {"kind": kind, "nc": nc}) == []


def _grids(rows: DataFrame, c: RunConfig, redshift: str, kind: str, sign: int, n_rows: int, report: Report, settings: dict) -> list[str]:
    written = []
    for nc in c.nc:
        base = _place(c, redshift, kind, nc)
        if _there(c, redshift, kind, nc, settings):
            continue

        def work(nc=nc, base=base, own=settings | {"kind": kind, "nc": nc}, manifest=f"{base}.manifest"):
            m, seen = _counted(mesh.assign(rows, c.box, nc, sign=sign, keys=("node",)), "mesh", total=F.coalesce(F.sum(F.col("n") + F.col("halo")), F.lit(0.0)))
            total = seen["total"]
            _checked(n_rows == 0 or abs(total / n_rows - 1) < 0.001, f"redshift {redshift}, nc {nc}: mass {total} in the grid, {n_rows} rows")
            files = writers.write_grids(mesh.normalise(m, c.box, nc), base, nc, c.order, own, manifest)
            return [x.path for x in files], len(files)

        written += report.timed(redshift, f"{kind} nc{nc}", work)
    return written


def compute(spark: SparkSession, c: RunConfig, redshift: str, report: Report) -> list[str]:
    """Grids (and with fof a catalogue) of one redshift; paths of the files written. Counts come from the jobs that write the tables."""
    points, shift = snapshot(spark, c, redshift)
    settings = _settings(c, redshift, shift)
    # what is there as it was committed is not made again; a redshift of which all is there isn't read
    wanted = [(kind, nc) for kind, on in (("so", c.halos), ("fof", c.fof)) if on for nc in c.nc] + [("fof", 0)] * c.fof
    if all(_there(c, redshift, kind, nc, settings) for kind, nc in wanted):
        return []

    def load():
        rows, seen = _counted(points, "points")
        return (rows, seen["rows"]), seen["rows"]

    points, n_rows = report.timed(redshift, "io", load)
    nodes, written = c.nodes_per_axis, []
    if c.fof:

        def find():
            near = materialise(fields.with_ghosts(points, c.box, nodes, c.buffer_factor), "ghosts")
            tags, seen = _counted(groups.large_groups(groups.friends(near, c.link, ("node",))), "tags")
            base = _place(c, redshift, "fof", 0)
            files = writers.write_catalogue(groups.node_catalogue(near, tags, c.box), base, c.order, settings | {"kind": "fof", "nc": 0}, f"{base}.manifest")
            return (tags, [x.path for x in files]), seen["rows"]

        tags, files = report.timed(redshift, "fof", find)
        written += files
    halos = None
    if c.halos:

        def validated():
            z = float(redshift)
            delta = spark.range(1).select(virial_overdensity(F.lit(z), F.lit(c.omega_m))).first()[0]
            read = binary.read_halos(spark, c.node_dir, redshift, c.box, c.mass_def, shift=shift, order=c.order, pids=c.pids)
            h, seen = _counted(groups.require_valid(read, 200.0 if c.mass_def == "200c" else delta), "halos", mass=F.coalesce(F.sum(F.col("mass") / 8.0), F.lit(0.0)))
            return (h, seen["mass"]), seen["rows"]

        halos, expected = report.timed(redshift, "so_halo", validated)

    def density():
        cropped = Observation()
        rows, seen = _counted(fields.node_rows(points, halos, c.box, nodes, c.buffer_factor, cropped), "rows")
        return (rows, cropped.get), seen["rows"]

    rows, cropped = report.timed(redshift, "neighbors", density)
    report.rows.append((redshift, "cropped", 0.0, cropped["removed"]))
    if halos is not None:
        marked = _marked(rows, halos, c)
        _checked(expected <= 100 or abs(marked / expected - 1) < c.halo_tolerance, f"redshift {redshift}: {marked} rows in halos of mass {expected}")
        written += _grids(rows, c, redshift, "so", -1, n_rows, report, settings)
    if c.fof:
        written += _grids(rows.drop("igrp").join(tags, "pid"), c, redshift, "fof", 1, n_rows, report, settings)
    return written


def _marked(rows: DataFrame, halos: DataFrame, c: RunConfig) -> int:
    """Rows of the nodes' own boxes in halos, with their multiplicity."""
    near = domain.exchange(halos, c.box, c.buffer_factor, c.nodes_per_axis).where(domain.padded(c.box, c.buffer_factor))
    return sphere_members(rows.where("NOT is_ghost"), near, ("node",)).count()


def run(spark: SparkSession, c: RunConfig) -> tuple[list[str], Report]:
    """All redshifts of the list, one after the other. Returns the files written and the report."""
    report, written = Report(), []
    for x in binary.read_redshifts(spark, c.redshifts).collect():  # a few lines
        written += compute(spark, c, x.redshift, report)
    return written, report


def merge(spark: SparkSession, base: str, out: str, nc: int, nodes: int, order: str = "<") -> dict[str, float]:
    """Merges the node grids `<base>{n,h,vel,c}<node>.dat` into `<out>{n,ntot,v,c}_all.dat`; returns the running totals.

    ntot is n and halo together, v the momentum. Node grids without a c plane leave that file out.
    """
    cell = ["node", "ix", "iy", "iz"]
    grid = binary.read_grid(spark, base, "n", order=order).withColumnRenamed("v0", "n")
    grid = grid.join(binary.read_grid(spark, base, "h", order=order).withColumnRenamed("v0", "halo"), cell)
    grid = grid.join(binary.read_grid(spark, base, "vel", 3, order).withColumnsRenamed({f"v{i}": f"v{a}" for i, a in enumerate("xyz")}), cell)
    whole = materialise(mesh.momentum(mesh.merged(grid, nc, nodes)), "merged")
    for name, columns in (("n", ["n"]), ("ntot", ["ntot"]), ("v", ["vx", "vy", "vz"])):
        writers.write_global(whole, f"{out}{name}_all.dat", nc * nodes, columns, order)
    if binary.grid_files(base, "c"):
        c = mesh.merged(binary.read_grid(spark, base, "c", order=order).withColumnRenamed("v0", "c"), nc, nodes)
        writers.write_global(c, f"{out}c_all.dat", nc * nodes, ["c"], order)
    return mesh.totals(whole).first().asDict()
