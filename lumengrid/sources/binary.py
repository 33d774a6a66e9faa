"""Binary snapshot, halo and grid formats as Spark data sources that read ranges of rows, and text inputs.

A file is cut into ranges of rows, one Spark partition each; a task seeks to its range and reads it batch by batch, so files
may be of any size. Files are opened through pyarrow's file systems, on any that all executors reach.
"""

from __future__ import annotations

import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lumengrid.sources.ranges import FileLayout, RangeWriter

BATCH = 1 << 16
#: Rows that a task reads by default.
RANGE = 1 << 22
#: Coarse cells whose counts are looked at together.
CELLS = 1 << 20

#: Words of 4 bytes in the header of a zipped snapshot, and the one (counted from 0) that holds the velocity scale.
ZIP_HEADER_WORDS, VELOCITY_WORD = 16, 13
XV_HEADER_BYTES = 48
#: 32-bit floats of a halo record, and bytes of the particle ids that may follow it.
HALO22, HALO17, PID_BYTES = 22, 17, 1600
#: Places of (mass, radius) in a 22-float record by mass definition, and in a 17-float record.
MASS_AND_RADIUS = {"vir": (3, 5), "200c": (4, 6)}
MASS_AND_RADIUS_17 = (15, 13)
#: Files of a grid and their columns.
PLANES = {"n": ("n",), "h": ("halo",), "c": ("c",), "vel": ("vx", "vy", "vz")}

ROWS = "node int, pid bigint, x double, y double, z double, vx double, vy double, vz double"


def decoded_position(u8: Column, cell: Column, mesh_scale: float, shift: float) -> Column:
    """Position from an offset of 1/256 of a coarse cell (counted from 0)."""
    return F.lit(mesh_scale) * ((u8 + F.lit(0.5)) / F.lit(256.0) + cell) - F.lit(shift)


def decoded_velocity(i16: Column, scale: float) -> Column:
    return i16 / F.lit(scale)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def node_files(base: str, name: str) -> dict[int, str]:
    """Paths of `<base><node>/<name>` by node; name has {} for the node's number."""
    store, root = opened(base)
    parent, _, prefix = root.rpartition("/")
    found = {}
    for x in store.get_file_info(fs.FileSelector(parent)):
        if x.type == fs.FileType.Directory and (m := re.fullmatch(re.escape(prefix) + r"(\d+)", x.base_name)):
            path = f"{x.path}/{name.format(m[1])}"
            if store.get_file_info(path).type == fs.FileType.File:
                found[int(m[1])] = path
    return found


def grid_files(base: str, kind: str) -> dict[int, str]:
    """Paths of `<base><kind><node>.dat` by node."""
    store, root = opened(base + kind)
    parent, _, prefix = root.rpartition("/")
    named = ((re.fullmatch(re.escape(prefix) + r"(\d+)\.dat", x.base_name), x.path) for x in store.get_file_info(fs.FileSelector(parent)))
    return {int(m[1]): path for m, path in named if m}


@dataclass
class Range(InputPartition):
    """Rows first to last (not included) of a node's file; of zipped ones, also a block of cells, and rows and large counts before it."""

    node: int
    path: str
    first: int
    last: int
    start: tuple[int, int, int] = (0, 0, 0)

    def __init__(self, node: int, path: str, first: int, last: int, start: tuple[int, int, int] = (0, 0, 0)):
        super().__init__(None)
        self.node, self.path, self.first, self.last, self.start = node, path, first, last, start


def _columns(node: int, first: int, columns: dict[str, np.ndarray], key: str | None) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    out = {"node": pa.array(np.full(n, node, np.int32))}
    if key:
        out[key] = pa.array((np.int64(node) << 40) + np.arange(first, first + n))
    return pa.RecordBatch.from_pydict(out | {k: pa.array(np.ascontiguousarray(v)) for k, v in columns.items()})


class _Reader(DataSourceReader):
    """Options: base, redshift, order (< or >), shift (x,y,z), range (rows of a task), where.

    where (JSON) has bounds, both included: on the node they leave files out; on the number of a row, or the plane of a cell,
    ranges of rows. A list of other than two nodes means these. Bounds are options and not filters that Spark pushes: Spark
    4.1 keeps pushed filters with the table, so another scan of the same DataFrame would get them too.
    """

    #: The column that numbers rows: a node's own are after node << 40.
    key: str | None = "pid"
    #: The column that counts planes of cells, if rows are cells.
    plane: str | None = None

    def __init__(self, options: dict):
        self.o = dict(options)
        self.order = self.o.get("order", "<")
        self.range = int(self.o.get("range", RANGE))
        self.shift = np.array([float(s) for s in self.o.get("shift", "0,0,0").split(",")])
        held = json.loads(self.o.get("where") or "{}")
        self.nodes = set(held.pop("node")) if len(held.get("node", (0, 0))) != 2 else None
        self.bounds: dict[str, tuple[int, int]] = held
        if unknown := set(held) - {"node", self.key, self.plane}:
            raise ValueError(f"no bounds on {', '.join(sorted(unknown))}: they don't place rows in files")

    def wanted(self, node: int, n: int) -> tuple[int, int]:
        """The rows of a node's n that are within the bounds."""
        first, last = 0, n
        if self.key in self.bounds:
            low, high = (x - (node << 40) for x in self.bounds[self.key])
            first, last = max(first, low), min(last, high + 1)
        if self.plane in self.bounds:
            (low, high), nc = self.bounds[self.plane], round(n ** (1 / 3))
            first, last = max(first, low * nc**2), min(last, (high + 1) * nc**2)
        return first, last

    def store(self) -> fs.FileSystem:
        return opened(self.o["base"])[0]

    def number(self, store: fs.FileSystem, path: str) -> int:
        """The row count in the first word of a file."""
        with store.open_input_file(path) as f:
            return int(np.frombuffer(f.read(4), f"{self.order}i4")[0])

    def files(self) -> dict[int, str]:
        return node_files(self.o["base"], self.o["redshift"] + self.kind + "{}.dat")

    def rows(self, store: fs.FileSystem, path: str, node: int) -> int:
        return self.number(store, path)

    def wanted_files(self) -> list[tuple[int, str]]:
        low, high = self.bounds.get("node", (-(1 << 62), 1 << 62))
        return [(node, path) for node, path in sorted(self.files().items()) if low <= node <= high and (self.nodes is None or node in self.nodes)]

    def partitions(self):
        store, out = self.store(), []
        for node, path in self.wanted_files():
            n = self.rows(store, path, node)
            first, last = self.wanted(node, n)
            # an empty file has a range too, so that it is checked
            out += [Range(node, path, a, min(last, a + self.range)) for a in range(first, max(last, first + (n == 0)), self.range)]
        return self.placed(out)

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # Spark reads None where there are no partitions
            yield from self.scan(partition)

    def placed(self, ranges: list[Range]) -> list[Range]:
        return ranges

    def particles(self, node: int, first: int, xyz: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return _columns(node, first, {a: xyz[:, i] for i, a in enumerate("xyz")} | {f"v{a}": v[:, i] for i, a in enumerate("xyz")}, "pid")


def large_counts(store: fs.FileSystem, path: str, first: int, n: int, order: str) -> np.ndarray:
    """n of the counts that don't fit a byte, from the first on."""
    with store.open_input_file(path) as f:
        f.seek(4 * first)
        out = np.frombuffer(f.read(4 * n), f"{order}i4").astype(np.int64)
    if len(out) < n:
        raise ValueError(f"{path}: {first + len(out)} counts are too few")
    return out


class XvReader(_Reader):
    kind = "xv"

    def rows(self, store, path, node):
        n, size = self.number(store, path), store.get_file_info(path).size
        if size < XV_HEADER_BYTES + 24 * n:
            raise ValueError(f"xv file of node {node}: {n} rows in {size} bytes")
        return n

    def scan(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with self.store().open_input_file(partition.path) as f:
            f.seek(XV_HEADER_BYTES + 24 * partition.first)
            for a in range(partition.first, partition.last, BATCH):
                n = min(BATCH, partition.last - a)
                rows = np.frombuffer(f.read(24 * n), f"{self.order}f4").reshape(n, 6).astype(np.float64)
                yield self.particles(partition.node, a, rows[:, :3] - self.shift, rows[:, 3:])


class ZipReader(_Reader):
    """Four files a node: sub-cell positions, velocities, cell counts, and the counts that don't fit."""

    def files(self):
        return node_files(self.o["base"], self.o["redshift"] + "zip0_{}.dat")

    def placed(self, ranges):
        """With an index each range begins at the block of cells that has its first row."""
        if not self.o.get("index"):
            return ranges
        store, path = opened(self.o["index"])
        with store.open_input_file(path) as f:
            blocks = np.load(io.BytesIO(f.read()))  # node, block, rows before, large counts before; 32 bytes for each block
        own = {node: blocks[blocks[:, 0] == node] for node in {r.node for r in ranges}}
        for r in ranges:
            b = own[r.node]
            r.start = tuple(b[max(0, np.searchsorted(b[:, 2], r.first, "right") - 1), 1:].tolist())
        return ranges

    def counts(self, store: fs.FileSystem, path: str, block: int = 0, escaped: int = 0) -> Iterator[tuple[int, np.ndarray]]:
        """Counts of coarse cells from a block on, a block at a time, with the number of the first cell."""
        cells, step = int(self.o["nc_node_dim"]) ** 3, int(self.o.get("block", CELLS))
        path2, path3 = (re.sub(r"zip0_(\d+\.dat)$", rf"zip{k}_\1", path) for k in (2, 3))
        with store.open_input_file(path2) as f:
            f.seek(block * step)
            for a in range(block * step, cells, step):
                c = np.frombuffer(f.read(min(step, cells - a)), np.uint8).astype(np.int64)
                large = np.flatnonzero(c == 255)
                if len(large):
                    c[large] = large_counts(store, path3, escaped, len(large), self.order)
                    escaped += len(large)
                yield a, c

    def check(self, store: fs.FileSystem, path: str, node: int) -> None:
        n, found = self.number(store, path), sum(int(c.sum()) for _, c in self.counts(store, path))
        sizes = [store.get_file_info(re.sub(r"zip0_(\d+\.dat)$", rf"zip{k}_\1", path)).size for k in (0, 1)]
        if found != n or sizes != [64 + 3 * n, 64 + 6 * n]:
            raise ValueError(f"zip files of node {node}: {n} rows, {found} in cells, {sizes[0]} and {sizes[1]} bytes")

    def scan(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, path = self.store(), partition.path
        if partition.first == 0:
            self.check(store, path, partition.node)
        if partition.first == partition.last:
            return
        scale, nc = float(self.o["mesh_scale"]), int(self.o["nc_node_dim"])
        with store.open_input_file(path) as f0, store.open_input_file(re.sub(r"zip0_(\d+\.dat)$", r"zip1_\1", path)) as f1:
            unit = float(np.frombuffer(f0.read(64), f"{self.order}f4")[VELOCITY_WORD])
            f0.seek(64 + 3 * partition.first)
            f1.seek(64 + 6 * partition.first)
            block, before, escaped = partition.start
            for cell0, c in self.counts(store, path, block, escaped):
                upto = before + np.cumsum(c)
                a, z = max(partition.first, before), min(partition.last, int(upto[-1]))
                for s in range(a, z, BATCH):
                    n = min(BATCH, z - s)
                    cell = cell0 + np.searchsorted(upto, np.arange(s, s + n), side="right")
                    corner = np.stack([cell % nc, cell // nc % nc, cell // nc**2], axis=1)
                    inside = (np.frombuffer(f0.read(3 * n), np.uint8).reshape(n, 3) + 0.5) / 256
                    v = np.frombuffer(f1.read(6 * n), f"{self.order}i2").reshape(n, 3) / unit
                    yield self.particles(partition.node, s, scale * (inside + corner) - self.shift, v)
                before = int(upto[-1])
                if before >= partition.last:
                    break


class HaloReader(_Reader):
    """More options: boxsize, mass_def (vir or 200c), layout (22 or 17), pids (true if ids follow a record)."""

    kind, key = "halo", "hid"

    def __init__(self, options):
        super().__init__(options)
        self.layout = int(self.o.get("layout", HALO22))
        self.head = 12 if self.layout == HALO22 else 4
        self.size = 4 * self.layout + (PID_BYTES if self.o.get("pids", "false") == "true" else 0)
        self.at = MASS_AND_RADIUS[self.o.get("mass_def", "vir")] if self.layout == HALO22 else MASS_AND_RADIUS_17

    def rows(self, store, path, node):
        return max(0, store.get_file_info(path).size - self.head) // self.size

    def scan(self, partition: Range) -> Iterator[pa.RecordBatch]:
        step = max(1, (BATCH * 48) // self.size)
        with self.store().open_input_file(partition.path) as f:
            f.seek(self.head + self.size * partition.first)
            for a in range(partition.first, partition.last, step):
                n = min(step, partition.last - a)
                raw = np.frombuffer(f.read(n * self.size), np.uint8).reshape(n, self.size)[:, : 4 * self.layout]
                rec = np.ascontiguousarray(raw).view(f"{self.order}f4").astype(np.float64).reshape(n, self.layout)
                at = np.fmod(rec[:, :3], float(self.o["boxsize"])) - self.shift
                mass, radius = self.at
                yield _columns(partition.node, a, {c: at[:, i] for i, c in enumerate("xyz")} | {"r": rec[:, radius], "mass": rec[:, mass]}, "hid")


class GridReader(_Reader):
    """Cells of `<base><kind><node>.dat`, or of the one file base where kind is empty. More options: components, words (of the header)."""

    key, plane = None, "iz"

    def __init__(self, options):
        super().__init__(options)
        self.words, self.components = int(self.o.get("words", 1)), int(self.o.get("components", 1))

    def files(self):
        return grid_files(self.o["base"], self.o["kind"]) if self.o.get("kind") else {0: opened(self.o["base"])[1]}

    def rows(self, store, path, node):
        cells, size = self.number(store, path) ** 3, store.get_file_info(path).size
        if size != 4 * self.words + 4 * self.components * cells:
            raise ValueError(f"{path}: {cells} cells in {size} bytes")
        return cells

    def scan(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store = self.store()
        nc = self.number(store, partition.path)
        with store.open_input_file(partition.path) as f:
            f.seek(4 * self.words + 4 * self.components * partition.first)
            for a in range(partition.first, partition.last, BATCH):
                n = min(BATCH, partition.last - a)
                v = np.frombuffer(f.read(4 * n * self.components), f"{self.order}f4").reshape(n, self.components).astype(np.float64)
                at = np.arange(a, a + n)
                place = {"ix": at % nc, "iy": at // nc % nc, "iz": at // nc**2}
                yield _columns(partition.node, a, {k: x.astype(np.int32) for k, x in place.items()} | {f"v{i}": v[:, i] for i in range(self.components)}, None)


class CombinedReader(GridReader):
    """Cells of `<base><node>.dat` with planes n, halo and c, then momenta by cell, after nc, the floats of a cell and the box's size."""

    def files(self):
        return grid_files(self.o["base"], "")

    def rows(self, store, path, node):
        cells, size = self.number(store, path) ** 3, store.get_file_info(path).size
        if size != 12 + 24 * cells:
            raise ValueError(f"{path}: {cells} cells in {size} bytes")
        return cells

    def scan(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with self.store().open_input_file(partition.path) as f:
            head = f.read(12)
            nc, dof = np.frombuffer(head, f"{self.order}i4", 2).tolist()
            box = float(np.frombuffer(head, f"{self.order}f4", 1, 8)[0])
            for a in range(partition.first, partition.last, BATCH):
                at = np.arange(a, min(a + BATCH, partition.last))

                def plane(k, per):
                    f.seek(12 + 4 * (k * nc**3 + per * at[0]))  # noqa: B023
                    return np.frombuffer(f.read(4 * per * len(at)), f"{self.order}f4").astype(np.float64)  # noqa: B023

                v = plane(3, 3).reshape(-1, 3)
                place = {"ix": at % nc, "iy": at // nc % nc, "iz": at // nc**2, "dof": np.full(len(at), dof)}
                values = {c: plane(k, 1) for k, c in enumerate(("n", "halo", "c"))} | {f"v{x}": v[:, i] for i, x in enumerate("xyz")}
                yield _columns(partition.node, a, {k: x.astype(np.int32) for k, x in place.items()} | {"box": np.full(len(at), box)} | values, None)


class HeaderReader(_Reader):
    """Row counts from the first word of each snapshot file; nothing else is read. Option kind: xv or zip0_."""

    def files(self):
        return node_files(self.o["base"], self.o["redshift"] + self.o.get("kind", "xv") + "{}.dat")

    key = None

    def partitions(self):
        return [Range(node, path, 0, 1) for node, path in self.wanted_files()]

    def scan(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield _columns(partition.node, 0, {"np": np.array([self.number(self.store(), partition.path)], np.int64)}, None)


class _Source(DataSource):
    def reader(self, schema):
        return self.made(self.options)

    def writer(self, schema, overwrite):
        return RangeWriter(self.options, self.layouts(), cells=self.cells())

    def cells(self):
        """Columns that place a cell, and cells on an axis; None where records are numbered by column at."""
        return None

    def schema(self):
        return self.columns


class XvSource(_Source):
    """Written from node, n (rows of the node), at (from 0) and the six numbers of a row. Option redshift."""

    made, columns = XvReader, ROWS

    def layouts(self):
        return [FileLayout("{node}/" + self.options["redshift"] + "xv{node}.dat", [(c, "f4") for c in ("x", "y", "z", "vx", "vy", "vz")], XV_HEADER_BYTES, (XV_HEADER_BYTES, 24), [(0, 0, ["n"])], counted=True)]

    @classmethod
    def name(cls):
        return "snapshot_xv"


class SnapshotStream(DataSourceStreamReader):
    """Rows of the snapshots of a list of redshifts that grows line by line; an offset is how many lines have been read."""

    def __init__(self, options: dict):
        self.o = dict(options)

    def redshifts(self) -> list[str]:
        store, path = opened(self.o["redshifts"])
        with store.open_input_file(path) as f:
            text = f.read().decode()
        # a line counts once it is whole
        return [line.split()[0] for line in text[: text.rfind("\n") + 1].splitlines() if line.strip()]

    def initialOffset(self) -> dict:
        return {"lines": 0}

    def latestOffset(self) -> dict:
        return {"lines": len(self.redshifts())}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for z in self.redshifts()[start["lines"] : end["lines"]]:
            for r in XvReader(self.o | {"redshift": z}).partitions():
                r.redshift = z
                out.append(r)
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for batch in XvReader(self.o | {"redshift": partition.redshift}).read(partition):
            yield batch.append_column("redshift", pa.array([partition.redshift] * batch.num_rows))

    def commit(self, end: dict) -> None:
        pass


class SnapshotStreamSource(DataSource):
    """Options: base, redshifts (a file of lines), order, shift, range."""

    @classmethod
    def name(cls):
        return "snapshot_stream"

    def schema(self):
        return f"{ROWS}, redshift string"

    def streamReader(self, schema):
        return SnapshotStream(self.options)


class ZipSource(_Source):
    made, columns = ZipReader, ROWS

    @classmethod
    def name(cls):
        return "snapshot_zip"


class HaloSource(_Source):
    """Written from node, n, at, x, y, z, mass and r; other fields are 0. Options redshift, layout (22 or 17), pids, mass_def."""

    made, columns = HaloReader, "node int, hid bigint, x double, y double, z double, r double, mass double"

    def layouts(self):
        layout = int(self.options.get("layout", HALO22))
        head, stride = 12 if layout == HALO22 else 4, 4 * layout + (PID_BYTES if self.options.get("pids", "false") == "true" else 0)
        mass, radius = MASS_AND_RADIUS[self.options.get("mass_def", "vir")] if layout == HALO22 else MASS_AND_RADIUS_17
        fields = [(c, "f4") for c in ("x", "y", "z", "mass", "r")]
        return [FileLayout("{node}/" + self.options["redshift"] + "halo{node}.dat", fields, head, (head, stride), [], stride, [0, 4, 8, 4 * mass, 4 * radius], True)]

    @classmethod
    def name(cls):
        return "halo_catalogue"


class GridSource(_Source):
    """Written by option layout, of cells with nc on an axis:

    separate: node, ix, iy, iz and the columns of `planes` (by default those of a normalised mesh), each kind a file;
    combined: the same in one file, nc, 6, the box's size, then planes n, halo and c and the momenta by cell;
    global: gx, gy, gz and the columns of option columns in the one file base, after three words nc.
    """

    made = GridReader

    def cells(self):
        return (["gx", "gy", "gz"] if self.options.get("layout") == "global" else ["ix", "iy", "iz"]), int(self.options["nc"])

    def layouts(self):
        nc, layout = int(self.options["nc"]), self.options.get("layout", "separate")
        fields = lambda columns: [(c, "f4") for c in columns]
        if layout == "global":
            columns = self.options["columns"].split(",")
            return [FileLayout("", fields(columns), 12, (12 + 4 * len(columns) * nc**3, 0), [(0, 0, [("i4", nc)] * 3)])]
        if layout == "combined":
            size = (12 + 24 * nc**3, 0)
            head = [(0, 0, [("i4", nc), ("i4", 6), ("f4", float(self.options["boxsize"]))])]
            planes = [FileLayout("{node}.dat", fields([c]), 12 + 4 * k * nc**3, size) for k, c in enumerate(("n", "halo", "c"))]
            return [*planes, FileLayout("{node}.dat", fields(("vx", "vy", "vz")), 12 + 12 * nc**3, size, head)]
        return [FileLayout(kind + "{node}.dat", fields(columns), 4, (4 + 4 * len(columns) * nc**3, 0), [(0, 0, [("i4", nc)])]) for kind, columns in PLANES.items()]

    @classmethod
    def name(cls):
        return "grid_file"

    def schema(self):
        return "node int, ix int, iy int, iz int, " + ", ".join(f"v{i} double" for i in range(int(self.options.get("components", 1))))


class CombinedSource(_Source):
    made, columns = CombinedReader, "node int, ix int, iy int, iz int, dof int, box double, n double, halo double, c double, vx double, vy double, vz double"

    @classmethod
    def name(cls):
        return "combined_grid"


class CatalogueReader(_Reader):
    """Groups of `<base><node>.dat`: count, record size, records, count."""

    key = None

    def files(self):
        return grid_files(self.o["base"], "")

    def record(self) -> np.dtype:
        return np.dtype([("m", f"{self.order}f4", 6), ("n", f"{self.order}i4")])

    def rows(self, store, path, node):
        with store.open_input_file(path) as f:
            n, size = np.frombuffer(f.read(8), f"{self.order}i4").tolist()
            if size != self.record().itemsize:
                raise ValueError(f"{path}: records of {size} bytes")
            f.seek(8 + n * size)
            if np.frombuffer(f.read(4), f"{self.order}i4").tolist() != [n]:
                raise ValueError(f"{path}: the counts at both ends differ")
        return n

    def scan(self, partition: Range) -> Iterator[pa.RecordBatch]:
        kind = self.record()
        with self.store().open_input_file(partition.path) as f:
            f.seek(8 + kind.itemsize * partition.first)
            for a in range(partition.first, partition.last, BATCH):
                rec = np.frombuffer(f.read(kind.itemsize * min(BATCH, partition.last - a)), kind)
                yield _columns(partition.node, a, {c: rec["m"][:, i].astype(np.float64) for i, c in enumerate(("x", "y", "z", "vx", "vy", "vz"))} | {"nfof": rec["n"].astype(np.int32)}, None)


class CatalogueSource(_Source):
    """Written from node, n (groups of the node), at, mean position and velocity, and nfof."""

    made, columns = CatalogueReader, "node int, x double, y double, z double, vx double, vy double, vz double, nfof int"

    @classmethod
    def name(cls):
        return "group_catalogue"

    def layouts(self):
        fields = [*((c, "f4") for c in ("x", "y", "z", "vx", "vy", "vz")), ("nfof", "i4")]
        return [FileLayout("{node}.dat", fields, 8, (12, 28), [(0, 0, ["n", ("i4", 28)]), (8, 28, ["n"])], counted=True)]


class HistogramReader(_Reader):
    """Bins of the one file base: bounds, bins, all rows, sum of values, counts."""

    key = None

    def files(self):
        return {0: opened(self.o["base"])[1]}

    def rows(self, store, path, node):
        with store.open_input_file(path) as f:
            return int(np.frombuffer(f.read(12), f"{self.order}i4")[2])

    def scan(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with self.store().open_input_file(partition.path) as f:
            head = f.read(24)
            (low, high), bins = np.frombuffer(head, f"{self.order}f4", 2).tolist(), int(np.frombuffer(head, f"{self.order}i4", 1, 8)[0])
            ntot, total = int(np.frombuffer(head, f"{self.order}i8", 1, 12)[0]), float(np.frombuffer(head, f"{self.order}f4", 1, 20)[0])
            f.seek(24 + 4 * partition.first)
            n = np.frombuffer(f.read(4 * (partition.last - partition.first)), f"{self.order}i4").astype(np.int64)
        at, width = np.arange(partition.first, partition.last), (high - low) / bins
        yield pa.RecordBatch.from_pydict({"bin": pa.array(at.astype(np.int32)), "low": low + at * width, "high": low + (at + 1) * width, "n": n, "ntot": np.full(len(at), ntot), "total": np.full(len(at), total)})


class HistogramSource(_Source):
    """Written from at (the bin) and n. Options low, high, bins, ntot, total."""

    made, columns = HistogramReader, "bin int, low double, high double, n bigint, ntot bigint, total double"

    @classmethod
    def name(cls):
        return "histogram_file"

    def layouts(self):
        o, bins = self.options, int(self.options["bins"])
        head = [("f4", float(o["low"])), ("f4", float(o["high"])), ("i4", bins), ("i8", int(o["ntot"])), ("f4", float(o["total"]))]
        return [FileLayout("", [("n", "i4")], 24, (24 + 4 * bins, 0), [(0, 0, head)])]


class HeaderSource(_Source):
    made, columns = HeaderReader, "node int, np bigint"

    @classmethod
    def name(cls):
        return "snapshot_header"


def load(spark: SparkSession, source: type[DataSource], **options) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**{k: json.dumps(v or {}) if isinstance(v, dict) or k == "where" else ",".join(map(str, v)) if isinstance(v, tuple) else str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}).load()


def read_xv(spark: SparkSession, base: str, redshift: str, shift: tuple[float, float, float] = (0, 0, 0), order: str = "<", rows: int = RANGE, where: dict | None = None) -> DataFrame:
    """Rows of xv snapshots: a header of 48 bytes, then six floats a row. Raises if a file is shorter than its header says.

    where has bounds on node and pid, such as {"node": (3, 3)}: only files and ranges within them are read.
    """
    return load(spark, XvSource, base=base, redshift=redshift, shift=shift, order=order, range=rows, where=where)


def read_headers(spark: SparkSession, base: str, redshift: str, kind: str = "xv", order: str = "<") -> DataFrame:
    """node and np of each snapshot file; kind is xv or zip0_."""
    return load(spark, HeaderSource, base=base, redshift=redshift, kind=kind, order=order)


def zip_index(spark: SparkSession, base: str, redshift: str, nc_node_dim: int, order: str = "<", block: int = CELLS) -> str:
    """Writes where each block of coarse cells of each node begins, in rows and in large counts, and returns its path.

    Blocks are counted side by side; each file of counts is read once, however many ranges are read with the index.
    """
    from lumengrid.session import scratch

    files, cells = node_files(base, redshift + "zip0_{}.dat"), nc_node_dim**3
    nodes = spark.createDataFrame(sorted(files.items()), "node int, path string")
    todo = nodes.select("node", "path", F.explode(F.sequence(F.lit(0), F.lit((cells - 1) // block))).alias("block"))
    todo = todo.repartition("node", "block")

    def small(batches):
        store = opened(base)[0]
        for batch in batches:
            sums = []
            for path, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                with store.open_input_file(re.sub(r"zip0_(\d+\.dat)$", r"zip2_\1", path)) as f:
                    f.seek(k * block)
                    c = np.frombuffer(f.read(min(block, cells - k * block)), np.uint8)
                sums.append((int(c[c < 255].sum(dtype=np.int64)), int((c == 255).sum())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([s[i] for s in sums], pa.int64()) for i in range(2))], [*batch.schema.names, "small", "large"])

    def big(batches):
        store = opened(base)[0]
        for batch in batches:
            path, first, n = (batch.column(i).to_pylist() for i in (1, 5, 4))
            sums = [int(large_counts(store, re.sub(r"zip0_(\d+\.dat)$", r"zip3_\1", p), a, m, order).sum()) if m else 0 for p, a, m in zip(path, first, n, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.array(sums, np.int64) + batch.column(3).to_numpy()), batch.column(5)], ["node", "block", "n", "escaped"])

    counted = todo.mapInArrow(small, "node int, path string, block int, small bigint, large bigint")
    before = Window.partitionBy("node").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    counted = counted.withColumn("escaped", upto("large")).mapInArrow(big, "node int, block int, n bigint, escaped bigint")
    t = counted.select(F.col("node").cast("bigint"), F.col("block").cast("bigint"), upto("n").alias("before"), "escaped").orderBy("node", "block").toArrow()  # 32 bytes for each block of cells
    path = f"{scratch(spark)}/zip-index-{uuid.uuid4().hex}.npy"
    held = io.BytesIO()
    np.save(held, np.stack([c.to_numpy() for c in t.columns], 1))
    store, at = opened(path)
    with store.open_output_stream(at) as f:
        f.write(held.getvalue())
    return path


def read_zip(spark: SparkSession, base: str, redshift: str, nc_node_dim: int, mesh_scale: float, shift: tuple[float, float, float] = (0, 0, 0), order: str = "<", rows: int = RANGE, block: int = CELLS, where: dict | None = None) -> DataFrame:
    """Rows of zipped snapshots. Raises if the counts don't add up to the header's rows or a file has another size than they ask for.

    Nodes of several blocks of cells get an index first, so that a range reads the counts of its own cells only. The check is
    made where a node's first rows are read.
    """
    index = zip_index(spark, base, redshift, nc_node_dim, order, block) if nc_node_dim**3 > block else ""
    return load(spark, ZipSource, base=base, redshift=redshift, nc_node_dim=nc_node_dim, mesh_scale=mesh_scale, shift=shift, order=order, range=rows, block=block, index=index, where=where)


def read_halos(spark: SparkSession, base: str, redshift: str, boxsize: float, mass_def: str = "vir", layout: int = HALO22, pids: bool = False, shift: tuple[float, float, float] = (0, 0, 0), order: str = "<") -> DataFrame:
    """node, hid, x, y, z, r, mass of halo catalogues; positions folded into the box. A cut last record is left out."""
    return load(spark, HaloSource, base=base, redshift=redshift, boxsize=boxsize, mass_def=mass_def, layout=layout, pids=pids, shift=shift, order=order)


def read_grid(spark: SparkSession, base: str, kind: str, components: int = 1, order: str = "<", words: int = 1, rows: int = RANGE, where: dict | None = None) -> DataFrame:
    """node, ix, iy, iz and v0, v1, ... of grid files `<base><kind><node>.dat`: a header whose first word is the cells per axis, then values, x fastest.

    With an empty kind, base is one file (node 0). Raises if a file has another size than its header asks for. where has
    bounds on node and iz.
    """
    return load(spark, GridSource, base=base, kind=kind, components=components, order=order, words=words, range=rows, where=where)


def read_combined(spark: SparkSession, base: str, order: str = "<", rows: int = RANGE) -> DataFrame:
    """Cells of combined grid files `<base><node>.dat`, with the header's dof and box. Raises if a file has another size than its header asks for."""
    return load(spark, CombinedSource, base=base, order=order, range=rows)


def read_redshifts(spark: SparkSession, path: str) -> DataFrame:
    """redshift (as written) and z of the first token of each line."""
    first = spark.read.text(path).select(F.regexp_extract("value", r"^\s*(\S+)", 1).alias("redshift")).where("redshift <> ''")
    return first.withColumn("z", F.expr("try_cast(redshift AS double)"))


def read_shift(spark: SparkSession, path: str) -> tuple[float, float, float]:
    """Shift from a line `z sx sy sz`; zeros if there is no such file."""
    from pyspark.errors import AnalysisException

    try:
        lines = spark.read.text(path).head(1)
    except AnalysisException:
        return (0.0, 0.0, 0.0)
    return tuple(float(x) for x in lines[0].value.split()[1:4]) if lines else (0.0, 0.0, 0.0)
