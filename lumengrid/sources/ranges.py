"""Writers of binary files by ranges of records: tasks write side by side, the driver only commits.

A row says which node's file it goes to and at what place; each task writes the runs of records that it has where they belong.
Files grow under a scratch folder beside their own. When all tasks are done the driver moves them to their names and writes
the manifest, last of all; if the job fails it removes the folder, so nothing is left. A task that runs again writes the same
bytes to the same places. Places that no row has are zeros.

Files on a mounted folder are written in place. On other stores, which can't write inside a file, tasks leave a piece for each
run, and the commit puts the pieces of a file together.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

#: Bytes that are copied at once.
PIECE = 1 << 22


@dataclass
class FileLayout:
    """One file for each node: its name after base, and where its records are.

    columns: names and kinds (as of numpy) of a record's fields; start, stride: bytes before the first record and from one to
    the next. heads: (a, b, words) for words that stand at byte a + b * n, n being the column of that name; a word is a kind and
    a value, or n itself. size: (a, b) for a file of a + b * n bytes.
    """

    name: str
    columns: list[tuple[str, str]]
    start: int
    size: tuple[int, int]
    heads: list[tuple[int, int, list]] = field(default_factory=list)
    stride: int | None = None
    places: list[int] | None = None
    counted: bool = False

    def record(self, order: str) -> np.dtype:
        kinds = [order + k for _, k in self.columns]
        at = self.places or np.cumsum([0, *(np.dtype(k).itemsize for k in kinds)])[:-1].tolist()
        return np.dtype({"names": [f"f{i}" for i in range(len(kinds))], "formats": kinds, "offsets": at, "itemsize": self.stride or sum(np.dtype(k).itemsize for k in kinds)})


@dataclass
class Written(WriterCommitMessage):
    """Files that a task wrote to: by name the number of the layout, n, and the sum of words."""

    files: dict


def written_in_place(store: fs.FileSystem) -> bool:
    """Whether tasks can write inside one file: on a mounted folder."""
    return isinstance(store, fs.LocalFileSystem)


class Scratch:
    """Files that grow in a folder, by name."""

    def __init__(self, uri: str):
        self.store, self.root = fs.FileSystem.from_uri(uri)
        self.local, self.open = written_in_place(self.store), {}
        self.store.create_dir(self.root, recursive=True)

    def path(self, name: str) -> str:
        return f"{self.root}/%{name.replace('/', '%')}"

    def put(self, name: str, offset: int, content: bytes) -> int:
        """Writes content at offset; returns its sum of words."""
        if self.local:
            if name not in self.open:
                self.open[name] = os.open(self.path(name), os.O_CREAT | os.O_WRONLY, 0o644)
            os.pwrite(self.open[name], content, offset)
        else:
            with self.store.open_output_stream(f"{self.path(name)}@{offset}") as f:
                f.write(content)
        return word_sums(content, offset)

    def finish(self, name: str, size: int, path: str) -> None:
        """Moves a file of size bytes to its path."""
        self.store.create_dir(path.rpartition("/")[0], recursive=True)
        if self.local:
            os.truncate(self.path(name), size)
            self.store.move(self.path(name), path)
            return
        own = self.path(name)
        pieces = sorted((int(x.path.rpartition("@")[2]), x.path) for x in self.store.get_file_info(fs.FileSelector(self.root)) if x.path.rpartition("@")[0] == own)
        with self.store.open_output_stream(path) as out:
            end = 0
            for offset, piece in pieces:
                out.write(bytes(offset - end))
                with self.store.open_input_file(piece) as f:
                    while content := f.read(PIECE):
                        out.write(content)
                        end = offset + f.tell()
            out.write(bytes(size - end))

    def close(self) -> None:
        for f in self.open.values():
            os.close(f)
        self.open = {}


def word_sums(content: bytes, offset: int) -> int:
    """Sum of a range's words of 4 bytes, each times an odd number of its place: ranges of a file add up to the file's."""
    if offset % 4 or len(content) % 4:
        return sum(b * ((2 * (offset + i) + 1) * 0x9E3779B97F4A7C15) for i, b in enumerate(content)) % (1 << 64)
    at = np.arange(offset // 4, (offset + len(content)) // 4, dtype=np.uint64)
    return int(np.sum(np.frombuffer(content, "<u4").astype(np.uint64) * ((at * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64))


class RangeWriter(DataSourceArrowWriter):
    """Options: base, order, manifest (a path; none is written without), settings (JSON that the manifest keeps)."""

    def __init__(self, options: dict, layouts: list[FileLayout], node: str = "node", cells: tuple[list[str], int] | None = None):
        """cells: columns of a cell's place on each axis, x first, and cells on an axis; without, column at has records' places."""
        self.base, self.order = options["base"], options.get("order", "<")
        self.manifest, self.settings = options.get("manifest"), options.get("settings", "{}")
        self.layouts, self.node, self.cells = layouts, node, cells
        self.folder = f"{self.base.rpartition('/')[0]}/_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        scratch, seen = Scratch(self.folder), {}
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                cols = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)}
                nodes = cols.get(self.node, np.zeros(batch.num_rows, np.int64))
                if self.cells:
                    (x, y, z), nc = (cols[c].astype(np.int64) for c in self.cells[0]), self.cells[1]
                    at = (z * nc + y) * nc + x
                else:
                    at = cols["at"]
                cuts = np.concatenate([[0], np.flatnonzero((np.diff(nodes) != 0) | (np.diff(at) != 1)) + 1, [batch.num_rows]]).tolist()
                for k, layout in enumerate(self.layouts):
                    kind = layout.record(self.order)
                    rec = np.zeros(batch.num_rows, kind)
                    for i, (c, _) in enumerate(layout.columns):
                        rec[f"f{i}"] = cols[c]
                    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                        name, n = layout.name.format(node=nodes[a]), int(cols["n"][a]) if layout.counted else 0
                        total = scratch.put(name, layout.start + kind.itemsize * int(at[a]), rec[a:z].tobytes())
                        seen[name] = (k, n, (seen.get(name, (k, n, 0))[2] + total) % (1 << 64))
        finally:
            scratch.close()
        return Written(seen)

    def commit(self, messages: list[Written | None]) -> None:
        files: dict[str, tuple[int, int, int]] = {}
        for message in messages:
            for name, (k, n, total) in (message.files if message else {}).items():
                files[name] = (k, n, files.get(name, (k, n, 0))[2] + total)
        scratch, done = Scratch(self.folder), {}
        for name, (k, n, total) in files.items():
            layout = self.layouts[k]
            for a, b, words in layout.heads:
                content = b"".join(np.array([n if w == "n" else w[1]], self.order + ("i4" if w == "n" else w[0])).tobytes() for w in words)
                total += scratch.put(name, a + b * n, content)
            scratch.close()
            size = layout.size[0] + layout.size[1] * n
            scratch.finish(name, size, fs.FileSystem.from_uri(self.base + name)[1])
            done[name] = [size, total % (1 << 64)]
        scratch.store.delete_dir(scratch.root)
        if self.manifest:
            store, path = fs.FileSystem.from_uri(self.manifest)
            store.create_dir(path.rpartition("/")[0], recursive=True)
            made = f"{path}.{uuid.uuid4().hex}"
            with store.open_output_stream(made) as f:
                f.write(json.dumps({"settings": json.loads(self.settings), "base": self.base, "files": done}, sort_keys=True).encode())
            store.move(made, path)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.folder)
        if store.get_file_info(root).type == fs.FileType.Directory:
            store.delete_dir(root)


def committed(manifest: str) -> dict | None:
    """What a manifest says: settings, base, and size and sum of each file; None if it isn't there."""
    store, path = fs.FileSystem.from_uri(manifest)
    if store.get_file_info(path).type != fs.FileType.File:
        return None
    with store.open_input_file(path) as f:
        return json.loads(f.read())


def stale(manifest: str, settings: dict, content: bool = False) -> list[str] | None:
    """Files of a manifest that are not there as they were committed; None if there is none of these settings. With content, files are read."""
    held = committed(manifest)
    if held is None or held["settings"] != json.loads(json.dumps(settings)):
        return None
    store, bad = fs.FileSystem.from_uri(held["base"])[0], []
    for name, (size, total) in held["files"].items():
        path = fs.FileSystem.from_uri(held["base"] + name)[1]
        info = store.get_file_info(path)
        if info.type != fs.FileType.File or info.size != size:
            bad.append(name)
        elif content:
            found, offset = 0, 0
            with store.open_input_file(path) as f:
                while piece := f.read(PIECE):
                    found, offset = (found + word_sums(piece, offset)) % (1 << 64), offset + len(piece)
            if found != total:
                bad.append(name)
    return bad
