"""Texts of Arrow batches as runs of bytes, and hashes of their substrings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a run of its own.
RUN = 1 << 20
#: Odd multipliers of the substring hashes, and what single bytes stand for in them.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_M64 = (1 << 64) - 1
_VALUES = np.random.default_rng(20).integers(1, 1 << 63, (2, 256), dtype=np.uint64) | np.uint64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def text_runs(column: pa.Array, most: int = RUN) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of an Arrow string or binary column: first row, row after the last, bytes, starts (one more than rows).

    Nulls are empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    n = len(column)
    starts = np.frombuffer(at, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:  # a null may have bytes under it
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        if (np.diff(starts)[~valid] > 0).any():
            yield from text_runs(pa.array([b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()], pa.binary()), most)
            return
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(starts, starts[row] + most, "right")) - 1)
        yield row, end, held[starts[row] : starts[end]], starts[row : end + 1] - starts[row]
        row = end


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a hash's bits over all of it."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        size = max(n, RUN + 4096)
        _POWERS[which] = tuple(np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size - 1, b, np.uint64))]) for b in (BASES[which], pow(BASES[which], -1, 1 << 64)))
    return _POWERS[which]


class Substrings:
    """Hashes of any substring of a run, from sums of its bytes' values times powers."""

    def __init__(self, held: np.ndarray, which: int = 0):
        up, self.down = _powers(len(held) + 1, which)
        self.sums = np.zeros(len(held) + 1, np.uint64)
        np.cumsum(_VALUES[which][held] * up[: len(held)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def fixed(self, length: int) -> np.ndarray:
        """Hashes of all substrings of one length, by start."""
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n])


def piece_hashes(held: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Hashes of pieces (starts and ends in order), of about RUN bytes of them at a time."""
    out, i = np.zeros(len(a), np.uint64), 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(a, a[i] + RUN)))
        out[i:j] = Substrings(held[a[i] : z[j - 1]]).of(a[i:j] - a[i], z[i:j] - a[i])
        i = j
    return out
