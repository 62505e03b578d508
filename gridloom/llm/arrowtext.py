"""Array kernels over Arrow text columns: words, pre-tokens and rolling hashes without a Python loop per word."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes that separate words: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Each byte, A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: An odd multiplier and its inverse modulo 2**64, for each of two rolling hashes.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))
U = np.uint64


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker, which Spark keeps for other tasks, gives the memory that it has freed back."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim:
            trim(0)

    return whole


#: Rows of a slice at most, so that a row's number in its slice has 14 bits however large Arrow batches are.
ROWS = 1 << 14


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts have about `limit` bytes together (one row at least, ROWS at most)."""
    n = batch.num_rows
    if not n:
        return
    _, off = raw(batch.column(column))
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        end = min(end, n, at + ROWS)
        yield batch.slice(at, end - at)
        at = end


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without nulls; offsets index the bytes."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def lowered(col: pa.Array) -> pa.Array:
    """The texts as binary, with ASCII letters in lower case."""
    data, off = raw(col)
    return pa.BinaryArray.from_buffers(pa.binary(), len(col), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(LOWER[data])])


class Words:
    """Words of the rows of a text column: byte spans, the row of each, and ids into a dictionary of distinct words."""

    def __init__(self, col: pa.Array, apart: np.ndarray = SPACE):
        """apart: which bytes separate words."""
        self.data, self.off = raw(col)
        d, off = self.data, self.off
        solid = ~apart[d]
        first = np.zeros(len(d) + 1, bool)
        first[off] = True
        left = np.empty(len(d), bool)
        left[:1] = True
        left[1:] = ~solid[:-1]
        right = np.empty(len(d), bool)
        right[-1:] = True
        right[:-1] = ~solid[1:]
        self.start = np.flatnonzero(solid & (left | first[:-1]))
        self.end = np.flatnonzero(solid & (right | first[1:])) + 1
        self.bound = np.searchsorted(self.start, off)  # words of row r: bound[r]..bound[r+1]
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(self.bound))
        self.solid = solid

    def encode(self) -> tuple[np.ndarray, pa.Array]:
        """(index of each word, dictionary of distinct words as binary)."""
        packed = self.data[self.solid]
        o = np.zeros(len(self.start) + 1, np.int32)
        np.cumsum(self.end - self.start, out=o[1:])
        a = pa.BinaryArray.from_buffers(pa.binary(), len(self.start), [None, pa.py_buffer(o), pa.py_buffer(packed)])
        e = a.dictionary_encode()
        return e.indices.to_numpy(zero_copy_only=False), e.dictionary

    def hashes(self, seeds: tuple[int, ...] = (0,)) -> list[np.ndarray]:
        """A 64-bit hash of each word, for each seed."""
        idx, words = self.encode()
        w = words.to_pylist()
        return [np.fromiter((xxhash.xxh3_64_intdigest(x, s) for x in w), U, len(w))[idx] for s in seeds]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a rolling hash depend on all of its input."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


class Rolling:
    """Hashes of any span of a sequence from prefix sums of h[i] * B**i modulo 2**64."""

    def __init__(self, h: np.ndarray, which: int = 0):
        n = len(h)
        with np.errstate(over="ignore"):
            base = BASES[which]
            inverse = U(pow(int(base), -1, 1 << 64))
            up = np.full(n + 1, base, U)
            up[0] = 1
            down = np.full(n + 1, inverse, U)
            down[0] = 1
            self.sums = np.zeros(n + 1, U)
            np.cumsum(h.astype(U) * np.cumprod(up, dtype=U)[:n], dtype=U, out=self.sums[1:])
            self.down = np.cumprod(down, dtype=U)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(U).view(np.int64)


def strings(items: list, kind: pa.DataType) -> pa.Array:
    return pa.array(items, kind)
