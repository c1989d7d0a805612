"""Packs: rows in compressed bodies of a few megabytes, which exchange short messages by way of buckets.

Operators that must know of every item of a pack what other packs hold (lines, words, contexts) send the items'
hashes to the bucket of their value and get an answer in the same order; bodies aren't sent.
"""

from __future__ import annotations

import ctypes
import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

from sievelight.llm.bpe import byte_batches


def lean(run: Callable) -> Callable:
    """An Arrow function that gives freed memory back when its task ends: a Python worker stays for the tasks to come."""

    @functools.wraps(run)
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return own


def pack_rows(limit: int):
    """Rows, whose third column is the text, to (pack, body): about limit bytes of texts as a compressed Arrow stream."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = TaskContext.get().partitionId() << 32
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in byte_batches(sizes, limit):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
                    out.write_batch(pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(lo, hi - lo)]) for c in b.columns], schema=b.schema))
                yield pa.RecordBatch.from_arrays([pa.array([pack]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["pack", "body"])
                pack += 1

    return run


def unpack(body: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(body).read_next_batch()


def cuts(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets, ranges of the upper half of a hash, begin and end among sorted hashes."""
    return np.searchsorted((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))


def runs(batches: Iterator[pa.RecordBatch], width: int = 1) -> Iterator[list[tuple]]:
    """Rows that agree in the first width columns, as they come."""
    held: list[tuple] = []
    for b in batches:
        for i in range(b.num_rows):
            r = tuple(c[i].as_py() for c in b.columns)
            if held and held[0][:width] != r[:width]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def press(x: np.ndarray, kind: str = "<u4") -> bytes:
    return zlib.compress(np.asarray(x).astype(kind).tobytes(), 1)


def loose(b: bytes, kind: str = "<u4") -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), kind)
