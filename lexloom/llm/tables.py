"""Tables of slots, gathered over all rows: how often each slot occurs, or whether it does.

A table has 2^bits slots; the caller chooses ``bits`` by the number of values, up to a bound, so
that what the driver gathers and sends out is bounded too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICES = 256
#: Largest table: 2^25 slots of one byte.
MAX_BITS = 25
#: The largest count that each code of :func:`codes` stands for.
UPPER = np.concatenate([[0], np.floor(2 ** (np.arange(255) / 8) + 1e-6)]).astype(np.int64)


def bits_for(values: float, most: int = MAX_BITS) -> int:
    """Bits of a table with at least as many slots as values, within 2^12 and 2^most."""
    return int(min(most, max(12, np.ceil(np.log2(max(1.0, values))))))


def codes(counts: np.ndarray) -> np.ndarray:
    """Counts in one byte each, by logarithm: exact up to 2, else at most 9 % too large; they never saturate."""
    with np.errstate(divide="ignore"):
        return np.where(counts > 0, 1 + np.ceil(8 * np.log2(counts) - 1e-9), 0).astype(np.uint8)


def packed(batch: pa.RecordBatch) -> np.ndarray:
    """The uint32 values packed in a binary column."""
    return np.frombuffer(b"".join(x for x in batch.column(0).to_pylist() if x), np.uint32)


def _gather(values: DataFrame, bits: int, counted: bool) -> np.ndarray:
    """Each task sends its table in compressed slices, which are merged by slice."""
    size = 1 << bits
    step = size // SLICES

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32 if counted else np.uint8)
        for batch in batches:
            slots, n = np.unique(packed(batch) & np.uint32(size - 1), return_counts=True)
            if counted:
                total[slots] += n.astype(np.uint32)
            else:
                total[slots] = 1
        cut = total.reshape(SLICES, step)
        parts = [(i, zlib.compress(cut[i].tobytes(), 1)) for i in np.flatnonzero(cut.any(1)).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary())], names=["slice", "part"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                more = np.frombuffer(zlib.decompress(part), np.uint32 if counted else np.uint8)
                own = sums.setdefault(i, np.zeros(step, np.int64 if counted else np.uint8))
                np.add(own, more, out=own, casting="unsafe") if counted else np.maximum(own, more, out=own)
        out = [zlib.compress((codes(s) if counted else s).tobytes(), 1) for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array(out, pa.binary())], names=["slice", "part"])

    schema = "slice int, part binary"
    table = np.zeros(size, np.uint8)
    for row in values.mapInArrow(local, schema).repartition("slice").mapInArrow(merge, schema).collect():
        table[row["slice"] * step : (row["slice"] + 1) * step] = np.frombuffer(zlib.decompress(row["part"]), np.uint8)
    return table


def count_codes(values: DataFrame, bits: int) -> np.ndarray:
    """The :func:`codes` of how often the packed uint32 values fall in each slot, value mod 2^bits."""
    return _gather(values, bits, True)


def presence(values: DataFrame, bits: int) -> np.ndarray:
    """1 for each slot in which some packed uint32 value falls, else 0; as bits."""
    return np.packbits(_gather(values, bits, False))
