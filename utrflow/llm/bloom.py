"""A two-pass Bloom filter of hashes that may occur more than once.

Pass one fills saturating two-bit counters (0, 1, "2 or more") task by task and adds them up segment by segment. Pass two
asks whether all cells of a hash have reached 2: always so for a hash that occurs twice, seldom for one that occurs once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 4
SEGMENT = 1 << 20
#: Up to so many hashes (half a megabyte) are counted on the driver.
FEW = 1 << 16
#: Cells of each of the HASHES regions: at most so many, whatever the data; 4 * 2^27 bits make the 64 MB that are broadcast.
MAX_CELLS = 1 << 27


def cells_for(rows: int) -> int:
    """About 4 cells a row and region (a quarter of a percent of single hashes then pass), within MAX_CELLS.

    With more than 32 million rows the filter keeps its size and more single hashes pass; the result never changes.
    """
    return int(min(MAX_CELLS, max(1 << 16, 1 << (4 * max(rows, 1) - 1).bit_length())))


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    x = h.astype(np.uint64) ^ np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cells(h: np.ndarray, cells: int) -> np.ndarray:
    """HASHES cells for each hash, each in a region of its own, so that a hash never counts twice in a cell."""
    return np.stack([(_mixed(h, j) & np.uint64(cells - 1)).astype(np.int64) + j * cells for j in range(HASHES)])


def _packed(cells: np.ndarray) -> bytes:
    return zlib.compress(np.diff(cells, prepend=0).astype("<u4").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64))


def repeated_filter(hashes: DataFrame, column: str, rows: int, least: int = 2) -> bytes:
    """The packed bits of cells that at least two of the ``rows`` hashes in ``column`` hit (one, if ``least`` is 1). Null hashes are left out."""
    cells = cells_for(rows)

    if rows <= FEW:
        at, n = np.unique(_cells(hashes.select(column).toArrow().column(0).drop_null().to_numpy(), cells), return_counts=True)
        table = np.zeros(max(SEGMENT, cells * HASHES), bool)
        table[at[n >= least]] = True
        return np.packbits(table).tobytes()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b.column(0).drop_null().to_numpy(zero_copy_only=False) for b in batches]
        if not got or not (h := np.concatenate(got)).size:
            return
        at, n = np.unique(_cells(h, cells), return_counts=True)
        segment = at // SEGMENT
        edges = np.flatnonzero(np.diff(segment, prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(at)], strict=True):
            own, many = at[a:b] - segment[a] * SEGMENT, n[a:b] >= least
            yield pa.RecordBatch.from_pydict({"segment": pa.array([segment[a]], pa.int64()), "once": pa.array([_packed(own)], pa.binary()), "twice": pa.array([_packed(own[many])], pa.binary())})

    def merged(_key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice, key = np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool), None
        for b in batches:
            for k, o, t in zip(b["segment"].to_pylist(), b["once"].to_pylist(), b["twice"].to_pylist(), strict=True):
                key, own = k, _unpacked(o)
                twice[own[once[own]]] = True
                twice[_unpacked(t)] = True
                once[own] = True
        yield pa.RecordBatch.from_pydict({"segment": pa.array([key], pa.int64()), "bits": pa.array([zlib.compress(np.packbits(twice).tobytes(), 1)], pa.binary())})

    parts = hashes.select(column).mapInArrow(partial, "segment long, once binary, twice binary").groupBy("segment").applyInArrow(merged, "segment long, bits binary")
    bits = np.zeros(max(SEGMENT, cells * HASHES) // 8, np.uint8)
    for r in parts.collect():  # no more than MAX_CELLS allow; an iterator would run a job for each partition
        part = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
        at = r["segment"] * (SEGMENT // 8)
        bits[at : at + len(part)] = part[: len(bits) - at]
    return bits.tobytes()


def hits(table: np.ndarray, h: np.ndarray, cells: int) -> np.ndarray:
    """Whether all cells of each hash are set in the packed bits."""
    at = _cells(h, cells)
    return ((table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)


def may_repeat(spark, bits: bytes, rows: int, column: str) -> Column:
    """True where the hash in ``column`` may occur more than once; false only where it surely doesn't. Null gives false."""
    shared, cells = spark.sparkContext.broadcast(bits), cells_for(rows)

    @F.pandas_udf("boolean")
    def test(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = np.frombuffer(shared.value, np.uint8)
        for s in batches:
            yield pd.Series(hits(table, s.to_numpy(), cells))

    # nulls stay out of the batches: with one, pandas would make all its hashes floating-point numbers and round them
    return F.col(column).isNotNull() & test(F.coalesce(F.col(column), F.lit(0)))
