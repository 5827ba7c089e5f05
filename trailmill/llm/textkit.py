"""Vectorised byte-level text helpers for Arrow batches.

Every function works on one uint8 buffer of many texts and the texts' offsets in it, so that cost
follows bytes, not rows. Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BATCH_BYTES = 4 << 20
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_RNG = np.random.default_rng(20240229)
BYTE_KEY = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = _RNG.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls."""
    if len(_powers.get(int(base), ())) < n:
        with np.errstate(over="ignore"):
            grown = np.full(max(n, 1024), base, dtype=np.uint64)
            grown[0] = 1
            _powers[int(base)] = np.multiply.accumulate(grown)
    return _powers[int(base)][:n]


def running(data: np.ndarray, key: np.ndarray = BYTE_KEY) -> np.ndarray:
    """Sums that give any stretch's hash: (out[j] - out[i]) * INVERSE**i depends on bytes i to j alone."""
    with np.errstate(over="ignore"):
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(key[data] * powers(len(data)), dtype=np.uint64)))


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column one after another, and len + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offs, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, but what it frees goes back to the system: workers outlive their tasks, and so would their memory."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()

        def fed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                pool.release_unused()

        try:
            yield from run(fed())
        finally:
            _powers.clear()
            gc.collect()
            pool.release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return tidy


def bounded(df: DataFrame) -> DataFrame:
    """`df`; batches of its session hold BATCH_BYTES at most from now on, as whole texts fill larger ones fast."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if int(conf.get(key).rstrip("bB")) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def blocks(batch: pa.RecordBatch, text: str, limit: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of about `limit` bytes of `text` (a longer text alone), with their bytes and offsets."""
    data, offsets = buffers(batch.column(text))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the index of its first word (len + 1 values)."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~SEPARATOR[data]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] |= inside[edges + 1]
    last[edges - 1] |= inside[edges]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the disjoint, non-empty, ascending spans."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    heads = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(int(lengths.sum())) - np.repeat(heads, lengths)
    with np.errstate(over="ignore"):
        values = BYTE_KEY[data[np.repeat(starts, lengths) + place]] * powers(int(lengths.max()))[place]
        return mix64(np.add.reduceat(values, heads) + lengths.astype(np.uint64) * MIX[15])


def window_hashes(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `width` words within a text: (index of first word, hash)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            out += h[k : k + n] * MIX[k]
    room = np.repeat(first[1:], np.diff(first))  # for each word, the end of its text
    at = np.flatnonzero(np.arange(n) + width <= room[:n])
    return at, mix64(out[at])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct lower-cased word shingles: ascending hashes text after text, and len + 1 bounds.

    A text of 1 to width - 1 words gives its whole sequence as one shingle; one without words none.
    """
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    h = span_hashes(data, starts, ends)
    at, values = window_hashes(h, first, width)
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    owners = owner[at]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        with np.errstate(over="ignore"):
            total = counts[short].astype(np.uint64) * MIX[14]
            for k in range(width - 1):
                has = counts[short] > k
                total[has] += h[first[short][has] + k] * MIX[5 + k]
        owners, values = np.concatenate((owners, short)), np.concatenate((values, mix64(total)))
    order = np.lexsort((values, owners))
    owners, values = owners[order], values[order]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    owners, values = owners[fresh], values[fresh]
    return values, np.searchsorted(owners, np.arange(len(counts) + 1))
