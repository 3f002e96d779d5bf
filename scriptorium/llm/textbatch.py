"""Shared helpers for the Arrow stages: byte-balanced slices of a batch and
vectorised word segmentation and hashing over the raw UTF-8 buffer.

All helpers work on one slice of a batch at a time, so the memory of a task is
bounded by the slice size (or by the longest single document).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of text handled at once inside a task.
SLICE_BYTES = 1 << 20

#: Bytes of an Arrow batch (a little less than a slice, so that few batches are cut) and rows
#: that a Parquet reader unpacks at once, and the settings that bound them.
BATCH_BYTES = SLICE_BYTES - (64 << 10)
READER_ROWS = 512
_SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES, "spark.sql.parquet.columnarReaderBatchSize": READER_ROWS}

#: Bytes that separate words in the query contracts: \x20 and \x09-\x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Everything ASCII that is neither letter nor digit also separates words.
NON_WORD = np.ones(256, dtype=bool)
NON_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(0, np.uint64), np.ones(0, np.uint64))


def release() -> None:
    """Gives freed memory, and what this module keeps, back to the system."""
    import ctypes
    import gc

    global _powers
    _powers = (np.ones(0, np.uint64), np.ones(0, np.uint64))
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(task):
    """``task`` for mapInArrow, giving freed memory back when it ends: Spark keeps idle
    Python workers, and what they hold counts against the executor in later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            release()

    return run


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of the session's Arrow batches and the rows that its Parquet readers
    unpack at once, unless the session names bounds of its own.

    By rows alone a batch is all the text of a task; it is held by the JVM, in and outside of
    its heap, and by the Python worker, and a buffer that grows is held twice.
    """
    for setting, most in _SETTINGS.items():
        if spark.conf.get(setting, None) is None:
            spark.conf.set(setting, str(most))


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column that hold about ``max_bytes`` each."""
    if len(column) == 0:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    block = np.cumsum(size) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(column)]
    yield from zip(cuts[:-1], cuts[1:], strict=True)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and the offset of each (null: empty)."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, at - at[0]


def words(flat: np.ndarray, at: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of each text's first word (one more at the end)."""
    return runs(~breaks[flat], at)


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``words``, given which bytes stand inside one."""
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[at] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, at)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def word_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _LOWER) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased, by differences of a running polynomial."""
    global _powers
    if len(_powers[0]) < len(flat):
        n = max(len(flat), SLICE_BYTES // 4)
        with np.errstate(over="ignore"):
            _powers = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b)])) for b in (_BASE, _BASE_INV))
    with np.errstate(over="ignore"):
        run = np.zeros(len(flat) + 1, dtype=np.uint64)
        np.cumsum(values[flat] * _powers[0][: len(flat)], out=run[1:])
        return mix((run[ends] - run[starts]) * _powers[1][starts] + (ends - starts).astype(np.uint64))


def window_hashes(word: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words that starts at a word; the last width-1 values cross the end."""
    out = np.zeros(len(word), dtype=np.uint64)
    with np.errstate(over="ignore"):
        factor = np.uint64(1)
        for k in range(min(width, len(word))):
            factor = factor * _BASE + np.uint64(2 * k + 2)
            out[: len(word) - k] += word[k:] * (factor | np.uint64(1))
        return mix(out)
