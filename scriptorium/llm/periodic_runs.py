"""Periodic runs of words: stretches that repeat with a period of any length.

A run is a stretch of consecutive words with smallest period q (words q apart are equal)
that no neighbouring word extends, at least ``min_words`` and ``repeats * q`` words long.
``find_runs`` returns all runs of each text and the text without what runs repeat.

Periods up to ``SHORT`` are found by a direct scan of each lag. Longer ones go by scales:
scale k covers the periods in (2**(k-1), 2**k] and hashes grams of 2**k words. Inside a run
of such a period grams less than a period apart differ, so the minimum of every window of
2**(k-1) grams comes again exactly one period later, and nowhere between. Two neighbouring
equal minimizers at such a distance are therefore a seed; a seed is extended word by word in
both directions. As a run of four periods holds such a pair, none is missed; a period that
is a multiple of a smaller one covers the same words as that one's run and is dropped.

All texts of a slice go through the scans together, parted by marks that equal nothing.
A scale looks only at texts long enough for its periods, so work and memory grow with the
words of a slice (or of the longest text) times the logarithm of the longest text.

Defined results: null, empty and blank texts have no words, no runs and an empty collapsed
text; runs may overlap; a word goes if any run holds it after that run's first period;
of runs with equal length / period the best is the first, then that of least period;
repeated rows are handled each; an empty table gives an empty table; other columns are not
read. Words are compared by a 64-bit hash of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scriptorium.llm.textbatch import mix, slices, tidy, utf8, word_hashes, words

#: Periods up to this one are found by direct scans. The scales start above it.
SHORT = 8

_BYTES = np.arange(256, dtype=np.uint64) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def gram_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """A hash of each stretch of ``width`` ids, by differences of a running polynomial."""
    with np.errstate(over="ignore"):
        powers, inverse = (np.cumprod(np.full(len(ids), b, np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        run = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * powers, out=run[1:])
        return mix((run[width:] - run[:-width]) * inverse[: len(ids) - width + 1])


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values: of prefixes and suffixes of blocks of that size."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def minimizers(values: np.ndarray, width: int) -> np.ndarray:
    """Positions whose value is the least of some window of ``width``."""
    least = window_min(values, width)
    # The greatest minimum of the windows that hold a position, as the least complement.
    around = np.full(len(values) + width - 1, np.iinfo(values.dtype).max, values.dtype)
    around[width - 1 : width - 1 + len(least)] = ~least
    return np.flatnonzero(~window_min(around, width) == values)


def seeds(ids: np.ndarray, scale: int) -> list[tuple[int, int]]:
    """(lag, position) of equal neighbouring minimizers with a lag of this scale, in order."""
    gram, window = 1 << scale, 1 << scale - 1
    if len(ids) < gram + window:
        return []
    values = gram_hashes(ids, gram)
    at = minimizers(values, window)
    at = at[np.argsort(values[at], kind="stable")]
    lag = np.diff(at)
    good = np.flatnonzero((np.diff(values[at]) == 0) & (lag > window) & (lag <= gram))
    return sorted(zip(lag[good].tolist(), at[good].tolist(), strict=True))


def _reach(differs: np.ndarray) -> int:
    first = int(differs.argmax()) if len(differs) else 0
    return first if len(differs) and differs[first] else len(differs)


def extend(ids: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The stretch around ``at`` (start, end; empty if it differs itself) where ids equal those ``lag`` later."""
    start = end = at
    step = 64
    while end + lag < len(ids):
        here = slice(end, min(end + step, len(ids) - lag))
        more = _reach(ids[here] != ids[here.start + lag : here.stop + lag])
        end += more
        if more < here.stop - here.start:
            break
        step *= 2
    step = 64
    while start > 0 and end > at:
        here = slice(max(0, start - step), start)
        more = _reach((ids[here] != ids[here.start + lag : here.stop + lag])[::-1])
        start -= more
        if more < here.stop - here.start:
            break
        step *= 2
    return start, end


def runs_of(ids: np.ndarray, first: np.ndarray, *, min_words: int = 6, repeats: int = 4) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, in this order; ids: of all words, first: index of each text's first word, one more at the end."""
    size = np.diff(first)
    marked = np.zeros(len(ids) + len(size), np.int64)
    mark = first[1:] + np.arange(len(size))  # one unlike anything after each text
    inside = np.ones(len(marked), bool)
    inside[mark] = False
    marked[inside] = np.unique(ids, return_inverse=True)[1] if len(ids) else 0
    marked[mark] = len(ids) + np.arange(len(size))
    found: list[tuple[int, int, int]] = []
    for q in range(1, SHORT + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], marked[:-q] == marked[q:], [False]]).astype(np.int8)))
        starts, lengths = edges[::2], edges[1::2] - edges[::2] + q
        good = lengths >= max(min_words, repeats * q)
        found += zip(starts[good].tolist(), lengths[good].tolist(), [q] * int(good.sum()), strict=True)
    scale = SHORT.bit_length()
    while (long := size >= repeats * ((1 << scale - 1) + 1)).any():
        own = np.flatnonzero(np.repeat(long, size + 1))
        some = marked[own]
        last, done = 0, -1
        for lag, at in seeds(some, scale):
            if lag != last:
                last, done = lag, -1
            if at < done:
                continue  # inside the stretch just seen at this lag
            start, end = extend(some, at, lag)
            done = end
            if end > start and end - start + lag >= max(min_words, repeats * lag):
                found.append((int(own[start]), end - start + lag, lag))
        scale += 1
    if not found:
        return np.zeros((0, 4), np.int64)
    rows = np.array(found, np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # Of several periods of the same words the smallest is the run's.
    rows = rows[np.concatenate([[True], (np.diff(rows[:, :2], axis=0) != 0).any(axis=1)])]
    text = np.searchsorted(mark, rows[:, 0])
    start = rows[:, 0] - first[text] - text
    rows = np.column_stack([text, start, rows[:, 1], rows[:, 2]])
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def best_of(runs: np.ndarray) -> int:
    """Index of the run (text, start, length, period) with the greatest length / period; ties: least start, then period."""
    return max(range(len(runs)), key=lambda i: (Fraction(int(runs[i, 2]), int(runs[i, 3])), -runs[i, 1], -runs[i, 3]))


def find_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 6, repeats: int = 4) -> DataFrame:
    """``id_col``, ``n_words``, ``runs`` (start, length, period in words, by start, then period), ``best`` (null without runs) and ``collapsed`` of each row.

    repeats: how often at least a period stands in a run; four or more, else scales would miss runs.
    """
    if repeats < 4 or min_words < 1:
        raise ValueError("repeats must be 4 or more and min_words positive")
    kind = docs.schema[id_col].dataType.simpleString()

    def one(keys: pa.Array, column: pa.Array) -> pa.RecordBatch:
        flat, at = utf8(column)
        starts, ends, first = words(flat, at)
        runs = runs_of(word_hashes(flat, starts, ends, _BYTES), first, min_words=min_words, repeats=repeats)
        cuts = np.searchsorted(runs[:, 0], np.arange(len(keys) + 1))
        data = flat.tobytes()
        collapsed, best = [], []
        for i in range(len(keys)):
            own = data[at[i] : at[i + 1]].split()  # at ASCII white space
            mine = runs[cuts[i] : cuts[i + 1]]
            best.append(dict(zip(("start", "length", "period"), map(int, mine[best_of(mine), 1:]), strict=True)) if len(mine) else None)
            if len(mine):
                depth = np.zeros(len(own) + 1, np.int64)
                np.add.at(depth, mine[:, 1] + mine[:, 3], 1)
                np.add.at(depth, mine[:, 1] + mine[:, 2], -1)
                own = [w for w, d in zip(own, np.cumsum(depth)[:-1].tolist(), strict=True) if not d]
            collapsed.append(b" ".join(own))
        spans = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], fields=list(_RUN))
        return pa.RecordBatch.from_arrays(
            [keys, pa.array(np.diff(first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), spans), pa.array(best, _RUN), pa.array(collapsed, pa.binary()).view(pa.string())],
            ["id", "n_words", "runs", "best", "collapsed"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(1)):
                yield one(batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i))

    schema = f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, best struct<start:long,length:long,period:long>, collapsed string"
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)
