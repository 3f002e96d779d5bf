"""Byte-level BPE encoding and decoding.

A text is cut by the vocabulary's pattern and every match is merged on its own.
Matches not met before in the task are encoded together: they are put into
padded integer matrices by length, and in each round every row merges its
leftmost pair of least rank. Ranks of pairs come from an open-addressing hash
table held in two numpy arrays; rows with nothing left to merge leave the
matrix. Matches longer than ``LONG`` bytes, for which padded rows would cost the
square of the length, are merged with a heap in the same order.

Defined results: null or empty text has no ids and decodes to empty bytes;
repeated rows are encoded each; of equal ranks the leftmost pair is merged; a text of any
length is encoded whole; an empty table gives an empty table; columns other than the key
and the text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scriptorium.llm.textbatch import tidy

LONG = 512
#: Distinct matches remembered per task before the memory is started anew.
REMEMBERED = 150_000
_NONE = np.int32(2**31 - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_WIDTHS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 128, 256, LONG)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PairTable:
    """(left id, right id) -> id of the two together, for arrays of pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        # Plain arrays: a dictionary of all pairs would be the largest object of a task.
        pairs, joined = array("Q"), array("i")
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append(left << 32 | right)
                    joined.append(rank)
        self.bits = max(4, (2 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, 2**64 - 1, np.uint64), np.full(size, _NONE, np.int32)
        keys, values = np.frombuffer(pairs, np.uint64), np.frombuffer(joined, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == np.uint64(2**64 - 1)
            slots, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slots], self.values[slots] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the pairs; _NONE where a side is padding (-1) or the pair has no id."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        out = np.full(len(left), _NONE, np.int32)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[open_].astype(np.uint64) << np.uint64(32) | right[open_].astype(np.uint64)
        slot = self._slot(keys)
        while len(open_):
            there = self.keys[slot]
            hit = there == keys
            out[open_[hit]] = self.values[slot[hit]]
            go = ~hit & (there != np.uint64(2**64 - 1))
            open_, keys, slot = open_[go], keys[go], (slot[go] + 1) & (len(self.keys) - 1)
        return out.reshape(shape)


class BytePairs:
    """Encodes matches and decodes ids for one rank file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.table = PairTable(ranks)
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...]] = [()] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = (whole,)
            elif len(piece) > LONG:
                out[i] = self._heap(piece)
            elif piece:
                buckets.setdefault(next(w for w in _WIDTHS if w >= len(piece)), []).append(i)
        for width, rows in buckets.items():
            step = max(1, (1 << 20) // width)
            for k in range(0, len(rows), step):
                self._matrix([pieces[i] for i in rows[k : k + step]], width, rows[k : k + step], out)
        return out

    def _matrix(self, pieces: list[bytes], width: int, place: list[int], out: list) -> None:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        length = np.fromiter(map(len, pieces), np.int32, len(pieces))
        ids = np.where(np.arange(width) < length[:, None], self.byte_id[raw], np.int32(-1))
        row = np.array(place)
        rank = self.table(ids[:, :-1], ids[:, 1:])
        while len(ids):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(ids)), at]
            ended = best == _NONE
            if ended.any():
                for i, r, n in zip(row[ended].tolist(), ids[ended].tolist(), (ids[ended] >= 0).sum(axis=1).tolist(), strict=True):
                    out[i] = tuple(r[:n])
                ids, rank, row, at, best = ids[~ended], rank[~ended], row[~ended], at[~ended], best[~ended]
                if not len(ids):
                    break
            every = np.arange(len(ids))
            cols = np.arange(ids.shape[1] - 1)
            # What stands right of the merged pair moves one to the left.
            ids[:, :-1] = np.where(cols > at[:, None], ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ids[every, at] = best
            if rank.shape[1] > 1:
                rank[:, :-1] = np.where(cols[:-1] > at[:, None], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = _NONE
            after = np.minimum(at + 1, ids.shape[1] - 1)
            rank[every, np.minimum(at, rank.shape[1] - 1)] = self.table(ids[every, at], np.where(at + 1 < ids.shape[1], ids[every, after], np.int32(-1)))
            has = at > 0
            rank[every[has], at[has] - 1] = self.table(ids[every[has], at[has] - 1], ids[every[has], at[has]])
            if ids.shape[1] > 3 and not (ids[:, -2] >= 0).any():
                ids, rank = ids[:, :-1].copy(), rank[:, :-1].copy()

    def _heap(self, piece: bytes) -> tuple[int, ...]:
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.table(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(heap)
        text = self.bytes_of
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := self.ranks.get(text[ids[x]] + text[ids[y]])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return tuple(x for x in ids if x >= 0)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array of int): the ids of each whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        from scriptorium.llm.textbatch import slices

        find = regex.compile(pattern).findall
        model = BytePairs(read_ranks(ranks_path))
        seen: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            for i, j in slices(batch.column(1), 1 << 20):
                if len(seen) > REMEMBERED:
                    seen.clear()
                split = [find(text or "") for text in batch.column(1).slice(i, j - i).to_pylist()]
                new = list({p for ps in split for p in ps}.difference(seen))
                seen.update(zip(new, model.encode_pieces([p.encode() for p in new]), strict=True))
                known = seen.__getitem__
                ids = [np.fromiter(chain.from_iterable(map(known, ps)), np.int32) for ps in split]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], ["id", "ids"])

    out = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(tidy(run), f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, ``ids`` and ``decoded`` (binary): the bytes that the ids stand for (null ids: none)."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = BytePairs.__new__(BytePairs)
        model.bytes_of = {i: t for t, i in read_ranks(ranks_path).items()}
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                decoded = [model.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else b"" for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(decoded, pa.binary())], ["id", "ids", "decoded"])

    out = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids")).mapInArrow(tidy(run), f"id {kind}, ids array<int>, decoded binary")
    return out.withColumnRenamed("id", id_col)
