"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded by
the distribution of pairs of neighbouring byte classes and by how far its words
repeat; a tanh layer turns that into a representation, a gated attention
(tanh times sigmoid) weighs the passages of a document against each other, and
the weighted representation is scored. Only documents carry labels; the
attention is learned through them.

The model is fitted on at most ``fit_rows`` labelled documents, chosen by a hash of the
key. Every passage of these is fitted on by itself, as it is scored: the encoded documents
are written to the shared folder, and each epoch streams them from there, so that the driver
holds a mini-batch of at most ``BATCH`` documents and about ``BATCH_PASSAGES`` passages (or one document).

Defined results: a null or empty text is one passage without words and gets a
score like any other, and so does a text of any length; repeated rows get equal scores;
labels that are null or belong to no document are left out, and so are null keys; of
several texts of one key the least is fitted on; with fewer than two labels seen all
scores are the share of label 1 (0.5 without labels); columns other than the named ones
are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import textbatch
from scriptorium.llm.durable import checkpoint
from scriptorium.llm.textbatch import tidy

PASSAGE = 64
BATCH, BATCH_PASSAGES = 128, 1 << 15
KEEP_BYTES = 128 << 20
_CLASSES = 16
N_FEATURES = _CLASSES * _CLASSES + 4


def _byte_classes() -> np.ndarray:
    out = np.full(256, 12, np.uint8)
    groups = (b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",;:", b"!", b"?", b"|", b"#*$%&<>")
    for k, group in enumerate(groups):
        out[list(group)] = k
    out[:32] = np.where(out[:32] == 12, 13, out[:32])
    out[128:192], out[192:] = 14, 15
    return out


BYTE_CLASS = _byte_classes()


def encode(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a slice of texts, and the index of each text's first passage."""
    starts, ends, first = textbatch.words(flat, at)
    n_words = np.diff(first)
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    begin = np.concatenate([[0], np.cumsum(n_passages)])
    doc = np.repeat(np.arange(len(n_words)), n_words)
    of_word = begin[doc] + (np.arange(len(starts)) - first[doc]) // PASSAGE
    total = int(begin[-1])
    counts = np.zeros((total, _CLASSES * _CLASSES), np.float32)
    if len(flat) > 1:
        # A passage's bytes run from its first word to the next passage's, a text's first from the text's start.
        heads = np.flatnonzero(np.diff(of_word, prepend=-1))
        heads = heads[of_word[heads] > begin[doc[heads]]]
        opens = np.zeros(len(flat) + 1, np.int64)
        opens[starts[heads] + 1] = 1
        opens = np.cumsum(opens)
        size = np.diff(at)
        of_byte = opens[1:] + np.repeat(begin[:-1] - opens[at[:-1]], size)
        kind = BYTE_CLASS[flat].astype(np.int64)
        pair = of_byte[:-1] * _CLASSES**2 + kind[:-1] * _CLASSES + kind[1:]
        inside = np.ones(len(flat), bool)
        inside[at[1:][size > 0] - 1] = False
        counts += np.bincount(pair[inside[:-1]], minlength=total * _CLASSES**2).reshape(total, -1)
    size = counts.sum(axis=1, keepdims=True)
    words = np.bincount(of_word, minlength=total).astype(np.float32)
    hashed = textbatch.word_hashes(flat, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    same = np.zeros(len(hashed))
    if len(hashed) > 1:
        same[1:] = (hashed[1:] == hashed[:-1]) & (of_word[1:] == of_word[:-1])
    with np.errstate(over="ignore"):
        _, some = np.unique(textbatch.mix(hashed + of_word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    distinct = np.bincount(of_word[some], minlength=total)
    least = np.maximum(words, 1)
    shape = np.stack([np.bincount(of_word, weights=same, minlength=total) / least, distinct / least, np.log1p(words) / 4, size[:, 0] / least / 16], axis=1)
    return np.concatenate([np.sqrt(counts / np.maximum(size, 1)), shape.astype(np.float32)], axis=1), begin


def mini_batches(bags: Iterable[tuple[np.ndarray, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Passages, the index of each bag's first one (one more at the end) and labels of neighbouring bags."""
    some: list[np.ndarray] = []
    labels: list[int] = []
    for bag, label in bags:
        if some and (len(some) == BATCH or sum(map(len, some)) + len(bag) > BATCH_PASSAGES):
            yield np.concatenate(some), np.cumsum([0, *map(len, some)]), np.array(labels, np.float32)
            some, labels = [], []
        some.append(bag)
        labels.append(label)
    if some:
        yield np.concatenate(some), np.cumsum([0, *map(len, some)]), np.array(labels, np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """tanh encoder, gated attention, logistic score."""

    def __init__(self, width: int = 24, gate: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"W": draw(N_FEATURES, width), "b": np.zeros(width, np.float32), "V": draw(width, gate), "U": draw(width, gate), "w": draw(gate), "c": draw(width), "d": np.zeros(1, np.float32)}
        self.mean, self.scale = np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32)
        self.constant: float | None = None

    def _forward(self, x: np.ndarray, begin: np.ndarray) -> tuple:
        p, n = self.p, np.diff(begin)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, begin[:-1]), n))
        a = e / np.repeat(np.add.reduceat(e, begin[:-1]), n)
        z = np.add.reduceat(h * a[:, None], begin[:-1], axis=0)
        return h, t, g, a, z, _sigmoid(z @ p["c"] + p["d"][0])

    def score(self, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(begin) - 1, self.constant)
        return self._forward((x - self.mean) * self.scale, begin)[-1].astype(np.float64)

    def fit(self, bags: Callable[[], Iterable[tuple[np.ndarray, int]]], epochs: int = 15, rate: float = 0.004) -> AttentionModel:
        """``bags`` gives the (passages, label) of the documents anew for each epoch, in any fixed order that mixes the labels."""
        n, total, squares = 0, np.zeros(N_FEATURES), np.zeros(N_FEATURES)
        ones, n_bags = 0.0, 0
        for x, begin, labels in mini_batches(bags()):
            n, total, squares = n + len(x), total + x.sum(axis=0, dtype=np.float64), squares + (x.astype(np.float64) ** 2).sum(axis=0)
            ones, n_bags = ones + float(labels.sum()), n_bags + len(labels)
        if n_bags == 0 or ones in (0, n_bags):
            self.constant = ones / n_bags if n_bags else 0.5
            return self
        mean = total / n
        self.mean, self.scale = mean.astype(np.float32), (1 / (np.sqrt(np.maximum(squares / n - mean**2, 0)) + 0.02)).astype(np.float32)
        slow, fast = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            for x, begin, labels in mini_batches(bags()):
                grad = self._gradient((x - self.mean) * self.scale, begin, labels)
                step += 1
                for name, value in grad.items():
                    slow[name] += 0.1 * (value - slow[name])
                    fast[name] += 0.001 * (value**2 - fast[name])
                    self.p[name] -= rate * (slow[name] / (1 - 0.9**step)) / (np.sqrt(fast[name] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradient(self, x: np.ndarray, begin: np.ndarray, y: np.ndarray) -> dict:
        p, n = self.p, np.diff(begin)
        h, t, g, a, z, score = self._forward(x, begin)
        out = ((score - y) / len(y)).astype(np.float32)
        dz = np.repeat(out[:, None] * p["c"], n, axis=0)
        da = (h * dz).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, begin[:-1]), n))
        dtg = de[:, None] * p["w"]
        dt, dg = dtg * g * (1 - t**2), dtg * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h**2)
        decay = 1e-4
        return {"W": x.T @ dh + decay * p["W"], "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ out + decay * p["c"], "d": out.sum(keepdims=True)}


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = 3000) -> AttentionModel:
    """Fits on ``fit_rows`` labelled documents at most. A document with several labels counts with the mean of them, rounded."""
    own = labels.select(labels[id_col].alias("id"), labels[label_col].alias("label")).filter("id is not null and label is not null")
    chosen = own.groupBy("id").agg(F.round(F.avg("label")).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id").agg(F.first("label").alias("label"), F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in textbatch.slices(batch.column(1)):
                x, begin = encode(*textbatch.utf8(batch.column(1).slice(i, j - i)))
                own = [x[b:e].astype(np.float16).tobytes() for b, e in zip(begin[:-1], begin[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(own, pa.binary())], ["label", "bag"])

    # In an order by hash, so that every stretch of them mixes the labels.
    ordered = rows.orderBy(F.xxhash64("id"), "id").select("label", "text")
    encoded = checkpoint(ordered.mapInArrow(tidy(run), "label int, bag binary"))
    return AttentionModel().fit(_Bags(encoded))


class _Bags:
    """The encoded documents in order, as often as asked; up to ``KEEP_BYTES`` are not read twice, with the same result."""

    def __init__(self, encoded: DataFrame):
        self.encoded = encoded
        self.kept: list[tuple[bytes, int]] | None = None

    def __call__(self) -> Iterator[tuple[np.ndarray, int]]:
        kept, size = [], 0
        for bag, label in self.kept if self.kept is not None else self.encoded.select("bag", "label").toLocalIterator():
            size += len(bag)
            if size <= KEEP_BYTES:
                kept.append((bag, label))
            else:
                kept = []
            yield np.frombuffer(bag, np.float16).astype(np.float32).reshape(-1, N_FEATURES), label
        self.kept = kept if size <= KEEP_BYTES else None


def score(docs: DataFrame, model: AttentionModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score`` (0 to 1) and ``n_passages`` of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in textbatch.slices(batch.column(1)):
                x, begin = encode(*textbatch.utf8(batch.column(1).slice(i, j - i)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(model.score(x, begin), pa.float64()), pa.array(np.diff(begin), pa.int64())], ["id", "score", "n_passages"])

    out = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(tidy(run), f"id {kind}, score double, n_passages long")
    return out.withColumnRenamed("id", id_col)
