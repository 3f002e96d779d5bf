"""Language identification by rank-order profiles.

A profile is the ``size`` most frequent character n-grams (1 to ``max_n``
characters inside a word padded with one blank on each side) of a language, in
order of frequency. A document's own profile is compared with each language's by
the out-of-place distance: the sum of differences in rank, with the greatest
possible difference for n-grams that the language profile lacks.

An n-gram is held exactly in one integer, 21 bits a code point, so no n-grams
collide. Profiles are learned from counts over all training rows: each task
sends its counts per language, Spark sums them and keeps the top ranks.

Defined results: text that is null or has no letter gives ``und`` with score 0;
equal counts are ordered by n-gram; equal distances by language name; without
training rows every prediction is ``und``; repeated rows are predicted each; a text of
any length is read whole, so a task holds one text's n-grams; an empty table gives an empty
table; other columns are not read, whatever their names (also ``id``, ``lang_pred``, ``score``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.textbatch import tidy

UNDETERMINED = "und"
_BLANK = 0x20
_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letter


def grams(text: str, max_n: int) -> np.ndarray:
    """Codes of the n-grams of a text, with repetition."""
    chars = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[chars]
    chars = np.where(letter, chars, _BLANK).astype(np.int64)
    out = [chars[letter]]
    code, inner = chars, letter
    for n in range(2, max_n + 1):
        # An n-gram may begin and end with a blank, but holds none inside.
        m = len(chars) - n + 1
        code = code[:m] << 21 | chars[n - 1 :]
        if n == 2:
            out.append(code[letter[:-1] | letter[1:]])
            continue
        inner = letter[1 : 1 + m] if n == 3 else inner[:m] & letter[n - 2 : n - 2 + m]
        out.append(code[inner])
    return np.concatenate(out)


def top(codes: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, most frequent first, equal counts by code."""
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    count = np.diff(np.append(first, len(codes)))
    if len(first) > size:
        least = np.partition(count, len(count) - size)[len(count) - size]
        kept = count >= least
        first, count = first[kept], count[kept]
    return codes[first[np.argsort(-count, kind="stable")[:size]]]


def learn_profiles(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", size: int = 300, max_n: int = 3) -> DataFrame:
    """``lang``, ``gram`` (long code) and ``rank`` (from 0) of each language with a non-null name."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from scriptorium.llm.textbatch import slices

        for batch in batches:
            for i, j in slices(batch.column(1), 2 << 20):
                langs, texts = (batch.column(k).slice(i, j - i).to_pylist() for k in (0, 1))
                by: dict[str, list[str]] = {}
                for lang, text in zip(langs, texts, strict=True):
                    by.setdefault(lang, []).append(text)
                for lang, own in by.items():
                    code, n = np.unique(grams(" ".join(own), max_n), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    rows = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text")).filter("lang is not null and text is not null")
    counts = rows.mapInArrow(tidy(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < size).select("lang", "gram", "rank")


class Profiles:
    """Language profiles as one matrix of ranks."""

    def __init__(self, rows: list, size: int, max_n: int):
        self.size, self.max_n = size, max_n
        self.langs = sorted({r["lang"] for r in rows})
        self.grams = np.unique(np.array([r["gram"] for r in rows], np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int32)
        place = {x: i for i, x in enumerate(self.langs)}
        for r in rows:
            self.ranks[np.searchsorted(self.grams, r["gram"]), place[r["lang"]]] = r["rank"]

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = grams(text or "", self.max_n)
        if not len(codes) or not self.langs:
            return UNDETERMINED, 0.0
        own = top(codes, self.size)
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        ranks = self.ranks[at]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own), dtype=np.int32)[:, None])).sum(axis=0)
        best = int(apart.argmin())
        rest = np.delete(apart, best)
        second = float(rest.min()) if len(rest) else float(self.size * len(own))
        return self.langs[best], float((second - apart[best]) / second) if second > 0 else 0.0


def predict(docs: DataFrame, profiles: Profiles, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score`` (0 to 1: how much nearer the best profile is than the second)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                found = [profiles.predict(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["id", "lang_pred", "score"])

    out = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(tidy(run), f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def identify(train: DataFrame, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = 300, max_n: int = 3) -> DataFrame:
    """Learns profiles from ``train`` and predicts ``docs``.

    The driver holds ``size`` n-grams a language, whatever the input's size.
    """
    rows = learn_profiles(train, text_col=text_col, lang_col=lang_col, size=size, max_n=max_n).collect()
    return predict(docs, Profiles(rows, size, max_n), id_col=id_col, text_col=text_col)
