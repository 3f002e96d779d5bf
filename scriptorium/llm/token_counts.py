"""Token counts: lengths of encodings, without the encodings.

``count_tokens`` streams Arrow batches through the vocabulary's own library and
returns lengths only. Texts are cut at ASCII white space, where no token of the
vocabulary can cross a boundary (the vocabulary's rules drop white space and no
special string holds any), so a text of any length is counted in pieces. The
pieces are gathered into batches of about ``batch_bytes`` bytes, each distinct
piece is encoded once per task, and a text's length is the sum of its pieces'.

Defined results: null or empty text has 0 tokens and 0 bytes; an empty table
gives an empty table; repeated rows are counted each (so there are no ties); other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from scriptorium.llm.textbatch import tidy

#: Distinct pieces remembered per task before the memory is started anew.
REMEMBERED = 400_000


class WordCounter:
    """Counts tokens of words, remembering those seen before."""

    def __init__(self, vocabulary: str, batch_bytes: int):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.batch_bytes = batch_bytes
        self.seen: dict[bytes, int] = {}

    def learn(self, new: list[bytes]) -> None:
        batch: list[str] = []
        size = 0
        done = 0
        for i, word in enumerate(new):
            batch.append(word.decode("utf-8", "replace"))
            size += len(word)
            if size >= self.batch_bytes or i + 1 == len(new):
                found = self.library.encode_batch_fast(batch, add_special_tokens=False)
                self.seen.update(zip(new[done : i + 1], map(len, found), strict=True))
                batch, size, done = [], 0, i + 1

    def count(self, texts: list[bytes]) -> list[int]:
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        split = [text.split() for text in texts]
        self.learn(list({w for ws in split for w in ws}.difference(self.seen)))
        known = self.seen.__getitem__
        return [sum(map(known, ws)) for ws in split]


def count_tokens(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20) -> DataFrame:
    """``id_col``, ``n_bytes`` and ``n_tokens`` of each row.

    vocabulary: a tokenizers JSON file whose rules treat ASCII white space as a
    separator that belongs to no token.
    """
    import os

    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from scriptorium.llm.textbatch import slices

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = WordCounter(vocabulary, batch_bytes)
        for batch in batches:
            column = batch.column(1)
            for i, j in slices(column, 4 * batch_bytes):
                texts = [x or b"" for x in column.slice(i, j - i).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(map(len, texts), pa.int64()), pa.array(counter.count(texts), pa.int64())], ["id", "n_bytes", "n_tokens"])

    out = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(tidy(run), f"id {kind}, n_bytes long, n_tokens long")
    return out.withColumnRenamed("id", id_col)
