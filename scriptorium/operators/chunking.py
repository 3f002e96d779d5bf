"""Documents to overlapping chunks with positions, one Arrow pass per document."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk, of the overlap and of the least chunk; where a sentence ends.
SIZE, OVERLAP, LEAST = 800, 160, 100
_SENTENCE_END = r"(?<=[.!?])\s+(?=[A-ZÄÖÜ])"
_PARAGRAPH_GAP = re.compile(r"\n\s*\n+")
_SENTENCE_GAP = re.compile(_SENTENCE_END)


def sentences(text: Column) -> Column:
    """Sentences as an array: cut after .!? and white space before a capital letter."""
    return F.filter(F.transform(F.split(text, _SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")


def _pieces(text: str, gap: re.Pattern) -> Iterator[tuple[str, int]]:
    """Trimmed, non-empty pieces between gaps, with their starts."""
    at = 0
    for cut in [*gap.finditer(text), None]:
        raw = text[at : cut.start() if cut else len(text)]
        if piece := raw.strip():
            yield piece, at + len(raw) - len(raw.lstrip())
        at = cut.end() if cut else at


def spans(docs: DataFrame, level: str, *, id_col: str = "id", text_col: str = "fulltext") -> DataFrame:
    """``document_id``, ``ordinal``, ``char_start``, ``char_end`` and ``text`` of the sentences or paragraphs (``level``) of each text, trimmed, as a relation."""
    gap, kind = {"sentence": _SENTENCE_GAP, "paragraph": _PARAGRAPH_GAP}[level], dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                rows = [(i, n, at, at + len(piece), piece) for i, text in enumerate(part.column(1).to_pylist()) if text for n, (piece, at) in enumerate(_pieces(text, gap))]
                owner, *columns = zip(*rows, strict=True) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["document_id", "ordinal", "char_start", "char_end", "text"])

    return docs.select(id_col, text_col).mapInArrow(run, f"document_id {kind}, ordinal long, char_start long, char_end long, text string")


@dataclass
class _Packer:
    """The chunk being filled. A chunk shorter than ``least`` is carried on, never written."""

    size: int
    overlap: int
    least: int
    text: str = ""
    start: int = 0
    done: list[tuple[str, int]] = field(default_factory=list)

    def fits(self, piece: str, joint: str) -> bool:
        return len(self.text) + len(piece) + len(joint) <= self.size

    def add(self, piece: str, at: int, joint: str) -> None:
        if self.text:
            self.text += joint + piece
        else:
            self.text, self.start = piece, at

    def flush(self) -> bool:
        if self.text and len(self.text) >= self.least:
            self.done.append((self.text, self.start))
            return True
        return False

    def tail(self) -> str:
        return self.text[-self.overlap :] if self.overlap > 0 else ""


def chunk_text(fulltext: str | None, title: str | None = "", size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, str, int, int, int]]:
    """(index, text, start, end, tokens) of the chunks. Positions refer to the stripped
    text behind its title; the end is start plus length, also where pieces were joined."""
    if not fulltext or not fulltext.strip():
        return []
    text = f"{title}\n\n{fulltext.strip()}" if title else fulltext.strip()
    own = _Packer(size, overlap, least)
    for paragraph, at in _pieces(text, _PARAGRAPH_GAP):
        if own.fits(paragraph, "\n\n"):
            own.add(paragraph, at, "\n\n")
            continue
        if own.flush():
            own.text = own.tail()
            own.start = at - len(own.text)
        if len(paragraph) <= size:
            # Added without another look at the size, so overlap may make it longer.
            own.add(paragraph, at, "\n\n")
            continue
        for sentence, inner in _pieces(paragraph, _SENTENCE_GAP):
            if own.fits(sentence, " "):
                own.add(sentence, at + inner, " ")
                continue
            own.flush()
            lead = own.tail()
            own.text = f"{lead} {sentence}".strip() if lead else sentence
            own.start = at + inner - len(lead)
    own.flush()
    return [(k, chunk, start, start + len(chunk), len(chunk) // 4) for k, (chunk, start) in enumerate(own.done)]


CHUNK_ROW = "chunk_index int, chunk_text string, char_start int, char_end int, token_count long"


def chunk_documents(docs: DataFrame, *, id_col: str = "id", text_col: str = "fulltext", title_col: str | None = "title", size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """``document_id`` and the chunk columns; works on batches and on streams."""
    kind = dict(docs.dtypes)[id_col]
    title = F.coalesce(docs[title_col], F.lit("")) if title_col else F.lit("")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                found = [chunk_text(t, h, size, overlap, least) for t, h in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                owner = part.column(0).take(pa.array([i for i, own in enumerate(found) for _ in own], pa.int64()))
                columns = list(zip(*(c for own in found for c in own), strict=True)) or [()] * 5
                kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([owner, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["document_id", *(x.split()[0] for x in CHUNK_ROW.split(", "))])

    return docs.select(docs[id_col], docs[text_col], title).mapInArrow(run, f"document_id {kind}, {CHUNK_ROW}")
