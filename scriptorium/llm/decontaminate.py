"""Benchmark decontamination by template canonicalisation.

Words of documents and of benchmark items are brought to a canonical form:
numbers, names (capitalised words that do not open a sentence) and units after a
number become typed placeholders, other words are lower-cased (A-Z and the capital
letters of Latin-1). Windows of
``width`` canonical words with ``min_plain`` plain words at least are hashed and
joined. So a question whose numbers or names were exchanged meets its template.

Every item is also searched for in two other forms: with numbers and units as the
only placeholders (names folded to lower case, so that capitals do not matter), and
as it stands, folded, without placeholders or a need of plain words. A hit by one
form is a hit.

Items that have no template window of ``min_plain`` plain words take what they have
of ``LEAST_PLAIN`` or more, against stronger evidence: an item of up to ``width``
words must stand as a passage of its own (between sentence ends, lines or ends of the
text), a longer one needs three such windows. Items of one or two words must stand as
passages of their own in any form.

For each meeting the slots are compared: along one alignment of document and
item, every value of the item must stand for one value of the document. Windows
of an alignment that breaks this are no evidence. A document is contaminated by
an item if ``min_windows`` of the item's windows (four in five, if it has few) are
found in alignments that hold; six windows of eight words are a run of 13 words.
The first word of a passage may be taken for a name where the text goes on before
it, hence four in five.

The windows of the benchmark are broadcast only while its text is within
``BROADCAST_BYTES``, and then pre-select the documents' windows inside the tasks;
beyond that all windows take part in a shuffled join.

Defined results: null and empty texts match nothing; items with fewer words than
``width`` are windows of their own length; of several texts of one item id any is evidence
(the least of (form, ``n_windows``, ``n_found``) is reported); documents with fewer words than that
match nothing; repeated windows of an item count once; repeated rows with one key
count once; rows without a key are left out; empty tables give an empty table;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import textbatch
from scriptorium.llm.textbatch import tidy

BROADCAST_BYTES = 16 << 20
LEAST_PLAIN = 3
#: Bytes of text whose windows are held at once inside a task; each word has windows of three forms.
SLICE_BYTES = textbatch.SLICE_BYTES // 4
#: Units that count as such after a number.
UNITS = "mm cm m km in ft yd mi mg g kg lb oz ml l gal s sec min h hr hours minutes seconds days weeks months years percent degrees dollars euros cents usd eur mph kmh kw kwh mb gb tb".split()

PLAIN, NUMBER, NAME, UNIT = 0, 1, 2, 3
_MARK = textbatch.mix(np.array([0, 11, 12, 13], np.uint64))
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:\n\"|")] = True
_IDENTITY = np.arange(256, dtype=np.uint64) + np.uint64(1)


def _unit_hashes() -> np.ndarray:
    flat = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    starts, ends, _ = textbatch.words(flat, np.array([0, len(flat)]))
    return np.sort(textbatch.word_hashes(flat, starts, ends))


def parse(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded hash and kind of each word, whether it opens a passage, and each text's first word."""
    if (flat == 0xC3).any():
        # Capital letters of Latin-1 are two bytes, the second less by 32 than the small letter's.
        flat = flat.copy()
        large = np.flatnonzero((flat[:-1] == 0xC3) & (flat[1:] >= 0x80) & (flat[1:] <= 0x9E) & (flat[1:] != 0x97)) + 1
        flat[large] += 32
    inside = ~textbatch.NON_WORD[flat]
    digit = _DIGIT[flat]
    if len(flat) > 2:
        # A point or comma between digits belongs to the number.
        inside[1:-1] |= ((flat[1:-1] == 46) | (flat[1:-1] == 44)) & digit[:-2] & digit[2:]
    starts, ends, first = textbatch.runs(inside, at)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool), first
    low = textbatch.word_hashes(flat, starts, ends)
    kind = np.where(digit[starts], NUMBER, PLAIN)
    stops = np.concatenate([[0], np.cumsum(_STOP[flat])])
    opens = np.ones(len(starts), bool)
    opens[1:] = stops[starts[1:]] > stops[ends[:-1]]
    heads = first[:-1]
    opens[heads[heads < len(starts)]] = True
    # Words in capitals throughout are no names.
    second = np.minimum(starts + 1, len(flat) - 1)
    kind[_UPPER[flat[starts]] & ~_UPPER[flat[second]] & (ends - starts > 1) & ~opens] = NAME
    after = np.zeros(len(starts), bool)
    after[1:] = kind[:-1] == NUMBER
    after &= kind == PLAIN
    if after.any():
        units = _unit_hashes()
        some = np.flatnonzero(after)
        kind[some[np.isin(low[some], units)]] = UNIT
    return low, kind, opens, first


def forms(low: np.ndarray, kind: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Canonical hash and slot value of each word (0 for plain words): with all placeholders, without names, with none."""
    kinds = [kind, np.where(kind == NAME, PLAIN, kind), np.zeros_like(kind)]
    return [(np.where(k == PLAIN, low, _MARK[k]), np.where(k == PLAIN, np.uint64(0), low)) for k in kinds]


def windows(hashed: np.ndarray, slots: np.ndarray, first: np.ndarray, width: int, min_plain: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word and text number of the windows that lie in one text and have enough plain words."""
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    plain = np.concatenate([[0], np.cumsum(slots == 0)])
    at = np.arange(len(hashed))
    good = at + width <= first[1:][owner] if len(at) else np.zeros(0, bool)
    at = at[good]
    at = at[plain[at + width] - plain[at] >= min_plain]
    return textbatch.window_hashes(hashed, width)[at], at, owner[at]


_ROW = "id long, width int, hash long, at int, whole boolean, slots array<long>"
_ITEM_ROW = "item long, form int, width int, hash long, item_at int, alone boolean, item_slots array<long>"


def _slot_lists(slots: np.ndarray, at: np.ndarray, width: int) -> pa.ListArray:
    values = slots[at[:, None] + np.arange(width)].view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, width), pa.int32()), pa.array(values.ravel()))


def _sums(marked: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(marked)])


def _cut_items(width: int, min_plain: int):
    """(id, text) of items to the windows of each form; ``alone``: only a passage of its own is evidence."""
    least = min(LEAST_PLAIN, min_plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in textbatch.slices(batch.column(1), SLICE_BYTES):
                ids = batch.column(0).slice(i, j - i).to_numpy(zero_copy_only=False)
                low, kind, _, first = parse(*textbatch.utf8(batch.column(1).slice(i, j - i)))
                n = np.diff(first)
                own = np.minimum(n, width)
                named = np.diff(_sums(kind == NAME)[first]) > 0
                slotted = np.diff(_sums(kind != PLAIN)[first]) > 0
                for w in np.unique(own[own > 0]).tolist():
                    for form, (hashed, slots) in enumerate(forms(low, kind)):
                        code, at, owner = windows(hashed, slots, first, w, 0)
                        # Forms that repeat the one before are left out.
                        some = (own == w) & (named if form == 1 else slotted | (w < LEAST_PLAIN) if form == 2 else w >= LEAST_PLAIN)
                        some = some[owner]
                        code, at, owner = code[some], at[some], owner[some]
                        alone = np.full(len(at), w < LEAST_PLAIN)
                        if form < 2:
                            plain = _sums(slots == 0)
                            plain = plain[at + w] - plain[at]
                            rich = plain >= min(min_plain, w)
                            strong = np.bincount(owner[rich], minlength=len(n)) > 0
                            fair = (n <= width) | (np.bincount(owner[plain >= least], minlength=len(n)) >= 3)
                            some = np.where(strong[owner], rich, (plain >= least) & fair[owner])
                            alone |= ~strong[owner] & (n[owner] <= width)
                            code, at, owner, alone = code[some], at[some], owner[some], alone[some]
                        if len(code):
                            same = [pa.array(np.full(len(code), x), pa.int32()) for x in (form, w)]
                            yield pa.RecordBatch.from_arrays([pa.array(ids[owner], pa.int64()), *same, pa.array(code.view(np.int64)), pa.array(at - first[:-1][owner], pa.int32()), pa.array(alone), _slot_lists(slots, at, w)], ["item", "form", "width", "hash", "item_at", "alone", "item_slots"])

    return run


def _cut(widths: list[int], min_plain: int, known: dict[int, np.ndarray] | None):
    """(id, text) to windows of all forms, those that two forms share once; known: the only hashes of interest, by width.
    ``whole``: whether a window is a passage of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = {}
        for width, hashes in (known or {}).items():
            bits[width] = np.zeros(1 << 20, bool)
            bits[width][(hashes >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            for i, j in textbatch.slices(batch.column(1), SLICE_BYTES):
                ids = batch.column(0).slice(i, j - i).to_numpy(zero_copy_only=False)
                low, kind, opens, first = parse(*textbatch.utf8(batch.column(1).slice(i, j - i)))
                edge = np.concatenate([opens, [True]])
                names, numbers = _sums(kind == NAME), _sums((kind == NUMBER) | (kind == UNIT))
                for form, (hashed, slots) in enumerate(forms(low, kind)):
                    for width in widths:
                        code, at, owner = windows(hashed, slots, first, width, 0 if form == 2 else min(LEAST_PLAIN, min_plain, width))
                        if form:
                            inside = names if form == 1 else numbers
                            some = inside[at + width] > inside[at]
                            code, at, owner = code[some], at[some], owner[some]
                        if known is not None:
                            some = bits[width][(code >> np.uint64(44)).astype(np.int64)]
                            code, at, owner = code[some], at[some], owner[some]
                            some = np.isin(code, known[width])
                            code, at, owner = code[some], at[some], owner[some]
                        if not len(code):
                            continue
                        whole = edge[at] & edge[at + width]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[owner], pa.int64()), pa.array(np.full(len(code), width), pa.int32()), pa.array(code.view(np.int64)), pa.array(at - first[:-1][owner], pa.int32()), pa.array(whole), _slot_lists(slots, at, width)], ["id", "width", "hash", "at", "whole", "slots"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 8, min_plain: int = 5, min_windows: int = 6) -> DataFrame:
    """Pairs of document and item that are contaminated: ``id_col``, ``item_col``,
    ``n_windows`` (of the item, in the first form that hits), ``n_found``, and ``exchanged`` (whether a slot's value differs). Keys are integers."""
    items = benchmark.select(benchmark[item_col].cast("long").alias("id"), F.coalesce(benchmark[item_text_col].cast("string"), F.lit("")).alias("text")).filter("id is not null").distinct()
    own = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).filter("id is not null and text is not null")

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = parse(*textbatch.utf8(batch.column(1)))[3]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.minimum(np.diff(first), width), pa.int32()), batch.column(1)], ["id", "own_width", "text"])

    # Each text of an item is searched for by itself.
    sized = items.mapInArrow(tidy(lengths), "id long, own_width int, text string").filter("own_width > 0").withColumn("key", F.xxhash64("id", "text"))
    named = sized.select("id", F.col("key").alias("item")).withColumnRenamed("id", "of")
    seen = sized.groupBy("own_width").agg(F.sum(F.octet_length("text")).alias("size")).collect()
    widths = sorted({r["own_width"] for r in seen})
    small = sum(r["size"] for r in seen) <= BROADCAST_BYTES
    items = sized.select("key", "text").mapInArrow(tidy(_cut_items(width, min_plain)), _ITEM_ROW)
    known = None
    if small:
        known = {w: np.zeros(0, np.uint64) for w in widths}
        hashes: dict[int, list[int]] = {w: [] for w in widths}
        for r in items.select("width", "hash").distinct().collect():
            hashes[r["width"]].append(r["hash"])
        known = {w: np.sort(np.array(h, np.int64).view(np.uint64)) for w, h in hashes.items()}
    counts = items.groupBy("item", "form").agg(F.count_distinct("hash").alias("n_windows"))
    found = own.mapInArrow(tidy(_cut(widths, min_plain, known)), _ROW)
    met = found.join(F.broadcast(items) if small else items, ["hash", "width"]).filter("whole or not alone")
    line = (F.col("at") - F.col("item_at")).alias("line")
    pairs = F.filter(F.arrays_zip("item_slots", "slots"), lambda p: p["item_slots"] != 0)
    met = met.select("id", "item", "form", line, "hash", F.array_distinct(pairs).alias("pairs"))
    # An alignment holds if each value of the item stands for one value of the document.
    values = met.filter(F.size("pairs") > 0).select("id", "item", "form", "line", F.explode("pairs").alias("p")).groupBy("id", "item", "form", "line", "p.item_slots").agg(F.min("p.slots").alias("lo"), F.max("p.slots").alias("hi"))
    slots = values.groupBy("id", "item", "form", "line").agg(F.max(F.col("lo") != F.col("hi")).alias("broken"), F.max((F.col("lo") != F.col("item_slots")) | (F.col("hi") != F.col("item_slots"))).alias("exchanged"))
    lines = met.select("id", "item", "form", "line", "hash").distinct().join(slots, ["id", "item", "form", "line"], "left").filter(~F.coalesce("broken", F.lit(False)))
    sums = lines.groupBy("id", "item", "form").agg(F.count_distinct("hash").alias("n_found"), F.max(F.coalesce("exchanged", F.lit(False))).alias("exchanged"))
    hits = sums.join(F.broadcast(counts) if small else counts, ["item", "form"]).filter(F.col("n_found") >= F.least(F.ceil(F.col("n_windows") * 0.8), F.lit(min_windows)))
    hits = hits.join(F.broadcast(named) if small else named, "item")
    hits = hits.groupBy("id", "of").agg(F.min(F.struct("form", "n_windows", "n_found")).alias("best"), F.max("exchanged").alias("exchanged"))
    return hits.select(F.col("id").alias(id_col), F.col("of").alias(item_col), "best.n_windows", "best.n_found", "exchanged")
