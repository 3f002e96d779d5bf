"""Spelling variants: words one edit away from a much more frequent word.

Two words are near if one inserted, deleted or replaced code point turns one into the
other, that is: their common prefix and common suffix together reach the longer length
minus one. A word's form is its most frequent near word if that is ``ratio`` times as
frequent at least; its root is the end of the chain of forms.

Pairs are found in blocks. The edit of a pair lies in one pair of neighbouring positions
of the longer word, and all other letters agree: a block holds the words of a length and
of one letter less that agree in all letters outside of two such positions. So a block
holds no more words than there are choices for two letters, whatever the corpus, a pair
meets in the one block that holds its first difference, and no pair is lost. Blocks are
sorted into streams of rows; a task lays words out as padded matrices of code points,
once from the left and once from the right, and compares tiles of block pairs: the first
differing columns give prefix and suffix. Only the number of near words and the best of
them leave a task, for each word and block.

Counts are pre-aggregated where they arise; the word table is written to the shared
folder once, and so is each round of following forms. A form is ``ratio`` times as
frequent as its word, so chains are no longer than the logarithm of the greatest count.

Defined results: null and empty texts have no words; case is folded for A-Z only; words of
any length are compared whole; of near words with equal counts the least in code-point
order is the form; repeated rows count each; an empty table gives an empty table; other
columns of ``docs`` are not read. Rows without a key are counted like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.durable import checkpoint
from scriptorium.llm.textbatch import tidy

#: Cells of a tile of compared rows.
TILE = 1 << 21

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def letter_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = 7) -> DataFrame:
    """``id_col`` and ``word`` of each maximal run of at least ``min_length`` letters (A-Z, a-z, Latin-1), with A-Z lower-cased."""
    found = F.regexp_extract_all(F.translate(docs[text_col].cast("string"), _UPPER, _LOWER), F.lit(f"[a-zÀ-ÿ]{{{min_length},}}+"), F.lit(0))
    return docs.select(docs[id_col].alias(id_col), F.explode(found).alias("word"))


def word_counts(words: DataFrame, *, min_length: int = 7, min_count: int = 2) -> DataFrame:
    """``word`` and its number of rows ``n``, of words that are long and frequent enough."""
    return words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def blocks(words: DataFrame) -> DataFrame:
    """A row for each word and block: ``size`` (length of the longer words), ``part`` (which two positions), ``block`` (hash of the letters outside), ``word``, ``n``."""

    def entries(more: int):
        size = F.length("word") + more
        key = lambda j: F.xxhash64(size, j, F.substr("word", F.lit(1), 2 * j), F.substr("word", 2 * j + 3 - more))
        return F.transform(F.sequence(F.lit(0), F.ceil(size / 2).cast("int") - 1), lambda j: F.struct(size.alias("size"), j.alias("part"), key(j).alias("block")))

    return words.select("word", "n", F.explode(F.concat(entries(0), entries(1))).alias("b")).select("b.size", "b.part", "b.block", "word", "n")


def code_points(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of code points from the left, and from the right, padded by zeros."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.fromiter(map(len, words), np.int64, len(words))
    row = np.repeat(np.arange(len(words)), length)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    left, right = np.zeros((len(words), width), np.uint32), np.zeros((len(words), width), np.uint32)
    left[row, column] = flat
    right[row, np.repeat(length, length) - 1 - column] = flat
    return left, right


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of leading columns in which the rows agree."""
    same = a == b
    return np.where(same.all(axis=1), a.shape[1], same.argmin(axis=1))


def near_pairs(words: list[str], size: np.ndarray, part: np.ndarray, left_in_block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (a before b) of near words; rows of a block stand together, ``left_in_block``: rows of the block after each."""
    width = int(size.max())
    left, right = code_points(words, width)
    length = np.fromiter(map(len, words), np.int64, len(words))
    step = max(1, TILE // width)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    at, shift = np.flatnonzero(left_in_block > 0), 1
    while len(at):
        for k in range(0, len(at), step):
            a = at[k : k + step]
            b = a + shift
            prefix = common(left[a], left[b])
            longer = np.maximum(length[a], length[b])
            good = (longer == size[a]) & (prefix < longer) & (prefix // 2 == part[a])
            a, b, prefix, longer = a[good], b[good], prefix[good], longer[good]
            good = prefix + common(right[a], right[b]) >= longer - 1
            out.append((a[good], b[good]))
        shift += 1
        at = at[left_in_block[at] >= shift]
    return tuple(np.concatenate([pair[k] for pair in out] or [at]) for k in (0, 1))


def _best(words: list[str], n: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Number of near words and the best one, of each row that has any. Rows of a block are in the order of words."""
    one, other = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort((other, -n[other], one))
    one, other = one[order], other[order]
    lead = np.flatnonzero(np.diff(one, prepend=-1))
    count = np.diff(np.append(lead, len(one)))
    return pa.RecordBatch.from_arrays([pa.array([words[i] for i in one[lead]], pa.string()), pa.array(count.astype(np.int64)), pa.array(n[other[lead]]), pa.array([words[i] for i in other[lead]], pa.string())], ["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame) -> DataFrame:
    """Rows ``word``, ``n_near``, ``best_n``, ``best`` of the blocks in which a word has near words; several a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def compare(rows: pa.Table) -> list[pa.RecordBatch]:
            size, part, block, n = (rows.column(c).to_numpy() for c in ("size", "part", "block", "n"))
            new = np.flatnonzero((np.diff(size) != 0) | (np.diff(part) != 0) | (np.diff(block) != 0)) + 1
            end = np.append(new, len(size))
            after = np.repeat(end, np.diff(np.concatenate([[0], end]))) - 1 - np.arange(len(size))
            alone = after == 0
            alone[1:] &= after[:-1] == 0
            pick = np.flatnonzero(~alone)  # words alone in their block need no matrix
            words = rows.column("word").take(pa.array(pick)).to_pylist()
            size, part, n, after = size[pick], part[pick].astype(np.int64), n[pick], after[pick]
            found: list[pa.RecordBatch] = []
            # Words of a size stand together, so a matrix is no wider than its words; it ends with a block.
            ends = np.flatnonzero(after == 0) + 1
            tile = np.cumsum(size)[ends - 1] // TILE
            cuts = [0, *ends[:-1][np.diff(tile) > 0].tolist(), len(pick)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i < j:
                    found.append(_best(words[i:j], n[i:j], *near_pairs(words[i:j], size[i:j], part[i:j], after[i:j])))
            return found

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks()
            if not len(rows):
                continue
            size, part, block = (rows.column(c).to_numpy() for c in ("size", "part", "block"))
            same = (size == size[-1]) & (part == part[-1]) & (block == block[-1])
            cut = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0
            rest = rows.slice(cut)
            if cut:
                yield from compare(rows.slice(0, cut).combine_chunks())
        if rest is not None and len(rest):
            yield from compare(rest.combine_chunks())

    placed = blocks(words).repartition("block").sortWithinPartitions("size", "block", "part", "word")
    return placed.mapInArrow(tidy(run), "word string, n_near long, best_n long, best string")


def roots(links: DataFrame) -> DataFrame:
    """``word`` and the end ``root`` of the chain that starts with its link (word, form)."""
    found = checkpoint(links.select("word", F.col("form").alias("root")))
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = checkpoint(found.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        found = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return found


def group_variants(words: DataFrame, *, ratio: int = 10) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root`` of each row (word, n); words must be distinct."""
    words = checkpoint(words.select("word", F.col("n").cast("long").alias("n")))
    none = [F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best")]
    every = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), *none).unionByName(near_words(words).withColumn("n", F.lit(None).cast("long")))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best")))
    rated = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    good = -F.col("b.less") >= ratio * F.col("n")
    rated = checkpoint(rated.select("word", "n", "n_near", F.when(good, F.col("b.best")).alias("form"), F.when(good, -F.col("b.less")).alias("form_n")))
    ends = roots(rated.filter("form is not null"))
    return rated.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
