"""Token ids as binary files: one array of ids after another, with Elias-Fano coded document boundaries.

``write`` encodes texts and writes shards in ascending order of the key; ``read`` gives one row
a document from the files. Both are a Spark data source (``TokenFiles``), so a task writes or
reads part of a shard as a stream, and files of lost attempts are never seen: the manifest,
written last, names the files that count.

A shard holds

    ids       all ids of its documents, one after another, 2 or 4 bytes each (little-endian)
    bounds    Elias-Fano: where each document ends, in ids
    keys      Elias-Fano: keys less the first one, ascending
    footer    JSON (sections, counts), its length (4 bytes), ``MAGIC``

Elias-Fano splits each of n ascending values below U into log2(U / n) low bits, packed, and
the rest as a unary bit vector of about 2n bits. A select structure keeps the place of every
``SAMPLE``-th one bit (4 bytes each), so ``select(i)`` looks at a few bytes: the offset of any
document is found without a table of offsets, at about log2(U / n) + 2.1 bits a document.

Shards hold about ``shard_bytes`` of text; keys of equal value may span shards, so that a hot
key is no hot task. A writing task keeps 16 bytes a document of its shard, a reading task one
piece of about ``piece_ids`` ids (or one document).

Defined results: null and empty texts have the end id alone; documents of equal keys follow each
other by hash of text, then by partition of the input; null keys come first; no documents give no shards;
other columns are not read. Keys must be integers, and a document's ids fit in 2 GB. Folders are
local or shared mounts, or what pyarrow's file systems reach (hdfs, s3, gs).
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from scriptorium.llm.textbatch import slices, tidy, utf8

MAGIC = b"TOKIDS01"
MANIFEST = "manifest.json"
#: One bits of the upper part between two entries of the select structure.
SAMPLE = 256


class EliasFano:
    """Ascending integers (from 0 on) in near-minimal space; ``parts`` are numpy arrays or a reader of byte ranges."""

    def __init__(self, n: int, low: int, lower: bytes, upper: bytes, samples: bytes):
        self.n, self.low, self.lower, self.upper = n, low, lower, upper
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """values: ascending uint64."""
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", b"")
        low = max(0, (int(values[-1]) // n).bit_length() - 1)
        lower = []
        if low:
            shifts = np.arange(low, dtype=np.uint64)
            for k in range(0, n, 1 << 16):  # a multiple of 8 values ends with a byte
                bits = (values[k : k + (1 << 16), None] >> shifts) & np.uint64(1)
                lower.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes())
        ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        upper = np.zeros(int(ones[-1]) + 1, np.uint8)
        upper[ones] = 1
        return cls(n, low, b"".join(lower), np.packbits(upper, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def between(self, first: int, end: int) -> np.ndarray:
        """Values first to end - 1, as uint64."""
        if first >= end:
            return np.zeros(0, np.uint64)
        lead = first // SAMPLE
        start = int(self.samples[lead])
        last = (end - 1) // SAMPLE + 1
        stop = int(self.samples[last]) if last < len(self.samples) else 8 * len(self.upper)
        bits = np.unpackbits(np.frombuffer(self.upper, np.uint8, stop // 8 + (stop % 8 > 0) - start // 8, start // 8), bitorder="little")
        ones = np.flatnonzero(bits[start % 8 :])[first - lead * SAMPLE : end - lead * SAMPLE] + start
        high = (ones - np.arange(first, end)).astype(np.uint64) << np.uint64(self.low)
        if not self.low:
            return high
        at = first * self.low
        stop = end * self.low
        bits = np.unpackbits(np.frombuffer(self.lower, np.uint8, -(-stop // 8) - at // 8, at // 8), bitorder="little")[at % 8 : at % 8 + stop - at]
        return high | (bits.reshape(-1, self.low).astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.between(i, i + 1)[0])

    def sections(self) -> list[bytes]:
        return [self.lower, self.upper, self.samples.tobytes()]


def _place(path: str):
    """(file system, path) of a folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))


class Shard:
    """A shard opened for reading."""

    def __init__(self, files, path: str):
        self.file = files.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{path} is no shard of token ids")
        length = int.from_bytes(tail[:4], "little")
        self.about = json.loads(self.file.read_at(length, size - 12 - length))
        self.bounds, self.keys = (self._sequence(x) for x in ("bounds", "keys"))

    def _sequence(self, name: str) -> EliasFano:
        own = self.about[name]
        at, parts = own["at"], []
        for size in own["bytes"]:
            parts.append(self.file.read_at(size, at))
            at += size
        return EliasFano(own["n"], own["low"], *parts)

    def documents(self, first: int, end: int) -> tuple[list, np.ndarray, np.ndarray]:
        """Keys, boundaries (one more than documents) and ids of documents first to end - 1."""
        nulls = self.about["null_keys"]
        keys = self.keys.between(max(first, nulls) - nulls, max(end, nulls) - nulls) + np.uint64(self.about["first_key"] % (1 << 64))
        before = [self.bounds.select(first - 1)] if first else [0]
        bounds = np.concatenate([np.array(before, np.int64), self.bounds.between(first, end).astype(np.int64)])
        width = self.about["width"]
        data = self.file.read_at(int(bounds[-1] - bounds[0]) * width, int(bounds[0]) * width)
        return [None] * (min(end, nulls) - min(first, nulls)) + keys.view(np.int64).tolist(), bounds, np.frombuffer(data, f"<u{width}")


@dataclass
class Written(WriterCommitMessage):
    part: int
    about: dict | None


@dataclass
class Piece(InputPartition):
    name: str
    start: int
    first: int
    end: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One task, one shard."""
        from pyspark import TaskContext

        files, root = _place(self.path)
        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}-{uuid.uuid4().hex}.tokens"
        keys: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        out = None
        for batch in iterator:
            if not len(batch):
                continue
            if out is None:
                files.create_dir(root, recursive=True)
                out = files.open_output_stream(f"{root}/{name}")
            ids = batch.column(1)
            size = np.asarray(ids.value_lengths() if hasattr(ids, "value_lengths") else pa.compute.binary_length(ids), np.int64)
            out.write(b"".join(ids.to_pylist()))
            keys.append(batch.column(0))
            sizes.append(size // self.width)
        if out is None:
            return Written(part, None)
        bounds = np.cumsum(np.concatenate(sizes))
        every = pa.chunked_array(keys).combine_chunks()
        nulls = every.null_count
        own = np.asarray(every.slice(nulls), np.int64)  # null keys come first
        first = int(own[0]) if len(own) else 0
        about = {"n_docs": len(bounds), "n_ids": int(bounds[-1]), "width": self.width, "null_keys": nulls, "first_key": first}
        at = int(bounds[-1]) * self.width
        # Differences wrap around as the keys do, so any range of keys fits.
        for title, found in (("bounds", EliasFano.of(bounds.astype(np.uint64))), ("keys", EliasFano.of(own.view(np.uint64) - np.uint64(first % (1 << 64))))):
            sections = found.sections()
            about[title] = {"at": at, "n": found.n, "low": found.low, "bytes": [len(x) for x in sections]}
            for x in sections:
                out.write(x)
                at += len(x)
        footer = json.dumps(about).encode()
        out.write(footer + len(footer).to_bytes(4, "little") + MAGIC)
        out.close()
        return Written(part, {"name": name, "n_docs": about["n_docs"], "n_ids": about["n_ids"]})

    def commit(self, messages: list[Written | None]) -> None:
        """The manifest: shards in order, with the number of ids before each. Files of other attempts go."""
        from pyarrow import fs

        files, root = _place(self.path)
        files.create_dir(root, recursive=True)
        shards, start = [], 0
        for message in sorted((m for m in messages if m and m.about), key=lambda m: m.part):
            shards.append(message.about | {"start": start})
            start += message.about["n_ids"]
        named = {s["name"] for s in shards}
        for found in files.get_file_info(fs.FileSelector(root)):
            if found.base_name.endswith(".tokens") and found.base_name not in named:
                files.delete_file(found.path)
        with files.open_output_stream(f"{root}/{MANIFEST}.new") as out:
            out.write(json.dumps({"shards": shards}).encode())
        files.move(f"{root}/{MANIFEST}.new", f"{root}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _place(self.path)
        for message in messages:
            if message and message.about:
                files.delete_file(f"{root}/{message.about['name']}")


class _Reader(DataSourceReader):
    def __init__(self, path: str, piece_ids: int):
        self.path, self.piece_ids = path, piece_ids

    def partitions(self) -> list[Piece]:
        """Pieces of about as many ids; a piece's ids are found by select in its shard."""
        files, root = _place(self.path)
        with files.open_input_file(f"{root}/{MANIFEST}") as own:
            shards = json.loads(own.read())["shards"]
        out = []
        for s in shards:
            n = min(s["n_docs"], -(-s["n_ids"] // self.piece_ids))
            cuts = [s["n_docs"] * k // n for k in range(n + 1)]
            out += [Piece(s["name"], s["start"], a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        if partition is None or not hasattr(partition, "name"):
            return
        files, root = _place(self.path)
        shard = Shard(files, f"{root}/{partition.name}")
        step = 4096
        for first in range(partition.first, partition.end, step):
            keys, bounds, ids = shard.documents(first, min(first + step, partition.end))
            wide = ids.astype("<u4")
            size = np.diff(bounds)
            offsets = pa.py_buffer(((bounds - bounds[0]) * 4).astype(np.int32))
            data = pa.Array.from_buffers(pa.binary(), len(size), [None, offsets, pa.py_buffer(wide.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(partition.start + bounds[:-1]), pa.array(size), data], ["doc_id", "start", "n_tokens", "ids"])


class TokenFiles(DataSource):
    """``spark.read.format("token_ids")``: doc_id, start (ids of all documents before), n_tokens, ids (little-endian, 4 bytes each)."""

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], int(self.options["width"]))

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("piece_ids", 1 << 22)))


#: Fixed value: the pattern by which the vocabulary for which ``WordIds`` has a shorter way parts words from marks.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(maxsize=2)
def _opened(vocabulary: str):
    """The library's tokenizer; if its rules allow, one of its model alone, and which ids end words. Opened once a worker."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    library = Tokenizer.from_file(vocabulary)
    rules = json.loads(library.to_str())
    parts = lambda x, name: x.get(name, [x]) if x else []
    folds = [x["type"] for x in parts(rules["normalizer"], "normalizers")] == ["NFC", "Replace", "Lowercase"]
    splits = parts(rules["pre_tokenizer"], "pretokenizers")
    suffix = rules["model"].get("end_of_word_suffix")
    if not (folds and suffix and [x["type"] for x in splits] == ["Split", "ByteLevel"] and splits[0]["pattern"] == {"Regex": WORD_PATTERN}):
        return library, None, None
    lean = Tokenizer.from_str(json.dumps({**rules, "normalizer": None, "post_processor": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, splits[1]]}}))
    ends = np.zeros(lean.get_vocab_size(), bool)
    ends[[i for token, i in lean.get_vocab().items() if token.endswith(suffix)]] = True
    return library, lean, ends


#: Bytes of ASCII letters and digits.
_ALNUM = np.array([bytes([x]).isalnum() for x in range(256)])


def _as_bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


class WordIds:
    """Ids of texts, by way of pieces between ASCII white space, which Arrow parts and tells apart a slice at a time.

    Where the vocabulary's own rules are NFC, lower case and ``WORD_PATTERN``, a piece is its folded stem and the ASCII marks
    after it, so that fewer strings are encoded, each distinct one once; and many stems of letters are encoded as one text by the
    vocabulary's model alone, without rules that do nothing to them, and told apart by the ids that end words. Of strings
    seen, those of the last ``remembered`` at least stay known.
    """

    MARKS = "!\"#$%&'()*+,-./:;=?@[\\]^_`{|}~"

    def __init__(self, vocabulary: str, width: int, remembered: int = 200_000):
        self.kind, self.remembered = {2: "H", 4: "I"}[width], remembered
        self.library, self.lean, self.ends = _opened(vocabulary)
        self.plain = self.lean is not None
        self.seen: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _parts(self, pieces: pa.Array) -> list[pa.Array]:
        """Pieces as they are encoded, and the marks taken off (or nothing); what may be a special string stays as it is."""
        if not self.plain:
            return [pieces]
        special = pc.match_substring(pieces, "<")
        folded = pc.if_else(special, pieces, pc.ascii_lower(pieces))
        trimmed = pc.ascii_rtrim(folded, characters=self.MARKS)
        flat, at = utf8(folded)
        size, left = np.diff(at), np.asarray(pc.binary_length(trimmed), np.int64)
        cut = (left < size) & (left > 0) & ~np.asarray(special)
        last = np.zeros(len(cut), np.uint8)
        last[cut] = flat[at[:-1][cut] + left[cut] - 1]
        far = np.flatnonzero(last > 127)
        cut &= _ALNUM[last]
        cut[far] = [unicodedata.normalize("NFC", x.decode("utf-8", "replace")).lower()[-1].isalpha() for x in _as_bytes(trimmed.take(pa.array(far)))]
        taken = np.where(cut, size - left, 0)
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(taken)])
        places = np.arange(offsets[-1]) + np.repeat(at[1:] - offsets[1:], taken)
        marks = pa.Array.from_buffers(pa.string(), len(cut), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat[places])])
        return [pc.if_else(pa.array(cut), trimmed, folded), marks]

    def _encoded(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece."""
        texts = [x.decode("utf-8", "replace") for x in pieces]
        if not self.plain:
            return [array(self.kind, x.ids).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        letters = [i for i, x in enumerate(texts) if x.isalpha() and (x.isascii() or x == x.lower() and unicodedata.is_normalized("NFC", x))]
        out: list = [None] * len(texts)
        if letters:
            ids = np.array(self.lean.encode_batch_fast([" ".join([texts[i] for i in letters])], add_special_tokens=False)[0].ids, np.dtype(self.kind))
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
            data = ids.tobytes()
            if len(cuts) == len(letters):
                for i, a, b in zip(letters, [0, *cuts], cuts, strict=False):
                    out[i] = data[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.library.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = array(self.kind, x.ids).tobytes()
        return out

    def _known(self, pieces: pa.Array) -> pa.Array:
        """Ids of each piece; new ones are encoded."""
        own = pieces.dictionary_encode()
        distinct = _as_bytes(own.dictionary)
        ids = list(map(self.seen.get, distinct))
        new = [i for i, x in enumerate(ids) if x is None]
        for i in new:
            ids[i] = self.before.get(distinct[i])
        todo = [i for i in new if ids[i] is None]
        for k in range(0, len(todo), 1024):
            some = todo[k : k + 1024]
            for i, x in zip(some, self._encoded([distinct[i] for i in some]), strict=True):
                ids[i] = x
        self.seen.update((distinct[i], ids[i]) for i in new)
        return pa.array(ids, pa.binary()).take(own.indices)

    def encode_column(self, texts: pa.Array, end: bytes) -> pa.Array:
        """Ids of each text (null: empty) and ``end``, as binary."""
        if len(self.seen) > self.remembered:
            self.before, self.seen = self.seen, {}
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        words = split.flatten().dictionary_encode()
        ids = pc.binary_join_element_wise(*(self._known(x) for x in self._parts(words.dictionary)), b"")
        # The end id is one more piece, after the last one of each text.
        ends = np.cumsum(np.asarray(pc.list_value_length(split), np.int64))
        order = np.insert(np.asarray(words.indices), ends, len(ids))
        joined = pa.concat_arrays([ids, pa.array([end], pa.binary())]).take(pa.array(order))
        _, offsets, data = joined.buffers()
        ends = np.concatenate([np.zeros(1, np.int64), ends + np.arange(1, len(ends) + 1)])
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(np.frombuffer(offsets, np.int32)[ends]), data])

    def encode(self, texts: list[bytes], end: bytes) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.binary()).view(pa.string()), end).to_pylist()


def encode(docs: DataFrame, vocabulary: str, *, end_id: int, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (binary, ``width`` bytes an id, with ``end_id``) of each row, in the order of the rows.

    vocabulary: a tokenizers JSON file whose rules treat ASCII white space as a separator that belongs to no token.
    """
    end = end_id.to_bytes(width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = WordIds(vocabulary, width)
        for batch in batches:
            column = batch.column(1)
            for i, j in slices(column, 1 << 22):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), own.encode_column(column.slice(i, j - i), end)], ["doc_id", "ids"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, ids binary")


def write(docs: DataFrame, path: str, vocabulary: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 1 << 29) -> None:
    """Writes the ids of all texts into a new folder, in ascending order of the integer key."""
    from tokenizers import Tokenizer

    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must be an integer")
    spark = docs.sparkSession
    width = 2 if max(end_id + 1, Tokenizer.from_file(vocabulary).get_vocab_size()) <= 1 << 16 else 4
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    # Small inputs are written by all cores, large ones in shards of one size.
    shards = max(-(-size // shard_bytes), min(2 * spark.sparkContext.defaultParallelism, -(-size // (1 << 20))), 1)
    # The partition of the input lets equal rows span shards, and is the same when a task runs again.
    order = ["doc_id", "_hash", "_part"]
    placed = rows.withColumn("_hash", F.xxhash64("text")).withColumn("_part", F.spark_partition_id()).repartitionByRange(int(shards), *order).sortWithinPartitions(*order)
    spark.dataSource.register(TokenFiles)
    encode(placed, vocabulary, end_id=end_id, width=width).write.format("token_ids").option("path", path).option("width", width).mode("append").save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids`` of all documents in a folder."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_ids").option("path", path).load()
