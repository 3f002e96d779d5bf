"""N-gram Jaccard join with set-relation skipping.

Documents are sets of distinct word shingles (64-bit hashes); two link when their
Jaccard similarity reaches a threshold, and a class is what links connect.

1. *Shared shingles.* A set can only link if the threshold's share of it occurs
   in other sets. Each slice of documents sends every distinct shingle once, in
   packed blobs by hash range, and shingles met twice in a slice without an
   owner, so one shingle in a third of all documents is one entry a slice. There are
   as many ranges as keep each below ``BUCKET_BYTES``, and a task reads one.
   Sets with too few shared shingles are finished here.
2. *Equal sets* become one set (the same answers, derived without a search).
3. *Index lists.* A set's rarest shingles, as many as the threshold lets two
   linked sets differ by and one more, are its index entries. Each entry carries
   the shingle's position in the set, rarest first, and the set's size.
4. *Pivots.* In each list every set is compared with one pivot, the set met most
   often. Members linked to the pivot share its class, so no pair among them is
   looked at.
5. *Block skipping.* What is left are pairs in one list and different classes. A list
   is cut into blocks of one class, neighbouring sizes and positions, with ``BLOCK`` entries
   or so, however long it is. Two blocks are skipped if their sizes are too far apart
   or if their positions leave too few shingles to share: of two sets that hold a
   shingle at positions i and j, with r and s shingles from there on, no more than
   min(i, j) + min(r, s) are shared. Pairs of the blocks that remain are tested
   likewise, and by bitmaps: each set has ``BITS`` parity bits, and two bitmaps
   differ in no more bits than their sets differ in shingles.
6. *Incremental answers.* A set is answered from the answers of its nearest pivot, to
   which it links. The pivots of a pair are compared once; the pair itself differs in no
   more shingles than the pivots and the ways to them together, and in no fewer than the
   pivots less those ways. Only pairs that these bounds leave open are compared in full.

No pair that could link is left out, whatever the list's length. Sets hold hashes: two
different shingles count as one only if 64 bits agree.

Defined results: null, empty and blank texts have the empty set and link with
nothing; a text shorter than a shingle is one shingle; a text of any length is one set;
a similarity of exactly the threshold links; rows that repeat a key count once, with the
least set by fingerprint; rows with a null key are left out; an empty table gives an
empty table; columns other than the named ones are ignored, whatever their names. Keys
are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import textbatch
from scriptorium.llm.durable import checkpoint
from scriptorium.llm.textbatch import tidy

#: Keys up to this number are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 2_000_000
#: Bytes of shingles that a task of the first step holds, and entries of a block of an index list.
BUCKET_BYTES = 64 << 20
BLOCK = 32
#: Parts of a bucket's shingles that are sorted one after another (a divisor of 256).
PARTS = 16
_NOBODY = 0xFFFF
#: Parity bits of a set.
BITS = 512
_SALT = np.uint64(0xD6E8FEB86659FD93)


def shingles(flat: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (shingle hash, text number) of a slice of texts, ordered by hash."""
    starts, ends, first = textbatch.words(flat, at)
    word = textbatch.word_hashes(flat, starts, ends)
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    hashed = textbatch.window_hashes(word, width)
    whole = np.arange(len(word)) + width <= first[1:][owner] if len(word) else np.zeros(0, bool)
    tokens, owners = [hashed[whole]], [owner[whole]]
    for short in range(1, width):
        some = np.flatnonzero(n == short)
        if len(some):
            tokens.append(textbatch.window_hashes(word, short)[first[some]])
            owners.append(some)
    token, own = np.concatenate(tokens), np.concatenate(owners)
    order = np.argsort(token, kind="stable")
    token, own = token[order], own[order]
    if len(token):
        order = np.lexsort((own, token)) if (token[1:] == token[:-1]).any() else slice(None)
        token, own = token[order], own[order]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (own[1:] != own[:-1])])
        token, own = token[new], own[new]
    return token, own


def fingerprints(token: np.ndarray, own: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and 128-bit fingerprint of each text's set."""
    size = np.bincount(own, minlength=n_texts)
    order = np.argsort(own, kind="stable")
    has = np.flatnonzero(size)
    at = (np.cumsum(size) - size)[has]
    out = np.zeros((2, n_texts), np.uint64)
    if len(has):
        with np.errstate(over="ignore"):
            for k, salt in enumerate((np.uint64(0), _SALT)):
                out[k, has] = np.add.reduceat(textbatch.mix(token[order] ^ salt), at)
    return size, out[0].view(np.int64), out[1].view(np.int64)


def bitmaps(token: np.ndarray, own: np.ndarray, n_texts: int) -> np.ndarray:
    """``BITS`` parity bits of each text's set, as 64-bit integers. ``own`` must not fall."""
    out = np.zeros((n_texts, BITS // 64), np.int64)
    place = (textbatch.mix(token ^ ~_SALT) % np.uint64(BITS)).astype(np.int64)
    for k in range(0, n_texts, 2048):
        m = min(2048, n_texts - k)
        i, j = np.searchsorted(own, (k, k + m))
        odd = np.bincount((own[i:j] - k) * BITS + place[i:j], minlength=m * BITS).astype(np.uint8) & 1
        out[k : k + m] = np.packbits(odd.reshape(m, BITS), axis=1).view(np.int64)
    return out


def _small_slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    for i, j in textbatch.slices(column):
        for k in range(i, j, _NOBODY - 1):
            yield k, min(j, k + _NOBODY - 1)


_SETS = "ids array<long>, n array<int>, f1 array<long>, f2 array<long>, shared array<int>"
_SENT = f"bucket int, slice long, {_SETS}, hashes binary, owners binary"
_MET = f"slice long, {_SETS}, owners binary, counts binary"
_MEMBER = "id long, n int, f1 long, f2 long, shared long"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], [name for name, _ in fields])


def _send(width: int, buckets: int):
    """Docs (id, text) to one row of sets per slice and one blob of shingles per slice and bucket.

    A blob has the low 48 bits of each shingle (the bucket stands for high ones) and
    the number, in the slice, of the text that has it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slice_id = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j in _small_slices(batch.column(1)):
                ids = batch.column(0).slice(i, j - i).to_numpy(zero_copy_only=False)
                token, own = shingles(*textbatch.utf8(batch.column(1).slice(i, j - i)), width)
                size, f1, f2 = fingerprints(token, own, j - i)
                first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(token)))
                shared = np.bincount(own[np.repeat(times > 1, times)], minlength=j - i)
                slice_id += 1
                rows = [(slice_id % buckets, slice_id, ids, size, f1, f2, shared, None, None)]
                sent, owner = token[first], np.where(times > 1, _NOBODY, own[first]).astype(np.uint16)
                edge = np.searchsorted((sent >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
                low = np.ascontiguousarray(sent).view(np.uint8).reshape(-1, 8)[:, :6]
                nothing = (None,) * 5
                rows += [(b, slice_id, *nothing, low[p:q].tobytes(), owner[p:q].tobytes()) for b, (p, q) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if p < q]
                yield _batch(rows, _SENT)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one bucket to one row per slice: how many shingles of which texts other slices have too. Sets pass through."""
    blobs: list[tuple] = []
    for batch in batches:
        for row in (batch.slice(k, 1) for k in range(len(batch))):
            if row.column(7)[0].is_valid:
                blobs.append((row.column(1)[0].as_py(), row.column(7)[0].as_py(), row.column(8)[0].as_py()))
            else:
                empty = pa.nulls(1, pa.binary())
                yield pa.RecordBatch.from_arrays([*row.columns[1:7], empty, empty], [x.split()[0] for x in _MET.split(", ")])
    if blobs:
        wide = np.zeros((sum(len(owners) // 2 for _, _, owners in blobs), 8), np.uint8)
        at = 0
        for k, (slice_id, hashes, owners) in enumerate(blobs):
            own = np.frombuffer(hashes, np.uint8).reshape(-1, 6)
            wide[at : at + len(own), :6] = own
            at += len(own)
            blobs[k] = (slice_id, None, owners)
        token = wide.view(np.uint64)[:, 0]
        met = np.zeros(len(token), bool)
        # Equal shingles end on the same bits: a part of them is sorted at a time, so that no second array of all is held.
        last = wide[:, 0] % PARTS
        for part in range(PARTS):
            some = np.flatnonzero(last == part)
            some = some[np.argsort(token[some])]
            own = token[some]
            same = own[1:] == own[:-1]
            met[some[1:][same]] = True
            met[some[:-1][same]] = True
        del wide, token, last
        at, rows = 0, []
        for slice_id, _, owners in blobs:
            owner = np.frombuffer(owners, np.uint16)
            who, n = np.unique(owner[met[at : at + len(owner)] & (owner != _NOBODY)], return_counts=True)
            at += len(owner)
            rows.append((slice_id, *(None,) * 5, who.tobytes(), n.astype(np.int32).tobytes()))
        yield _batch(rows, _MET)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_meet``, ordered by slice, to the slice's sets with their number of shared shingles."""
    names = [x.split()[0] for x in _MEMBER.split(", ")]

    def members(sets: pa.RecordBatch | None, more: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        if sets is not None:
            own = [sets.column(k).flatten() for k in range(1, 6)]
            shared = own[4].to_numpy(zero_copy_only=False).astype(np.int64)
            for who, n in more:
                shared[np.frombuffer(who, np.uint16)] += np.frombuffer(n, np.int32)
            yield pa.RecordBatch.from_arrays([*own[:4], pa.array(shared)], names)

    now, sets, more = None, None, []
    for batch in batches:
        for row in (batch.slice(k, 1) for k in range(len(batch))):
            slice_id = row.column(0)[0].as_py()
            if slice_id != now:
                yield from members(sets, more)
                now, sets, more = slice_id, None, []
            if row.column(1)[0].is_valid:
                sets = row
            else:
                more.append((row.column(6)[0].as_py(), row.column(7)[0].as_py()))
    yield from members(sets, more)


_WORDS = [f"bits{k}" for k in range(BITS // 64)]


def _tokens(width: int):
    """Docs (id, text) to their sets, with the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in textbatch.slices(batch.column(1)):
                token, own = shingles(*textbatch.utf8(batch.column(1).slice(i, j - i)), width)
                size, f1, f2 = fingerprints(token, own, j - i)
                order = np.argsort(own, kind="stable")
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(token[order].view(np.int64)))
                bits = bitmaps(token[order], own[order], j - i)
                columns = [pa.array(np.ascontiguousarray(bits[:, k])) for k in range(BITS // 64)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(f1), pa.array(f2), lists, *columns], ["id", "f1", "f2", "tokens", *_WORDS])

    return run


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``id`` and ``label`` (the least id that links reach) of each node; links: ``a``, ``b``."""
    both = checkpoint(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = checkpoint(nodes.select("id", F.col("id").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", "label", F.least("label", "near").alias("to"))
        # One more step along the labels halves the way to the least one.
        jump = labels.select(F.col("id").alias("to"), F.col("label").alias("far"))
        after = checkpoint(step.join(jump, "to").select("id", F.least("to", "far").alias("label"), (F.least("to", "far") < F.col("label")).alias("moved")))
        labels = after.select("id", "label")
        if after.filter("moved").limit(1).count() == 0:
            return labels


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_KEYS else df


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the sizes of their sets and ``d``, the number of shingles that only one of them has."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("common").alias("s_a"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("common").alias("s_b"))
    d = F.col("n_a") + F.col("n_b") - 2 * F.size(F.array_intersect("s_a", "s_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", d.alias("d"))


def _near(d: str, pct: int) -> str:
    """Whether sets of n_a and n_b shingles that differ in so many link."""
    return f"({d}) * {100 + pct} <= {100 - pct} * (n_a + n_b)"


def _open_pairs(lists: DataFrame, labels: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """Pairs (a, b) of one list and different classes that no bound rules out. Both sides of
    each join are tables of their own, so that Spark can split the blocks of a long list."""
    entries = lists.join(labels, "id")
    split = checkpoint(entries.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("token"))
    size_block = F.floor(F.log(F.col("n").cast("double")) / np.log(100 / pct + 1e-9)).cast("int")
    # An entry's position is in the first (100 - pct) % of its set: four blocks of that.
    place_block = F.floor(F.col("i") * 400 / (F.col("n") * (100 - pct) + 1)).cast("int")
    salt = F.pmod(F.xxhash64("id"), F.ceil(F.col("count") / BLOCK))
    entry = F.struct("id", "n", "i", "r", *_WORDS)
    cut = entries.join(split, "token").join(sets.select("id", *_WORDS), "id").withColumns({"size_block": size_block, "place_block": place_block, "salt": salt})
    blocks = cut.groupBy("token", "label", "size_block", "place_block", "salt").agg(F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.max("i").alias("i_hi"), F.max("r").alias("r_hi"), F.collect_list(entry).alias("own"))
    blocks = checkpoint(blocks.drop("place_block", "salt"))
    other = blocks.select("token", F.explode(F.array(F.col("size_block"), F.col("size_block") + 1)).alias("size_block"), *[F.col(c).alias(f"{c}_b") for c in ("label", "n_lo", "n_hi", "i_hi", "r_hi", "own")])
    fits = f"label_b <> label and n_lo_b <= n_hi and 100 * n_hi_b >= {pct} * n_lo and (least(i_hi, i_hi_b) + least(r_hi, r_hi_b)) * {100 + pct} >= {pct} * (n_lo + n_lo_b)"
    apart = " + ".join(f"bit_count(x.{w} ^ y.{w})" for w in _WORDS)
    close = f"""(y.n < x.n or (y.n = x.n and y.id < x.id)) and 100 * y.n >= {pct} * x.n
                and (least(x.i, y.i) + least(x.r, y.r)) * {100 + pct} >= {pct} * (x.n + y.n) and ({apart}) * {100 + pct} <= {100 - pct} * (x.n + y.n)"""
    met = f"flatten(transform(own, x -> transform(filter(own_b, y -> {close}), y -> struct(x.id AS a, y.id AS b, x.n AS n_a, y.n AS n_b))))"
    return blocks.join(other, ["token", "size_block"]).filter(fits).selectExpr(f"inline({met})").distinct()


def _answered(pairs: DataFrame, links: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """Those of the pairs (a, b, n_a, n_b) that link, by the answers of their pivots where these decide. links: (a, pivot b, d)."""
    home = links.groupBy("a").agg(F.min(F.struct("d", "b")).alias("h")).select(F.col("a").alias("id"), F.col("h.b").alias("home"), F.col("h.d").alias("way"))
    side = lambda x: home.select(F.col("id").alias(x), F.col("home").alias(f"home_{x}"), F.col("way").alias(f"way_{x}"))
    known = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", "n_a", "n_b", F.coalesce("home_a", "a").alias("p"), F.coalesce("home_b", "b").alias("q"), (F.coalesce("way_a", F.lit(0)) + F.coalesce("way_b", F.lit(0))).alias("ways"))
    known = checkpoint(known.withColumns({"p": F.least("p", "q"), "q": F.greatest("p", "q")}))
    pivots = checkpoint(_measured(known.select(F.col("p").alias("a"), F.col("q").alias("b")).distinct(), sets)).select(F.col("a").alias("p"), F.col("b").alias("q"), "d")
    bounded = known.join(pivots, ["p", "q"])
    sure = bounded.filter(_near("d + ways", pct)).select("a", "b")
    open_ = bounded.filter(f"not {_near('d + ways', pct)} and {_near('d - ways', pct)}").select("a", "b")
    return sure.unionByName(_measured(open_, sets).filter(_near("d", pct)).select("a", "b"))


def jaccard_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, pct: int = 80) -> DataFrame:
    """``id_col``, ``n_shingles`` (long) and ``component_id`` (least key reachable by links) of each key.

    Two documents link when 100 * |intersection| >= ``pct`` * |union|.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).filter("id is not null")
    # A word and its blank are six bytes or so, its shingle eight in a blob.
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * n_bytes // BUCKET_BYTES))
    sent = rows.mapInArrow(tidy(_send(width, buckets)), _SENT).repartitionById(buckets, F.col("bucket"))
    met = sent.mapInArrow(tidy(_meet), _MET).repartition(buckets, "slice").sortWithinPartitions("slice")
    known = met.mapInArrow(tidy(_tally), _MEMBER).groupBy("id").agg(F.min(F.struct("f1", "f2", "n")).alias("s"), F.sum("shared").alias("shared"))
    members = checkpoint(known.select("id", "s.f1", "s.f2", "s.n", "shared"))
    hopeful = members.filter(f"n > 0 and shared * 100 >= n * {pct}")
    # Equal sets are one set from here on.
    chosen = checkpoint(hopeful.groupBy("f1", "f2", "n").agg(F.min("id").alias("id")))
    n_chosen = chosen.count()
    texts = rows.join(_maybe_broadcast(chosen.select("id"), n_chosen), "id", "left_semi")
    kinds = "".join(f", {w} long" for w in _WORDS)
    sets = texts.mapInArrow(tidy(_tokens(width)), f"id long, f1 long, f2 long, tokens array<long>{kinds}").join(_maybe_broadcast(chosen, n_chosen), ["id", "f1", "f2"]).dropDuplicates(["id"])
    sets = checkpoint(sets.select("id", "n", "tokens", *_WORDS))
    entries = sets.select("id", F.explode("tokens").alias("token"))
    common = checkpoint(entries.groupBy("token").count().filter("count > 1").withColumnRenamed("count", "df"))
    ordered = entries.join(common, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    # n - size(shared) shingles are found nowhere else; a linked set has none but (100 - pct) % of them.
    sets = sets.drop("tokens").join(ordered, "id").filter(F.size("shared") * 100 >= F.col("n") * pct)
    sets = checkpoint(sets.select("id", "n", F.col("shared.token").alias("common"), *_WORDS))
    # The rarest come first: those found nowhere else, then by document frequency. Positions leave the former out.
    lead = F.floor(F.col("n") * (100 - pct) / 100).cast("int") + 1 - (F.col("n") - F.size("common"))
    lists = sets.filter(lead > 0).select("id", "n", F.size("common").alias("c"), F.posexplode(F.slice("common", F.lit(1), lead)).alias("i", "token"))
    lists = lists.select("token", "id", "n", "i", (F.col("c") - F.col("i")).alias("r"))
    many = checkpoint(lists.groupBy("token").count().filter("count > 1"))
    lists = checkpoint(lists.join(many, "token"))
    popular = lists.groupBy("id").agg(F.sum(F.col("count") - 1).alias("met"))
    ranked = checkpoint(lists.join(popular, "id").groupBy("token").agg(F.max(F.struct(F.col("met"), (-F.col("id")).alias("minus"))).alias("top")).select("token", (-F.col("top.minus")).alias("b")))
    stars = lists.select("token", F.col("id").alias("a")).join(ranked, "token").filter("a <> b").select("a", "b").distinct()
    tested = checkpoint(_measured(stars, sets))
    links = tested.filter(_near("d", pct)).select("a", "b", "d")
    labels = components(sets.select("id"), links)
    rest = _open_pairs(lists, labels, sets, pct)
    for a, b in (("a", "b"), ("b", "a")):
        rest = rest.join(tested.select(F.col(a).alias("a"), F.col(b).alias("b")), ["a", "b"], "left_anti")
    more = checkpoint(_answered(checkpoint(rest), links, sets, pct))
    labels = components(sets.select("id"), links.select("a", "b").union(more))
    # One answer for each set; the rows of a set with very many copies meet it in one join, which Spark can split.
    answers = checkpoint(chosen.join(labels, "id", "left").select("f1", "f2", "n", F.coalesce("label", "id").alias("label")))
    found = members.join(_maybe_broadcast(answers, n_chosen), ["f1", "f2", "n"], "left")
    return found.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("label", "id").alias("component_id"))
