"""Full-text search: BM25 ranking over texts or over postings, and the substring fallback.

``search_texts`` answers one query by one scan of the texts and no shuffle of them.
Postings (term, doc_id, field, tf, positions) serve many queries; ``search_index`` keeps
them as a table that a query reads in part. Scores are positive, higher is better.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.durable import checkpoint
from scriptorium.functions.text import contains_ascii_folded

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
#: Tokens that a task groups at once.
SLICE_TOKENS = 1 << 20
#: Hits up to this number are broadcast to find their documents.
BROADCAST_HITS = 100_000


def _latin_marks() -> dict[str, str]:
    """Small Latin letters with marks, by the letter that their decomposition starts with."""
    out = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        letter = chr(code)
        plain = unicodedata.normalize("NFD", letter)[0]
        if letter == letter.lower() and plain != letter and "a" <= plain <= "z":
            out[letter] = plain
    return out


MARKS = _latin_marks()
_MARKED, _PLAIN = "".join(MARKS), "".join(MARKS.values())


def tokens(text: Column, *, fold: bool = True) -> Column:
    """Lower-case runs of letters and digits; ``fold`` drops the marks of Latin letters, also those written as characters of their own."""
    low = F.lower(F.coalesce(text, F.lit("")))
    folded = F.regexp_replace(F.translate(low, _MARKED, _PLAIN), "[\u0300-\u036f]+", "") if fold else low
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_words(query: str, *, fold: bool = True) -> list[str]:
    """The words of a query, as ``tokens`` makes them of texts."""
    low = query.lower()
    if fold:
        low = re.sub("[\u0300-\u036f]+", "", low.translate(str.maketrans(MARKS)))
    words, inside = [""], False
    for c in low:
        inside = unicodedata.category(c)[0] in "LN"
        words = [*words[:-1], words[-1] + c] if inside else [*words, ""] if words[-1] else words
    return [w for w in words if w]


def search_texts(docs: DataFrame, fields: list[str], terms: list[str], *, id_col: str = "doc_id", mode: str = "all", exclude: list[str] | None = None, prefix: bool = False, phrase: list[str] | None = None, columns: list[str] | None = None, fold: bool = True, limit: int | None = 50) -> DataFrame:
    """``doc_id`` and ``score`` of the best matches, as ``search`` over the postings of ``fields``.

    One scan makes tokens of each text once and keeps a few numbers a document (written to the shared folder), from which documents are rated.
    """
    total = lambda parts: reduce(lambda a, b: a + b, parts)
    wanted = list(dict.fromkeys([*terms, *(phrase or [])]))

    def measures(row: Column) -> Column:
        every = [row[f"t{k}"] for k in range(len(fields))]
        own = [t for t, f in zip(every, fields, strict=True) if columns is None or f in columns]

        def frequency(word: str, last: bool) -> Column:
            same = (lambda x: F.startswith(x, F.lit(word))) if prefix and last else (lambda x: x == word)
            return total([F.size(F.filter(t, same)) for t in own])

        met = F.lit(True)
        if exclude:
            met = ~F.exists(F.concat(*own), lambda x: x.isin(exclude))
        if phrase:
            held = reduce(lambda a, b: a & b, [F.array_contains(F.concat(*own), w) for w in phrase])
            follows = lambda t: F.exists(F.sequence(F.lit(0), F.size(t) - 1), lambda i: reduce(lambda a, b: a & b, [F.coalesce(F.get(t, i + k) == w, F.lit(False)) for k, w in enumerate(phrase)]))
            met = met & F.when(held, reduce(lambda a, b: a | b, [(F.size(t) >= len(phrase)) & follows(t) for t in own])).otherwise(F.lit(False))
        return F.struct(total([F.size(t) for t in every]).alias("dl"), *[frequency(w, k == len(wanted) - 1).alias(f"tf{k}") for k, w in enumerate(wanted)], met.alias("met"))

    # A generator is a wall for the optimiser: no filter that stands behind it makes tokens again.
    bound = F.transform(F.array(F.struct(*[tokens(docs[f], fold=fold).alias(f"t{k}") for k, f in enumerate(fields)])), measures)
    rows = checkpoint(docs.select(docs[id_col].alias("doc_id"), F.inline(bound)).filter("dl > 0"))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(wanted))]).first()
    n, mean = seen["n"], seen["mean"] or 1.0
    held = [F.col(f"tf{k}") > 0 for k in range(len(wanted))]
    rows = rows.filter(reduce(lambda a, b: (a & b) if mode == "all" else (a | b), held, F.lit(mode == "all")) & F.col("met"))
    parts = [_idf(F.lit(n), F.lit(seen[f"df{k}"])) * _saturation(F.col(f"tf{k}"), F.col("dl"), mean) for k in range(len(wanted))]
    scored = rows.select("doc_id", total(parts or [F.lit(0.0)]).alias("score"))
    return scored if limit is None else scored.orderBy(F.desc("score"), "doc_id").limit(limit)


def _idf(n_docs: Column, df: Column) -> Column:
    return F.greatest(F.log((n_docs - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))


def _saturation(tf: Column, dl: Column, mean) -> Column:
    """What ``tf`` occurrences in a text of ``dl`` tokens count."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def document_postings(docs: DataFrame, fields: list[str], *, id_col: str = "doc_id", fold: bool = True) -> DataFrame:
    """``doc_id``, ``term``, ``field``, ``tf``, ``positions``, ``dl`` (tokens of the document) and ``lead`` (true once a document).

    Occurrences are grouped where the document is, so nothing is shuffled; a task holds about ``SLICE_TOKENS`` tokens, or those of one document.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def group(keys: pa.Array, columns: list[pa.ListArray]) -> Iterator[pa.RecordBatch]:
        sizes = [np.asarray(pc.list_value_length(c), np.int64) for c in columns]
        dl = np.sum(sizes, axis=0)
        fresh = np.ones(len(keys), bool)
        for field, column, size in zip(fields, columns, sizes, strict=True):
            coded = column.flatten().dictionary_encode()
            doc = np.repeat(np.arange(len(keys)), size)
            at = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
            key = doc * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            lead = np.flatnonzero(np.diff(key[order], prepend=-1))
            own = doc[order][lead]
            first = (np.diff(own, prepend=-1) != 0) & fresh[own]
            fresh[own] = False
            cuts = np.append(lead, len(doc)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(own)), coded.dictionary.take(coded.indices.take(pa.array(order[lead]))), pa.array([field] * len(lead), pa.string()), pa.array(np.diff(cuts).astype(np.int64)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(at[order].astype(np.int32))), pa.array(dl[own]), pa.array(first)],
                ["doc_id", "term", "field", "tf", "positions", "dl", "lead"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.sum([np.asarray(pc.list_value_length(c), np.int64) for c in batch.columns[1:]], axis=0)
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // SLICE_TOKENS)) + 1).tolist(), len(size)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i < j:
                    yield from group(batch.column(0).slice(i, j - i), [c.slice(i, j - i) for c in batch.columns[1:]])

    rows = docs.select(docs[id_col].alias("doc_id"), *[tokens(docs[f], fold=fold).alias(f"t{k}") for k, f in enumerate(fields)])
    return rows.mapInArrow(run, f"doc_id {kind}, term string, field string, tf long, positions array<int>, dl long, lead boolean")


def build_postings(docs: DataFrame, fields: list[str], *, id_col: str = "doc_id", fold: bool = True) -> DataFrame:
    """One row per term, document and field, with its positions. Documents without any of the fields are not indexed; keys are distinct."""
    return document_postings(docs, fields, id_col=id_col, fold=fold).drop("dl", "lead")


def doc_lengths(postings: DataFrame) -> DataFrame:
    """Tokens of each document over all fields."""
    return postings.groupBy("doc_id").agg(F.sum("tf").alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: number of documents and their mean length."""
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl"))


def index_report(postings: DataFrame) -> DataFrame:
    """Counts of an index build."""
    return postings.agg(F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("term").alias("n_terms"), F.count(F.lit(1)).alias("n_postings"), F.sum("tf").alias("n_tokens"))


def _phrase_docs(postings: DataFrame, phrase: list[str]) -> DataFrame:
    """Documents in one field of which the words stand one after another."""
    at = postings.filter(F.col("term").isin(phrase)).select("doc_id", "field", "term", F.explode("positions").alias("pos"))
    starts = reduce(DataFrame.unionByName, [at.filter(F.col("term") == w).select("doc_id", "field", (F.col("pos") - k).alias("start"), F.lit(k).alias("k")) for k, w in enumerate(phrase)])
    return starts.groupBy("doc_id", "field", "start").agg(F.count_distinct("k").alias("n")).filter(F.col("n") == len(phrase)).select("doc_id").distinct()


def search(postings: DataFrame, terms: list[str], *, mode: str = "all", exclude: list[str] | None = None, prefix: bool = False, phrase: list[str] | None = None, columns: list[str] | None = None, lengths: DataFrame | None = None, limit: int | None = 50) -> DataFrame:
    """``doc_id`` and ``score`` of the best matches.

    mode: ``all`` terms must occur or ``any``. prefix: the last term may be the start
    of a word. phrase: words that must follow each other. columns: fields to look in.
    """
    lengths = doc_lengths(postings) if lengths is None else lengths
    stats = corpus_stats(lengths)
    own = postings if columns is None else postings.filter(F.col("field").isin(columns))
    wanted = list(dict.fromkeys([*terms, *(phrase or [])]))
    exact = wanted[:-1] if prefix else wanted
    named = F.when(F.col("term").isin(exact), F.col("term"))
    if prefix:
        named = F.coalesce(named, F.when(F.startswith("term", F.lit(wanted[-1])), F.lit(wanted[-1] + "*")))
    hits = own.withColumn("q", named).filter("q is not null").groupBy("doc_id", "q").agg(F.sum("tf").alias("tf"))
    df = hits.groupBy("q").agg(F.count(F.lit(1)).alias("df"))
    idf = _idf(F.col("n_docs"), F.col("df"))
    # The term and corpus statistics are one row a term and one row in all.
    rated = df.crossJoin(F.broadcast(stats)).select("q", idf.alias("idf"), "avg_dl")
    part = F.col("idf") * _saturation(F.col("tf"), F.col("dl"), F.col("avg_dl"))
    scored = hits.join(F.broadcast(rated), "q").join(lengths, "doc_id").groupBy("doc_id").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("n_terms"))
    if mode == "all":
        scored = scored.filter(F.col("n_terms") == len(wanted))
    if exclude:
        scored = scored.join(own.filter(F.col("term").isin(exclude)).select("doc_id").distinct(), "doc_id", "left_anti")
    if phrase:
        scored = scored.join(_phrase_docs(own, phrase), "doc_id", "left_semi")
    scored = scored.select("doc_id", "score")
    return scored if limit is None else scored.orderBy(F.desc("score"), "doc_id").limit(limit)


def search_documents(docs: DataFrame, fields: list[str], query: str, *, postings: DataFrame | None = None, id_col: str = "doc_id", saved_col: str | None = None, limit: int = 50, **options) -> DataFrame:
    """Documents with all their columns and ``score``, best first; a query without a word gives the newest.

    With ``postings`` the index is asked, else the texts of ``fields``. A ``*`` at the end makes the last word a prefix.
    """
    words = query_words(query)
    if not words:
        newest = F.col(saved_col).desc_nulls_last() if saved_col else F.col(id_col).desc()
        return docs.withColumn("score", F.lit(None).cast("double")).orderBy(newest, F.col(id_col).desc()).limit(limit)
    options = {"prefix": query.rstrip().endswith("*"), **options}
    hits = search_texts(docs, fields, words, id_col=id_col, limit=limit, **options) if postings is None else search(postings, words, limit=limit, **options)
    hits = hits.withColumnRenamed("doc_id", id_col)
    return docs.join(F.broadcast(hits) if limit <= BROADCAST_HITS else hits, id_col).orderBy(F.desc("score"), id_col)


def search_substring(docs: DataFrame, query: str, fields: list[str], *, id_col: str = "doc_id", saved_col: str | None = None, limit: int = 50) -> DataFrame:
    """Documents any field of which contains the query, newest first, unknown dates last."""
    found = docs.filter(reduce(lambda a, b: a | b, [contains_ascii_folded(F.col(f), query) for f in fields]))
    order = [F.col(saved_col).desc_nulls_last()] if saved_col else []
    return found.orderBy(*order, F.col(id_col).desc()).limit(limit)


def search_many(postings: DataFrame, queries: DataFrame, *, limit: int = 100) -> DataFrame:
    """All saved queries (query_id, terms array) in one job: the best ``limit`` documents of each, all terms required."""
    from pyspark.sql import Window

    lengths = doc_lengths(postings)
    asked = queries.select("query_id", F.size(F.array_distinct("terms")).alias("n_asked"), F.explode(F.array_distinct("terms")).alias("term"))
    hits = postings.join(asked, "term").groupBy("query_id", "n_asked", "term", "doc_id").agg(F.sum("tf").alias("tf"))
    df = hits.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df"))
    rated = df.crossJoin(F.broadcast(corpus_stats(lengths)))
    part = _idf(F.col("n_docs"), F.col("df")) * _saturation(F.col("tf"), F.col("dl"), F.col("avg_dl"))
    scored = hits.join(rated, ["query_id", "term"]).join(lengths, "doc_id").groupBy("query_id", "n_asked", "doc_id").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("n")).filter("n = n_asked")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("position", nth).filter(F.col("position") <= limit).select("query_id", "doc_id", "score", "position")


def append_postings(postings: DataFrame, new_docs: DataFrame, fields: list[str], *, id_col: str = "doc_id") -> DataFrame:
    """Postings with those of new or changed documents."""
    fresh = build_postings(new_docs, fields, id_col=id_col)
    return postings.join(new_docs.select(new_docs[id_col].alias("doc_id")), "doc_id", "left_anti").unionByName(fresh)
