"""Nearest neighbours over vectors, exact and approximate, and search built on them.

One query is an expression over a scan and a top-k (TakeOrderedAndProject). Many
queries meet all vectors in blocks: blocks of queries are joined with blocks of vectors
by number, a pair of blocks keeps k candidates a query, and these are ranked. No vector
passes through the driver but the centroids of an index, whose number is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.vectors import l2_distance


def _literal(vector: list[float]):
    return F.array(*[F.lit(float(x)) for x in vector])


def nearest(vectors: DataFrame, query: list[float], k: int = 10, *, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The k rows nearest to the query by L2 distance, ties by id, with ``distance``."""
    return vectors.withColumn("distance", l2_distance(F.col(vector_col), _literal(query))).orderBy("distance", id_col).limit(k)


def nearest_filtered(vectors: DataFrame, query: list[float], k: int, where, *, filter_mode: str = "pre", id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """``pre`` filters before the search and gives k rows if there are so many; ``post``
    filters the k nearest of all rows and may give fewer."""
    if filter_mode == "pre":
        return nearest(vectors.filter(where), query, k, id_col=id_col, vector_col=vector_col)
    return nearest(vectors, query, k, id_col=id_col, vector_col=vector_col).filter(where)


def _blocks(rows: DataFrame, id_col: str, vector_col: str, size: int) -> tuple[DataFrame, int]:
    """(block, ids, vectors) and the number of blocks: rows in blocks of about ``size``, dealt by a hash of the id."""
    n = max(1, -(-rows.count() // size))
    dealt = rows.filter(F.col(vector_col).isNotNull()).select(F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias("block"), F.struct(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).alias("x"))
    return dealt.groupBy("block").agg(F.collect_list("x").alias("x")).select("block", F.col("x.id").alias("ids"), F.col("x.vector").alias("vectors")), n


def _matrix(column: pa.Array) -> np.ndarray:
    """A list of vectors as a matrix, from the buffer of its values."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def _best(pairs: DataFrame, k: int, id_kind: str, query_kind: str) -> DataFrame:
    """The k nearest of each pair of blocks (query_ids, query_vectors, ids, vectors), ties by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                asked, q, ids, x = (batch.column(c)[at].values for c in range(4))
                q, x = _matrix(q), _matrix(x)
                order = np.argsort(np.array(ids.to_pylist(), object), kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                found, far = [], []
                for row in q:
                    d = x - row
                    # Equal up to rounding counts as equal, so ties go to the least id.
                    d = np.sqrt(np.einsum("ij,ij->i", d, d)).round(12)
                    some = np.flatnonzero(d <= np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1])
                    some = some[np.lexsort((place[some], d[some]))][:k]
                    found.append(some)
                    far.append(d[some])
                n = [len(f) for f in found]
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(np.repeat(np.arange(len(n)), n))), ids.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(far))], ["query_id", "id", "distance"])

    return pairs.select("query_ids", "query_vectors", "ids", "vectors").mapInArrow(run, f"query_id {query_kind}, id {id_kind}, distance double")


def _ranked(found: DataFrame, k: int, id_col: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("position", nth).filter(F.col("position") <= k).withColumnRenamed("id", id_col)


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str = "id", vector_col: str = "embedding", query_block: int = 1024, vector_block: int = 8192) -> DataFrame:
    """``query_id``, ``id_col``, ``distance`` and ``position`` of the k nearest rows of each query (query_id, vector).

    Distances are rounded to 12 decimals, ties go to the least id; rows without a vector are left out.
    """
    asked, _ = _blocks(queries, "query_id", "vector", query_block)
    rows, n = _blocks(vectors, id_col, vector_col, vector_block)
    # Each block of queries is sent once for every block of vectors.
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"))
    found = _best(rows.join(asked, "block"), k, dict(vectors.dtypes)[id_col], dict(queries.dtypes)["query_id"])
    return _ranked(found, k, id_col)


def _cells(rows: DataFrame, id_col: str, vector_col: str, centroids: np.ndarray, probes: int) -> DataFrame:
    """(id, vector, cell): rows with their ``probes`` nearest centroids."""
    kind = dict(rows.dtypes)[id_col]
    square = (centroids**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 4096):
                part = batch.slice(k, 4096)
                near = np.argsort(square - 2 * _matrix(part.column(1)) @ centroids.T, axis=1, kind="stable")[:, :probes]
                at = pa.array(np.repeat(np.arange(len(part)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(near.ravel().astype(np.int32))], ["id", "vector", "cell"])

    own = rows.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return own.mapInArrow(run, f"id {kind}, vector array<double>, cell int")


def index_centroids(vectors: DataFrame, cells: int, *, id_col: str = "id", vector_col: str = "embedding") -> np.ndarray:
    """Centroids of an index: the vectors of ``cells`` rows, chosen by a hash of the id. This is all that is fitted."""
    some = vectors.filter(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(cells).select(vector_col).collect()
    return np.array([r[0] for r in some], np.float64)


def nearest_approximate(vectors: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str = "id", vector_col: str = "embedding", cells: int = 64, probes: int = 48, block: int = 4096) -> DataFrame:
    """``query_id``, ``id_col``, ``distance`` and ``position`` of k near rows of each query (query_id, vector).

    Every row is in the cell of its nearest centroid, and a query looks into its ``probes`` nearest
    cells; compare with ``nearest_many`` for recall. A cell is cut into blocks, so a full one is many tasks.
    """
    centroids = index_centroids(vectors, cells, id_col=id_col, vector_col=vector_col)
    if not len(centroids):
        return nearest_many(vectors, queries, k, id_col=id_col, vector_col=vector_col)
    n = max(1, -(-vectors.count() // block))
    inside = _cells(vectors, id_col, vector_col, centroids, 1).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    rows = inside.groupBy("cell", "part").agg(F.collect_list(F.struct("id", "vector")).alias("x")).select("cell", F.col("x.id").alias("ids"), F.col("x.vector").alias("vectors"))
    m = max(1, -(-queries.count() * probes // block))
    asking = _cells(queries, "query_id", "vector", centroids, probes).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(m)).cast("int"))
    asked = asking.groupBy("cell", "part").agg(F.collect_list(F.struct("id", "vector")).alias("x")).select("cell", F.col("x.id").alias("query_ids"), F.col("x.vector").alias("query_vectors"))
    return _ranked(_best(rows.join(asked, "cell"), k, dict(vectors.dtypes)[id_col], dict(queries.dtypes)["query_id"]), k, id_col)


def recall(exact: DataFrame, approximate: DataFrame, *, id_col: str = "id", query_col: str | None = None) -> DataFrame:
    """Share of the exact rows that the approximate ones hold; ``query_col`` names the query of a row."""
    key = [id_col] if query_col is None else [query_col, id_col]
    marked = exact.select(*key).join(approximate.select(*key, F.lit(1).alias("hit")), key, "left")
    return marked.agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


def best_per_document(hits: DataFrame, *, doc_col: str = "document_id", id_col: str = "id", text_col: str | None = None, limit: int = 10, extras: int = 3) -> DataFrame:
    """The nearest hit of each document and up to ``extras`` further ones.

    Hits after the one that completes the ``limit``-th document are not looked at.
    """
    own = Window.partitionBy(doc_col).orderBy("distance", id_col)
    ranked = hits.withColumn("doc_rank", F.row_number().over(own)).filter(F.col("doc_rank") <= extras + 1)
    firsts = ranked.filter("doc_rank = 1").orderBy("distance", id_col).limit(limit)
    # The last of the wanted documents sets where reading stops.
    stop = firsts.agg(F.max(F.struct("distance", id_col)).alias("stop"), F.count(F.lit(1)).alias("n"))
    before = (F.col("n") < limit) | (F.struct("distance", id_col) <= F.col("stop"))
    more = ranked.filter("doc_rank > 1").crossJoin(F.broadcast(stop)).filter(before)
    shown = [F.substring(text_col, 1, 200).alias("chunk_text")] if text_col else []
    more = more.groupBy(doc_col).agg(F.sort_array(F.collect_list(F.struct("distance", F.col(id_col).alias("hit_id"), *shown))).alias("other_hits"))
    return firsts.join(more, doc_col, "left").drop("doc_rank")


def chunk_context(chunks: DataFrame, reach: int = 2, *, doc_col: str = "document_id", index_col: str = "chunk_index", text_col: str = "chunk_text") -> DataFrame:
    """Chunks with the text of those before and after; by index, so a gap in the indexes stays a gap."""
    own = Window.partitionBy(doc_col).orderBy(index_col)
    join = lambda w: F.array_join(F.collect_list(F.struct(index_col, text_col)).over(w).getField(text_col), "\n")
    return chunks.withColumn("context_before", join(own.rangeBetween(-reach, -1))).withColumn("context_after", join(own.rangeBetween(1, reach)))


def hit_context(hits: DataFrame, chunks: DataFrame, reach: int = 1, *, doc_col: str = "document_id", index_col: str = "chunk_index", text_col: str = "chunk_text") -> DataFrame:
    """The same for few hits, by a range join instead of a window over all chunks."""
    near = chunks.select(F.col(doc_col).alias("_doc"), F.col(index_col).alias("_at"), F.col(text_col).alias("_text"))
    met = hits.join(near, (near["_doc"] == hits[doc_col]) & near["_at"].between(hits[index_col] - reach, hits[index_col] + reach))
    side = lambda when: F.array_join(F.sort_array(F.collect_list(F.when(when, F.struct("_at", "_text")))).getField("_text"), "\n")
    return met.groupBy(*hits.columns).agg(side(F.col("_at") < F.col(index_col)).alias("context_before"), side(F.col("_at") > F.col(index_col)).alias("context_after"))


def search_chunks(embeddings: DataFrame, chunks: DataFrame, docs: DataFrame, query: list[float], k: int = 10, *, reach: int = 1, include_context: bool = True) -> DataFrame:
    """Nearest chunks with document and context; without chunk vectors, nearest documents."""
    own = embeddings.filter("chunk_id is not null")
    if own.isEmpty():
        return nearest(embeddings, query, k).join(docs, embeddings["document_id"] == docs["id"])
    hits = nearest(own.select(F.col("id").alias("embedding_id"), "chunk_id", "embedding"), query, k, id_col="embedding_id").select("embedding_id", "chunk_id", "distance")
    hits = chunks.withColumnRenamed("id", "chunk_id").join(F.broadcast(hits), "chunk_id")
    found = hit_context(hits, chunks, reach) if include_context else hits
    return found.join(docs.select(F.col("id").alias("document_id"), "title"), "document_id").orderBy("distance", "embedding_id")


def search_library(embeddings: DataFrame, chunks: DataFrame, docs: DataFrame, query: list[float], *, categories: list[str] | None = None, limit: int = 100, extras: int = 3, sort: str | None = None, descending: bool = True, nulls: str = "first") -> DataFrame:
    """Best chunk per document among the given categories, ranked by distance or by a column."""
    own = docs if not categories else docs.filter(F.coalesce("category", F.lit("article")).isin(categories))
    owned = embeddings.filter("chunk_id is not null").select(F.col("id").alias("embedding_id"), "chunk_id", "embedding")
    joined = owned.join(chunks.select(F.col("id").alias("chunk_id"), "document_id", "chunk_text"), "chunk_id").join(own.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    hits = nearest(joined, query, limit * 5, id_col="embedding_id").drop("embedding")
    best = best_per_document(hits, id_col="embedding_id", text_col="chunk_text", limit=limit, extras=extras)
    rows = best.join(own.withColumnRenamed("id", "document_id"), "document_id")
    if sort is None:
        return rows.orderBy("distance", "embedding_id")
    by = F.col(sort)
    order = {(True, "first"): by.desc_nulls_first, (True, "last"): by.desc_nulls_last, (False, "first"): by.asc_nulls_first, (False, "last"): by.asc_nulls_last}[(descending, nulls)]
    return rows.orderBy(order(), "document_id")


def compare_models(embeddings: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str = "id") -> DataFrame:
    """The k nearest rows of each (provider, model) to its own query vector (provider, model, vector), in one job."""
    far = embeddings.join(F.broadcast(queries), ["provider", "model"]).withColumn("distance", l2_distance(F.col("embedding"), F.col("vector")))
    nth = F.row_number().over(Window.partitionBy("provider", "model").orderBy("distance", id_col))
    return far.withColumn("position", nth).filter(F.col("position") <= k).select("provider", "model", id_col, "distance", "position")


def overlap_at_k(results: DataFrame, *, id_col: str = "id") -> DataFrame:
    """Rows that two models' results share, as a share of the larger result."""
    a = results.select(F.concat_ws("/", "provider", "model").alias("left_model"), id_col)
    b = results.select(F.concat_ws("/", "provider", "model").alias("right_model"), id_col)
    size = a.groupBy("left_model").agg(F.count(F.lit(1)).alias("n"))
    both = a.join(b, id_col).filter("left_model < right_model").groupBy("left_model", "right_model").agg(F.count(F.lit(1)).alias("shared"))
    return both.join(size, "left_model").join(size.select(F.col("left_model").alias("right_model"), F.col("n").alias("m")), "right_model").select("left_model", "right_model", "shared", (F.col("shared") / F.greatest("n", "m")).alias("overlap"))
