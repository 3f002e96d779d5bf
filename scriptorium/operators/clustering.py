"""Clusters of vectors and the digests made from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.durable import checkpoint
from scriptorium.functions.text import unfence
from scriptorium.operators.fulltext import tokens

MOST_CLUSTERS, CHUNKS_PER_CLUSTER, ROUNDS = 7, 3, 50


def choose_k(n: int) -> int:
    """One cluster for three chunks, seven at most."""
    return max(1, min(MOST_CLUSTERS, n // CHUNKS_PER_CLUSTER))


def _vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def farthest_first(points: DataFrame, k: int, first_id: int, *, id_col: str = "id", vector_col: str = "embedding") -> list[list[float]]:
    """k seeds: the given point, then always the one whose nearest seed is farthest by cosine, ties by least id."""
    seeds = [list(points.filter(F.col(id_col) == first_id).select(vector_col).first()[0])]
    chosen = [first_id]
    kind = dict(points.dtypes)[id_col]

    def farthest(c: np.ndarray, taken: list):
        norm = np.linalg.norm(c, axis=1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: tuple | None = None
            for batch in batches:
                ids = batch.column(0).to_pylist()
                x = np.array(batch.column(1).to_pylist(), np.float64).reshape(len(ids), -1)
                sizes = np.linalg.norm(x, axis=1)[:, None] * norm
                far = (1 - np.where(sizes == 0, 0.0, (x @ c.T) / np.where(sizes == 0, 1, sizes))).min(axis=1)
                # Equal up to rounding counts as equal, so ties go to the least id.
                far = np.where([i in taken for i in ids], -9.0, far.round(9))
                at = min(np.flatnonzero(far == far.max()).tolist(), key=ids.__getitem__)
                own = (float(far[at]), ids[at], x[at].tolist())
                if own[0] > -9 and (best is None or own[0] > best[0] or own[0] == best[0] and own[1] < best[1]):
                    best = own
            if best:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(best, (pa.float64(), None, pa.list_(pa.float64())), strict=True)], ["far", "id", "v"])

        return run

    while len(seeds) < k:
        # A task sends its one best row.
        found = points.select(id_col, vector_col).mapInArrow(farthest(np.array(seeds, np.float64), chosen), f"far double, id {kind}, v array<double>").collect()
        best = min(found, key=lambda r: (-r["far"], r["id"]))
        chosen.append(best["id"])
        seeds.append(best["v"])
    return seeds


def assign(points: DataFrame, centroids: list[list[float]], *, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """``id_col``, ``cluster`` and ``similarity``: the centroid of greatest cosine, ties by number."""
    c = np.array(centroids, np.float64)
    norm = np.linalg.norm(c, axis=1)
    kind = dict(points.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 4096):
                part = batch.slice(k, 4096)
                x = np.array(part.column(1).to_pylist(), np.float64).reshape(len(part), -1)
                sizes = np.linalg.norm(x, axis=1)[:, None] * norm
                cosine = np.where(sizes == 0, 0.0, (x @ c.T) / np.where(sizes == 0, 1, sizes))
                at = cosine.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(at.astype(np.int32)), pa.array(cosine[np.arange(len(part)), at])], [id_col, "cluster", "similarity"])

    return points.select(id_col, vector_col).mapInArrow(run, f"{id_col} {kind}, cluster int, similarity double")


def _means(points: DataFrame, centroids: list[list[float]], vector_col: str) -> tuple[dict[int, np.ndarray], tuple]:
    """Mean vector of each centroid's points, and a mark of the assignment. A task sends one row a cluster."""
    c = np.array(centroids, np.float64)
    norm = np.linalg.norm(c, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, mark = np.zeros_like(c), np.zeros(len(c), np.int64), np.zeros(len(c), np.uint64)
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(len(batch), -1)
            sizes = np.linalg.norm(x, axis=1)[:, None] * norm
            at = np.where(sizes == 0, 0.0, (x @ c.T) / np.where(sizes == 0, 1, sizes)).argmax(axis=1)
            np.add.at(total, at, x)
            n += np.bincount(at, minlength=len(c))
            with np.errstate(over="ignore"):
                np.add.at(mark, at, batch.column(0).to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(c)), pa.int32()), pa.array(n), pa.array(mark.view(np.int64)), pa.array(total.tolist(), pa.list_(pa.float64()))], ["cluster", "n", "mark", "total"])

    rows = points.select(F.xxhash64("id").alias("h"), vector_col).mapInArrow(run, "cluster int, n long, mark long, total array<double>").collect()
    sums: dict[int, np.ndarray] = {}
    n: dict[int, int] = {}
    mark: dict[int, int] = {}
    for r in rows:
        sums[r["cluster"]] = sums.get(r["cluster"], 0) + np.array(r["total"])
        n[r["cluster"]] = n.get(r["cluster"], 0) + r["n"]
        mark[r["cluster"]] = (mark.get(r["cluster"], 0) + r["mark"]) % 2**64
    return {k: sums[k] / n[k] for k in sums if n[k]}, tuple(sorted((k, n[k], mark[k]) for k in n))


def kmeans(points: DataFrame, k: int, first_id: int, *, vector_col: str = "embedding", rounds: int = ROUNDS) -> DataFrame:
    """Clusters of rows (id, vector) by cosine: farthest-first seeds, plain means, until no row moves.

    With k rows or fewer each row is its own cluster, in order of id. The driver
    holds k centroids; a task sends k sums, whatever the number of rows.
    """
    points = checkpoint(points.select("id", vector_col))
    few = points.limit(k + 1).count()
    if few <= k:
        return points.select("id", (F.row_number().over(Window.orderBy("id")) - 1).alias("cluster"), F.lit(1.0).alias("similarity"))
    centroids = farthest_first(points, k, first_id, vector_col=vector_col)
    seen = None
    for _ in range(rounds):
        means, now = _means(points, centroids, vector_col)
        if now == seen:
            break
        seen = now
        last, centroids = centroids, [means.get(i, np.array(c)).tolist() for i, c in enumerate(centroids)]
    else:
        # Stopped by the number of rounds: the last assignment was to these.
        return assign(points, last, vector_col=vector_col)
    return assign(points, centroids, vector_col=vector_col)


def cluster_members(assigned: DataFrame) -> DataFrame:
    """Number of members and least member of each cluster; ``assigned`` itself has the members, a row each."""
    return assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_chunks"), F.min("id").alias("first_id"))


def sample_prompts(chunks: DataFrame, *, per_cluster: int = 10, size: int = 500) -> DataFrame:
    """Text of the first chunks of each cluster (cluster, ord, title, chunk_text) for a topic request."""
    nth = F.row_number().over(Window.partitionBy("cluster").orderBy("ord"))
    line = F.concat(F.lit("["), F.coalesce("title", F.lit("")), F.lit("] "), F.substring("chunk_text", 1, size))
    rows = chunks.withColumn("_nth", nth).filter(F.col("_nth") <= per_cluster).select("cluster", F.struct("_nth", line.alias("line")).alias("x"))
    return rows.groupBy("cluster").agg(F.array_join(F.sort_array(F.collect_list("x")).getField("line"), "\n---\n").alias("prompt"))


def flat_prompt(chunks: DataFrame, *, most: int = 100, size: int = 300) -> DataFrame:
    """One text of the first chunks (ord, title, chunk_text), numbered from 0."""
    rows = chunks.orderBy("ord").limit(most)
    return rows.agg(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("title", F.lit("")).alias("title"), F.substring("chunk_text", 1, size).alias("t")))).alias("x")).select(
        F.array_join(F.transform("x", lambda c, i: F.concat(F.lit("["), i.cast("string"), F.lit("] ("), c["title"], F.lit(") "), c["t"])), "\n").alias("prompt")
    )


def topic_terms(chunks: DataFrame, *, most: int = 5, least_length: int = 4, text_col: str = "chunk_text") -> DataFrame:
    """Label terms of each cluster by TF-IDF over clusters, best first, ties by term."""
    terms = chunks.select("cluster", F.explode(tokens(F.col(text_col))).alias("term")).filter(F.length("term") >= least_length)
    tf = terms.groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = chunks.agg(F.count_distinct("cluster").alias("n"))
    rated = tf.join(df, "term").crossJoin(F.broadcast(n)).withColumn("weight", F.round(F.col("tf") * F.log((1 + F.col("n")) / F.col("df")), 6))
    nth = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("weight"), "term"))
    best = rated.withColumn("nth", nth).filter(F.col("nth") <= most)
    return best.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("nth", "term"))).getField("term").alias("terms"))


def extracts(assigned: DataFrame, chunks: DataFrame, most: int = 3) -> DataFrame:
    """The chunks nearest to their centroid, as the summary of a cluster."""
    nth = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("similarity"), "id"))
    near = assigned.withColumn("nth", nth).filter(F.col("nth") <= most).join(chunks.select("id", "chunk_text"), "id")
    return near.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("nth", "chunk_text"))).getField("chunk_text").alias("key_points"))


REPLY = "clusters array<struct<topic_name: string, summary: string, chunk_indices: array<int>, key_points: array<string>>>"


def map_external_clusters(replies: DataFrame, chunks: DataFrame) -> DataFrame:
    """Members of the clusters in a reply (request_id, content); chunks: (request_id, ord from 0, id).

    Indices beyond the chunks are dropped, negative ones count from the end; a reply
    that does not parse gives one cluster with everything.
    """
    data = F.from_json(unfence(F.col("content")), REPLY)
    parsed = replies.select("request_id", data["clusters"].alias("clusters"))
    n = chunks.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))
    good = parsed.filter("clusters is not null").join(n, "request_id").select("request_id", "n", F.posexplode("clusters").alias("topic_index", "c"))
    wanted = good.select("request_id", "topic_index", F.coalesce("c.topic_name", F.concat(F.lit("Thema "), (F.col("topic_index") + 1).cast("string"))).alias("topic_name"), "n", F.explode("c.chunk_indices").alias("i"))
    wanted = wanted.withColumn("ord", F.when(F.col("i") < 0, F.col("n") + F.col("i")).otherwise(F.col("i")))
    members = wanted.join(chunks, ["request_id", "ord"]).select("request_id", "topic_index", "topic_name", "id")
    broken = parsed.filter("clusters is null").join(chunks, "request_id").select("request_id", F.lit(0).alias("topic_index"), F.lit("Alle Inhalte").alias("topic_name"), "id")
    return members.unionByName(broken)


def topic_overview(topics: DataFrame) -> DataFrame:
    """One text of all topics (topic_index, topic_name, n_chunks, summary, key_points)."""
    bullets = F.array_join(F.transform("key_points", lambda p: F.concat(F.lit("- "), p)), "\n")
    part = F.concat_ws("\n", F.concat(F.lit("**"), "topic_name", F.lit("** ("), F.col("n_chunks").cast("string"), F.lit(" Chunks)")), F.nullif("summary", F.lit("")), F.nullif(bullets, F.lit("")))
    return topics.agg(F.array_join(F.sort_array(F.collect_list(F.struct("topic_index", part.alias("part")))).getField("part"), "\n\n").alias("overview"))


def digest_overview(topics: DataFrame) -> DataFrame:
    """``title``, ``summary`` and ``highlights`` of a digest without a written reply: no title, the topics' summaries, and the first key point of each topic."""
    own = topics.agg(F.sort_array(F.collect_list(F.struct("topic_index", "summary", F.get("key_points", F.lit(0)).alias("point")))).alias("t"))
    said = lambda name: F.filter(F.col(f"t.{name}"), lambda x: x.isNotNull() & (x != ""))
    return own.select(F.lit(None).cast("string").alias("title"), F.nullif(F.array_join(said("summary"), "\n"), F.lit("")).alias("summary"), said("point").alias("highlights"))


def compile_digest(topics: DataFrame, selected: DataFrame, first: str, last: str, *, strategy: str = "semantic_kmeans", overview: DataFrame | None = None) -> DataFrame:
    """The digest row: topics and highlights as JSON with counters; without chunks an empty digest.

    overview: one row (title, summary, highlights), as a reply gives it; without one, that of ``digest_overview``.
    """
    body = topics.agg(F.coalesce(F.to_json(F.sort_array(F.collect_list(F.struct("topic_index", "topic_name", "n_chunks", "summary", "key_points")))), F.lit("[]")).alias("topics_json"), F.count(F.lit(1)).alias("n_topics"))
    said = (digest_overview(topics) if overview is None else overview).select("title", F.col("summary").alias("summary_text"), F.when(F.size("highlights") > 0, F.to_json("highlights")).alias("highlights_json"))
    counts = selected.agg(F.count(F.lit(1)).alias("chunks_analyzed"), F.count_distinct("document_id").alias("documents_analyzed"))
    named = F.concat(F.lit("Digest "), F.lit(first).cast("date").cast("string"), F.lit(" bis "), F.lit(last).cast("date").cast("string"))
    # Both sides are one row.
    return counts.crossJoin(F.broadcast(body)).crossJoin(F.broadcast(said)).select(named.alias("name"), "title", F.lit(strategy).alias("strategy"), "summary_text", "topics_json", "highlights_json", "n_topics", "chunks_analyzed", "documents_analyzed")


def digest_topics(topics: DataFrame, members: DataFrame, digest_id: int) -> DataFrame:
    """A digest's topics as rows of its topic table, with the ids of their chunks (members: topic_index, id), which a digest bounds."""
    own = members.groupBy("topic_index").agg(F.sort_array(F.collect_list("id")).alias("chunk_ids"))
    return topics.join(own, "topic_index", "left").select(F.lit(digest_id).cast("long").alias("digest_id"), "topic_index", "topic_name", "summary", F.coalesce("chunk_ids", F.array().cast("array<bigint>")).alias("chunk_ids"), "key_points")


def digest_citations(members: DataFrame, chunks: DataFrame, digest_id: int) -> DataFrame:
    """A citation for each chunk of a topic (topic_index, id)."""
    own = members.join(chunks.select("id", "document_id", F.substring("chunk_text", 1, 200).alias("excerpt")), "id")
    return own.select(F.lit(digest_id).cast("long").alias("digest_id"), F.col("topic_index").cast("long").alias("topic_id"), "document_id", F.col("id").alias("chunk_id"), "excerpt")
