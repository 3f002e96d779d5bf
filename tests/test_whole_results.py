"""Registered queries without SQL, against plain Python over the whole tables of the smallest size."""

import json
import re
import statistics

import numpy as np
import pytest

import __spark_entry__ as entry
from scriptorium.functions import html
from scriptorium.operators import chunking, clustering, embedding
from scriptorium.plans import queries, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [r.asDict() for r in tables.documents(spark, SF).collect()]


def run(spark, name):
    return entry.queries()[name](spark, SF).collect()


def chunks_of(text, title):
    return [(k, chunk) for k, chunk, *_ in chunking.chunk_text(text, title)]


def test_l01_chunks_of_every_document(spark, documents):
    got = sorted((r.document_id, r.chunk_index, r.chunk_text, r.char_start, r.char_end, r.token_count) for r in run(spark, "l01_chunk_documents"))
    assert got == sorted((d["id"], *c) for d in documents for c in chunking.chunk_text(d["fulltext"], d["title"])) and got


def test_l04_report(spark, documents):
    lengths = [len(c) for d in documents for _, c in chunks_of(d["fulltext"], d["title"])]
    (row,) = run(spark, "l04_chunk_report")
    assert (row.chunk_size, row.chunk_overlap, row.min_chunk_size, row.n_chunks, row.longest) == (800, 160, 100, len(lengths), max(lengths))
    assert row.median == statistics.median_low(lengths)


def test_k04_chunk_stream(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((r.document_id, r.chunk_index, r.chunk_text) for r in run(spark, "k04_chunk_stream"))
    assert got == sorted((r.doc_id, k, c) for r in rows for k, c in chunks_of(r.text, ""))


def test_h11_chunks_after_the_migration(spark):
    old = tables.chunks(spark, SF).collect()
    texts = {r.page_id: html._best(r.html) for r in tables.pages(spark, SF).collect() if r.html.startswith("<")}
    texts = {k: v for k, v in texts.items() if v is not None}
    want = [(r.document_id, r.chunk_index, r.chunk_text) for r in old if r.document_id not in texts] + [(i, k, c) for i, text in texts.items() for k, c in chunks_of(text, "")]
    assert sorted((r.document_id, r.chunk_index, r.chunk_text) for r in run(spark, "h11_clean_html_chunks")) == sorted(want) and texts


def test_l06_vectors_of_documents(spark, documents):
    embed = embedding.hashing_embedder()
    got = {r.document_id: r for r in run(spark, "l06_embed_documents")}
    assert got.keys() == {d["id"] for d in documents}
    for d in documents:
        head = [d["title"] or "", f"by {d['author']}" if d["author"] else "", d["summary"] or "", d["fulltext"] or ""]
        text = "\n\n".join(x for x in head if x)
        if len(text) <= 20_000:
            norm = sum(np.float32(x).astype(float) * float(np.float32(x)) for x in embed([text])[0])
            assert got[d["id"]].dimensions == 64 and got[d["id"]].tokens == len(text) // 4 and abs(got[d["id"]].norm - norm) < 2e-3


def test_j03_clusters(spark):
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    x = np.array([v for _, v in rows], float)
    centres = [x[0]]
    while len(centres) < 7:
        centres.append(x[np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0).argmax()])
    got = {r.id: r.cluster for r in run(spark, "j03_kmeans")}
    assert got.keys() == {i for i, _ in rows}
    # Whatever the seeds: no row is nearer to the mean of another cluster.
    found = np.array([got[i] for i, _ in rows])
    means = np.array([x[found == c].mean(axis=0) for c in range(found.max() + 1)])
    assert (((x[:, None] - means[None]) ** 2).sum(axis=2).argmin(axis=1) == found).mean() > 0.97


def test_j09_digest_and_its_parts(spark):
    done = entry.plans.jobs.digest(tables.chunks(spark, SF), tables.documents(spark, SF), tables.embeddings(spark, SF), queries.FIRST, queries.LAST)
    selected, topics, (row,) = done["selected"].collect(), done["topics"].collect(), done["digest"].collect()
    assert row == run(spark, "j09_digest")[0]
    assert row.name == "Digest 2024-01-10 bis 2024-02-10" and row.chunks_analyzed == len(selected) and row.documents_analyzed == len({r.document_id for r in selected})
    body = json.loads(row.topics_json)
    assert [b["topic_index"] for b in body] == list(range(row.n_topics)) and sum(b["n_chunks"] for b in body) == len(selected)
    texts = {r.id: r.chunk_text for r in selected}
    cluster = {r.id: r.cluster for r in done["assigned"].collect()}
    for topic in topics:
        own = [texts[i] for i, c in cluster.items() if c == topic.topic_index]
        assert topic.n_chunks == len(own) and all(any(p in text for text in own) for p in topic.key_points)
        words = {w for text in own for w in re.findall(r"\w+", text.lower())}
        assert topic.topic_name.startswith("Thema ") or len(topic.topic_name.split(", ")) <= 5 and words
    assert json.loads(row.highlights_json) == [t.key_points[0] for t in sorted(topics, key=lambda t: t.topic_index) if t.key_points] and row.title is None
    assert row.summary_text == "\n".join(t.summary for t in sorted(topics, key=lambda t: t.topic_index) if t.summary)


def test_a_reply_gives_title_and_highlights(spark):
    topics = spark.createDataFrame([], "topic_index int, topic_name string, n_chunks long, summary string, key_points array<string>")
    none = spark.createDataFrame([], "id long, document_id long")
    reply = spark.createDataFrame([("T", "S", ["ä", 'b "c"'])], "title string, summary string, highlights array<string>")
    row = clustering.compile_digest(topics, none, "2024-01-02", "2024-02-03", overview=reply).first()
    assert (row.name, row.title, row.summary_text, json.loads(row.highlights_json), row.topics_json) == ("Digest 2024-01-02 bis 2024-02-03", "T", "S", ["ä", 'b "c"'], "[]")
    assert clustering.compile_digest(topics, none, "2024-01-02", "2024-02-03").first().highlights_json is None
