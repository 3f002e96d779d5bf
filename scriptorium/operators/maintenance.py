"""Table maintenance as pure functions (target, batch) -> new target.

Plain Parquet has no MERGE; a new snapshot is written beside the old one
(``sources.sinks.publish``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.durable import checkpoint
from scriptorium.functions.html import extract_text
from scriptorium.functions.text import looks_like_html, metadata_category, metadata_words, normalize_category, normalize_url, text_hash
from scriptorium.operators.chunking import chunk_documents
from scriptorium.operators.library import CLEARABLE, orphans
from scriptorium.sources.sinks import replace_chunks

#: Columns that a later article fills in but never empties.
KEPT = ("url_original", "title", "author", "published_at", "saved_at", "category", "word_count", "fulltext_html", "summary", "raw_json")
ARTICLE = ("source", "provider_id", "url_canonical", *KEPT, "fulltext", "fulltext_source", "fulltext_fetched_at")


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], *, order: list[Column] | None = None) -> DataFrame:
    """Rows of the target with those of the batch in their place; the last of several by ``order`` counts."""
    if order:
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        batch = batch.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")
    return target.join(batch.select(*keys), keys, "left_anti").unionByName(batch, allowMissingColumns=True)


def prepare_articles(batch: DataFrame) -> DataFrame:
    """Articles (with ``seq``, their order) with normalised URL and category."""
    return batch.withColumn("url_canonical", normalize_url(F.col("url_original"))).withColumn("category", normalize_category(F.col("category"), F.col("url_original")))


def components(links: DataFrame) -> DataFrame:
    """``row`` and ``entity``, the least row that links (a, b) reach, of all rows in a link.

    Labels also jump along themselves, so a chain needs as many rounds as the logarithm of its length.
    """
    both = checkpoint(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("row")).agg(F.min("b").alias("near")).select("row", F.least("row", "near").alias("entity")))
    while True:
        near = both.join(labels.withColumnRenamed("row", "b"), "b").groupBy(F.col("a").alias("row")).agg(F.min("entity").alias("near"))
        step = labels.join(near, "row").select("row", "entity", F.least("entity", "near").alias("to"))
        far = labels.select(F.col("row").alias("to"), F.col("entity").alias("far"))
        after = checkpoint(step.join(far, "to").select("row", F.least("to", "far").alias("entity"), (F.least("to", "far") < F.col("entity")).alias("moved")))
        labels = after.select("row", "entity")
        if after.filter("moved").isEmpty():
            return labels


def _entities(rows: DataFrame) -> DataFrame:
    """``row`` and ``entity`` of rows that share a URL or a provider id with others of their source. A missing key is shared with nothing."""
    keys = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in ("provider_id", "url_canonical")]
    keyed = rows.select("source", "row", F.inline(F.array(*keys))).filter("key is not null")
    # A row whose keys are its own alone stops here: only shared keys are joined.
    lead = keyed.groupBy("source", "kind", "key").agg(F.min("row").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return components(keyed.join(lead, ["source", "kind", "key"]).filter("row <> b").select(F.col("row").alias("a"), "b"))


def _merged(many: DataFrame) -> DataFrame:
    """One row an entity, as if all its rows made one document, and ``plain``: whether they do.

    They do if all have the same URL: each row then meets the one document by it, whatever its provider id. They
    also do if all have the same provider id; whether an empty text counts then depends on the URL before, so there
    must be none. Nothing but last known values by ``row`` is left to find, which aggregates before the shuffle, so an
    entity may hold any share of the rows.
    """
    texts = ("fulltext", "fulltext_source", "fulltext_fetched_at")
    same = lambda c: F.coalesce((F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1))), F.lit(False))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("row")))
    got = F.max_by(F.struct(*texts), F.when(F.col("fulltext") != "", F.col("row")))
    plain = same("url_canonical") | (same("provider_id") & (F.count_if(F.col("fulltext") == "") == 0))
    values = {**{c: last(c) for c in (*KEPT, "url_canonical")}, "provider_id": F.max_by("provider_id", "row")}
    once = many.groupBy("entity").agg(plain.alias("plain"), F.min_by(F.struct(*many.columns), "row").alias("_first"), got.alias("_texts"), *[v.alias(c) for c, v in values.items()])
    taken = {c: F.when(F.col("_texts").isNotNull(), F.col(f"_texts.{c}")).otherwise(F.col(f"_first.{c}")) for c in texts}
    return once.select("plain", *[(F.col(c) if c in values or c == "entity" else taken.get(c, F.col(f"_first.{c}"))).alias(c) for c in many.columns])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by entity and row, one after another, as the store would take them; ``rejected`` marks those that it refuses.

    Only the documents of one entity are held, however many rows made them.
    """
    texts = ("fulltext", "fulltext_source", "fulltext_fetched_at")
    entity, by_url, by_id, docs = None, {}, {}, []
    done: list[dict] = []
    schema = None
    for batch in batches:
        schema = schema or batch.schema.append(pa.field("rejected", pa.bool_()))
        for new in batch.to_pylist():
            if new["entity"] != entity:
                done += docs
                entity, by_url, by_id, docs = new["entity"], {}, {}, []
            url, key, text = new["url_canonical"], new["provider_id"], new["fulltext"]
            at_url, at_id = by_url.get(url), by_id.get(key)
            if at_url is not None and at_id is not None and at_id is not at_url:
                # Its provider id belongs to another document: the store would refuse it.
                done.append(new | {"rejected": True})
                continue
            own = at_url if at_url is not None else at_id
            if own is None:
                own = new | {"rejected": False}
                docs.append(own)
            else:
                own.update({c: new[c] for c in KEPT if new[c] is not None})
                if text is not None and (at_url is None or text != ""):
                    own.update({c: new[c] for c in texts})
                if at_url is not None and key != own["provider_id"]:
                    by_id.pop(own["provider_id"], None)
                    own["provider_id"] = key
                if url is not None and url != own["url_canonical"]:
                    by_url.pop(own["url_canonical"], None)
                    own["url_canonical"] = url
            # A missing key is no key.
            if own["url_canonical"] is not None:
                by_url[own["url_canonical"]] = own
            if own["provider_id"] is not None:
                by_id[own["provider_id"]] = own
        if len(done) >= 1000:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
            done = []
    if done or docs:
        yield pa.RecordBatch.from_pylist(done + docs, schema=schema)


def upsert_articles(target: DataFrame, batch: DataFrame, *, now: str, merge_across_sources: bool = False) -> tuple[DataFrame, DataFrame]:
    """(new target, rejects) after taking in the articles in the order of ``seq``.

    Within a source an article belongs to the document of its URL, else to that of
    its provider id; a missing URL or id is no key. Rows without a partner in the batch or target
    need no fold, and entities of one URL or one provider id are aggregated (``_merged``). Only the rows of an entity of
    several URLs and several ids are folded in their order, so by one task, which streams them.
    """
    new = prepare_articles(batch).withColumn("fulltext_fetched_at", F.when(F.col("fulltext").isNotNull(), F.lit(now).cast("timestamp")))
    # Stored rows come before new ones; nothing else depends on their numbers.
    old = target.select(*ARTICLE).withColumn("row", F.monotonically_increasing_id() - F.lit(2**62))
    rows = old.unionByName(new.select(*ARTICLE, F.col("seq").cast("long").alias("row")))
    if merge_across_sources:
        rows = rows.withColumn("_source", F.col("source")).withColumn("source", F.lit("*"))
    rows = checkpoint(rows)
    entities = _entities(rows)
    single = rows.join(entities, "row", "left_anti")
    many = rows.join(entities, "row")
    merged = checkpoint(_merged(many))
    knotted = many.join(merged.filter("not plain").select("entity"), "entity", "left_semi").select(*many.columns)
    knotted = knotted.repartition("entity").sortWithinPartitions("entity", "row")
    folded = checkpoint(knotted.mapInArrow(_fold, knotted.withColumn("rejected", F.lit(False)).schema))
    found = single.unionByName(merged.filter("plain").select(*rows.columns)).unionByName(folded.filter("not rejected").select(*rows.columns))
    refused = folded.filter("rejected").select(*rows.columns)
    if merge_across_sources:
        found, refused = (x.withColumn("source", F.col("_source")).drop("_source") for x in (found, refused))
    return found.drop("row"), refused.drop("row").withColumn("reason", F.lit("provider_id belongs to another document"))


def upsert_highlights(target: DataFrame, batch: DataFrame) -> DataFrame:
    """One row per document and normalised text: the last text, and the last known value of the other columns. batch: with ``seq``."""
    columns = [c for c in batch.columns if c not in ("seq", "document_id", "text_hash")]
    rows = batch.withColumn("text_hash", text_hash(F.col("text")))
    old = target.withColumn("seq", F.lit(-1).cast("long"))
    every = old.select("document_id", "text_hash", "seq", *columns).unionByName(rows.select("document_id", "text_hash", F.col("seq").cast("long"), *columns))
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in columns]
    return every.groupBy("document_id", "text_hash").agg(*last)


def upsert_failures(target: DataFrame, batch: DataFrame) -> DataFrame:
    """One row per document: the last error, the first URL, and how often it failed again. batch: with ``seq``."""
    changing = ["job_id", "error_type", "error_message", "http_status", "last_attempt"]
    new = batch.groupBy("document_id").agg(*[F.max_by(c, "seq").alias(c) for c in changing], F.min_by("url", "seq").alias("url"), F.count(F.lit(1)).alias("n"))
    old = target.select("document_id", F.col("url").alias("old_url"), "retry_count", *[F.col(c).alias(f"old_{c}") for c in changing])
    both = old.join(new, "document_id", "full_outer")
    fresh = F.col("n").isNotNull()
    retry = F.when(F.col("retry_count").isNull(), F.col("n") - 1).otherwise(F.col("retry_count") + F.coalesce("n", F.lit(0))).cast("int")
    return both.select("document_id", F.coalesce("old_url", "url").alias("url"), *[F.when(fresh, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in changing], retry.alias("retry_count"))


def update_fulltext(docs: DataFrame, texts: DataFrame, *, source: str, now: str) -> DataFrame:
    """Documents with fetched texts (id, text) in place."""
    rows = docs.join(texts.select("id", F.col("text").alias("_text")), "id", "left")
    got = F.col("_text").isNotNull()
    values = {"fulltext": F.coalesce("_text", "fulltext"), "fulltext_source": F.when(got, F.lit(source)).otherwise(F.col("fulltext_source")), "fulltext_fetched_at": F.when(got, F.lit(now).cast("timestamp")).otherwise(F.col("fulltext_fetched_at"))}
    return rows.withColumns(values).drop("_text")


def remove_orphans(embeddings: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(embeddings whose chunk is there or that have none, one row of counts)."""
    alive = embeddings.filter("chunk_id is not null").join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    kept = alive.unionByName(embeddings.filter("chunk_id is null"))
    return kept, orphans(embeddings, chunks).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("chunk_id").alias("chunks"))


def clear_failures(failures: DataFrame, types: tuple[str, ...] = CLEARABLE) -> tuple[DataFrame, DataFrame]:
    """(failures that stay, one row with the number cleared)."""
    again = F.col("error_type").isin(*types)
    return failures.filter(~again), failures.agg(F.count_if(again).alias("cleared"))


def apply_changes(rows: DataFrame, changes: DataFrame, columns: list[str], *, key: str = "id") -> DataFrame:
    """Rows with the columns of a change set where it has their key (soft delete, favourite, status)."""
    new = changes.select(key, F.lit(True).alias("_changed"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    own = rows.join(new, key, "left")
    return own.withColumns({c: F.when(F.col("_changed"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}).drop("_changed", *[f"_new_{c}" for c in columns])


def clean_html(docs: DataFrame, chunks: DataFrame, *, rechunk: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Moves HTML out of the text column: (documents, chunks, one row of counters)."""
    marked = docs.withColumn("_html", F.coalesce(looks_like_html(F.col("fulltext")), F.lit(False)))
    rows = checkpoint(marked.withColumn("_text", F.when(F.col("_html"), extract_text(F.col("fulltext")))))
    got = F.col("_text").isNotNull()
    cleaned = rows.withColumns({"fulltext_html": F.when(got, F.col("fulltext")).otherwise(F.col("fulltext_html")), "fulltext": F.coalesce("_text", "fulltext")}).drop("_html", "_text")
    counters = rows.agg(F.count_if("_html").alias("found"), F.count_if(got).alias("cleaned"), F.count_if(F.col("_html") & ~got).alias("failed"))
    if rechunk:
        changed = rows.filter(got).select("id", F.col("_text").alias("fulltext"), "title")
        fresh = chunk_documents(changed).withColumn("id", F.xxhash64("document_id", "chunk_index"))
        chunks = replace_chunks(chunks.join(changed.select(F.col("id").alias("document_id")), "document_id", "left_anti"), fresh.select(*[c for c in chunks.columns if c in fresh.columns]))
    return cleaned, chunks, counters


def backfill_metadata(docs: DataFrame) -> DataFrame:
    """Category and word count from the JSON metadata where they are missing."""
    return docs.withColumns({"category": metadata_category(F.col("raw_json"), F.col("category")), "word_count": metadata_words(F.col("raw_json"), F.col("word_count"))})


def audit(rows: DataFrame, *, unique: dict[str, list[str]] | None = None, checks: dict[str, Column] | None = None) -> DataFrame:
    """``rule`` and ``violations``: rows too many per unique key, and rows for which a check is false."""
    found = []
    for name, keys in (unique or {}).items():
        own = rows.dropna(subset=keys).groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("more"))
        found.append(own.agg(F.lit(name).alias("rule"), F.coalesce(F.sum("more"), F.lit(0)).alias("violations")))
    for name, check in (checks or {}).items():
        found.append(rows.agg(F.lit(name).alias("rule"), F.count_if(~check).alias("violations")))
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out


def replace_document_embeddings(embeddings: DataFrame, new: DataFrame) -> DataFrame:
    """Embeddings with those of the documents in ``new`` replaced."""
    return embeddings.join(new.select("document_id").distinct(), "document_id", "left_anti").unionByName(new, allowMissingColumns=True)
