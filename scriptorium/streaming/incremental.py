"""Streams of landed files: ingest, chunking, index and deduplication with checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from scriptorium.functions.text import text_hash, url_host
from scriptorium.operators import chunking, fulltext, maintenance
from scriptorium.sources import feeds
from scriptorium.streaming.snapshots import KeyedSnapshot, Snapshot

#: Where state of streams with typed state must be kept: (setting, value).
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def changed_since(items: DataFrame, mark: str | None, *, at_col: str = "updated_at") -> DataFrame:
    """Items after a high-water mark; without a valid mark all. The mark of a run is its start time."""
    since = F.try_to_timestamp(F.lit(mark)) if mark else F.lit(None).cast("timestamp")
    return items.filter(since.isNull() | (F.col(at_col) > since))


def read_mark(spark: SparkSession, path: str, name: str) -> str | None:
    """The latest mark of a job in the table at ``path``; None before its first run."""
    jvm = spark._jvm.org.apache.hadoop.fs
    place = jvm.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    own = spark.read.schema("name string, mark string, at timestamp").parquet(path).filter(F.col("name") == name)
    # Of marks of one time the greatest counts, numbers as numbers.
    return own.agg(F.max_by("mark", F.struct("at", F.expr("try_cast(mark AS bigint)"), "mark"))).first()[0]


def save_mark(spark: SparkSession, path: str, name: str, mark: str, *, at: str) -> None:
    """Appends a job's mark: the start of the run that has just ended, or the last id it took."""
    row = spark.range(1).select(F.lit(name).alias("name"), F.lit(mark).alias("mark"), F.lit(at).cast("timestamp").alias("at"))
    row.coalesce(1).write.mode("append").parquet(path)


def _start(stream: DataFrame, checkpoint: str, take: Callable[[DataFrame, int], None], available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ingest_articles(stream: DataFrame, table: Snapshot, checkpoint: str, *, now: str, available_now: bool = True) -> StreamingQuery:
    """Articles (with ``seq``) into the document table."""
    return _start(stream, checkpoint, lambda df, i: table.take(i, df, lambda old, new: maintenance.upsert_articles(old, new, now=now)[0].select(*old.columns)), available_now)


def ingest_highlights(stream: DataFrame, table: Snapshot | KeyedSnapshot, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Highlights (with ``seq``) into the highlight table (by ``document_id``)."""
    return _start(stream, checkpoint, lambda df, i: table.take(i, df, lambda old, new: maintenance.upsert_highlights(old, new).select(*old.columns)), available_now)


def distinct_highlights(stream: DataFrame, *, at_col: str = "created_at", delay: str = "7 days") -> DataFrame:
    """The first arrival of each text of a document within the watermark."""
    return stream.withColumn("text_hash", text_hash(F.col("text"))).withWatermark(at_col, delay).dropDuplicatesWithinWatermark(["document_id", "text_hash"])


def chunk_stream(stream: DataFrame, **options) -> DataFrame:
    """Chunks of arriving documents; stateless."""
    return chunking.chunk_documents(stream, **options)


def refresh_index(stream: DataFrame, table: KeyedSnapshot, checkpoint: str, fields: list[str], *, id_col: str = "id", available_now: bool = True) -> StreamingQuery:
    """Postings of arriving documents into the index (by ``doc_id``), in place of those that they had."""
    make = lambda new: fulltext.build_postings(new, fields, id_col=id_col)
    return _start(stream, checkpoint, lambda df, i: table.replace(i, df, make, batch_key=id_col), available_now)


def embed_stream(stream: DataFrame, table: str, checkpoint: str, embed: Callable[[DataFrame], DataFrame], *, available_now: bool = True) -> StreamingQuery:
    """Vectors of arriving chunks, each micro-batch in a folder of its own under ``table``.

    What is done is known by the stream's checkpoint, so nothing is sorted, scanned or embedded again; a
    batch that failed comes again with the same rows and overwrites what it left. The size of a
    batch is the stream's (``maxFilesPerTrigger`` or ``maxBytesPerTrigger``).
    """
    return _start(stream, checkpoint, lambda df, i: embed(df).write.mode("overwrite").parquet(f"{table}/batch={i}"), available_now)


def split_stream(stream: DataFrame, rules: dict[str, Column], good: str, bad: str, counts: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Items that pass all rules into ``good``, the others with the first rule they break into ``bad``, and how many went where into ``counts``.

    One pass makes the mark of each item; each sink commits a folder for each batch, so a batch that
    comes again after a failure between the sinks fills none twice.
    """

    def take(df: DataFrame, i: int) -> None:
        marked = feeds.mark_invalid(df, rules).persist()
        seen = Observation()
        marked.filter("reason is null").drop("reason").write.mode("overwrite").parquet(f"{good}/batch={i}")
        marked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count("reason").alias("rejected")).filter("reason is not null").write.mode("overwrite").parquet(f"{bad}/batch={i}")
        row = df.sparkSession.range(1).select(*[F.lit(seen.get[n]).cast("long").alias(n) for n in ("rows", "rejected")])
        row.coalesce(1).write.mode("overwrite").parquet(f"{counts}/batch={i}")
        marked.unpersist()

    return _start(stream, checkpoint, take, available_now)


def daily_usage(stream: DataFrame, *, delay: str = "1 day") -> DataFrame:
    """Usage per day and provider (an extension: the batch statistics by event time)."""
    return stream.withWatermark("timestamp", delay).groupBy(F.window("timestamp", "1 day").alias("day"), "provider").agg(F.count(F.lit(1)).alias("calls"), F.sum("cost_usd").alias("cost_usd"))


class _Streak(StatefulProcessor):
    """Failure streak of a host, forgotten ``idle_ms`` after its last outcome (event time)."""

    def __init__(self, base: float, factor: float, most: float, idle_ms: int | None):
        self.base, self.factor, self.most, self.idle_ms = base, factor, most, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.streak = handle.getValueState("streak", "streak long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
        before = self.streak.get()[0] if self.streak.exists() else 0
        success, failed = frame["success"].to_numpy(bool), (~frame["success"] & frame["retriable"]).to_numpy(bool)
        total = np.cumsum(failed)
        # Failures since the last success; before the first one the streak so far counts too.
        at = np.maximum.accumulate(np.where(success, np.arange(len(frame)), -1))
        streak = np.where(at < 0, before + total, total - total[np.maximum(at, 0)])
        self.streak.update((int(streak[-1]),))
        if self.idle_ms is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            last = int(frame["at"].max().timestamp() * 1000)
            self.handle.registerTimer(max(last + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"seq": frame["seq"].to_numpy(), "domain": key[0], "streak": streak, "delay": np.minimum(self.base * self.factor**streak.astype(float), self.most)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.streak.clear()
        yield pd.DataFrame({"seq": pd.Series(dtype="int64"), "domain": pd.Series(dtype=str), "streak": pd.Series(dtype="int64"), "delay": pd.Series(dtype=float)})

    def close(self) -> None:
        pass


def domain_delay_stream(outcomes: DataFrame, *, base: float = 2.0, factor: float = 1.5, most: float = 10.0, at_col: str | None = None, idle: timedelta = timedelta(days=1)) -> DataFrame:
    """Delay of each host as outcomes (seq, url, success, retriable) arrive in the order of ``seq``; the state is the streak.

    With ``at_col`` (event time, under a watermark) a host that is idle for ``idle`` is forgotten. The session must keep
    state in RocksDB (``ROCKSDB``), as typed state needs.
    """
    at = F.col(at_col) if at_col else F.lit(None).cast("timestamp")
    rows = outcomes.withColumn("domain", url_host(F.col("url"))).select("domain", "seq", "success", "retriable", at.alias(at_col or "at") if at_col else at.alias("at"))
    rows = rows if not at_col or at_col == "at" else rows.withColumnRenamed(at_col, "at")
    step = _Streak(base, factor, most, int(idle.total_seconds() * 1000) if at_col else None)
    return rows.groupBy("domain").transformWithStateInPandas(step, "seq long, domain string, streak long, delay double", "Append", "EventTime" if at_col else "None")
