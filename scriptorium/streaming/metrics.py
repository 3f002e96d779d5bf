"""Counters of a run, taken while it runs, as rows of the event table (job_id, phase, type, payload, at).

Batch writes and streams are watched by ``observe``, which counts the rows as they pass: no
second scan, no count afterwards. ``landed`` reads the counters back as columns.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from scriptorium.sources.schemas import JOB_EVENTS


def _append(spark: SparkSession, rows: list[tuple], path: str) -> None:
    frame = spark.createDataFrame(rows, JOB_EVENTS.replace("at timestamp", "at string"))
    frame.withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(path)


def write_observed(df: DataFrame, counters: dict[str, Column], write: Callable[[DataFrame], None], *, job_id: str, phase: str, path: str, at: str) -> dict:
    """Runs ``write`` on the rows and appends their counters (aggregates) to the events at ``path``; returns them."""
    seen = Observation(f"{job_id}-{phase}")
    write(df.observe(seen, *[c.alias(name) for name, c in counters.items()]))
    _append(df.sparkSession, [(job_id, phase, "observed", json.dumps(seen.get, default=str), at)], path)
    return seen.get


class RunLog(StreamingQueryListener):
    """Appends the progress of each micro-batch of every watched stream to the events at ``path``.

    Counters are those that the stream observes (``stream.observe(name, ...)``), rows and milliseconds.
    They are written ``every`` batches and when a stream ends, never in the way of its batches. Batches of a
    restarted stream keep their numbers, so a batch that came again is known by its job and phase.
    """

    def __init__(self, spark: SparkSession, path: str, *, every: int = 20):
        self.spark, self.path, self.every = spark, path, every
        self._rows: list[tuple] = []
        self._lock = threading.Lock()
        self._ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._ended.setdefault(str(event.runId), threading.Event())

    def onQueryProgress(self, event) -> None:
        p = event.progress
        observed = {name: row.asDict() for name, row in (p.observedMetrics or {}).items()}
        payload = {"rows": p.numInputRows, "ms": (p.durationMs or {}).get("triggerExecution", 0), "observed": observed}
        with self._lock:
            self._rows.append((p.name or str(p.id), f"batch {p.batchId}", "observed", json.dumps(payload, default=str), p.timestamp))
            full = len(self._rows) >= self.every
        if full:
            self.flush()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.flush()
        with self._lock:
            self._ended.setdefault(str(event.runId), threading.Event()).set()

    def flush(self) -> None:
        with self._lock:
            rows, self._rows = self._rows, []
        if rows:
            _append(self.spark, rows, self.path)

    def wait(self, run_id: str, seconds: float = 60) -> bool:
        """Waits until the events of a stream that has ended are written."""
        with self._lock:
            ended = self._ended.setdefault(str(run_id), threading.Event())
        return ended.wait(seconds)


def landed(events: DataFrame, name: str, counters: list[str]) -> DataFrame:
    """``job_id``, ``phase``, ``rows``, ``ms`` and the counters that a stream observed as ``name``; the last of a batch that came again."""
    value = lambda *keys: F.get_json_object("payload", "$." + ".".join(keys)).cast("long")
    rows = events.filter("type = 'observed'").groupBy("job_id", "phase").agg(F.max_by("payload", "at").alias("payload"))
    return rows.select("job_id", "phase", value("rows").alias("rows"), value("ms").alias("ms"), *[F.coalesce(value("observed", name, c), F.lit(0)).alias(c) for c in counters])
