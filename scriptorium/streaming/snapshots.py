"""Tables that micro-batches rewrite: as a whole, or only the parts that a batch touches.

Both kinds are folders that any file system of Spark's can hold. A batch that is taken in
again changes nothing, and what a failed batch left behind is overwritten when it comes again.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.durable import FREED_SHUFFLES, SMALL_BATCHES, settings

Change = Callable[[DataFrame, DataFrame], DataFrame]
#: Keys of a batch up to this number are broadcast to find their stored rows.
BROADCAST_KEYS = 2_000_000


class _Folder:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *names: str) -> list[str]:
        fs, path = self._fs(), self._path(*names)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


class Snapshot(_Folder):
    """A table kept as whole versions, of which the last ``keep`` stay."""

    def __init__(self, spark: SparkSession, root: str, schema: str, *, keep: int = 2):
        super().__init__(spark, root)
        self.schema, self.keep = schema, keep

    def versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in self._names() if self._fs().exists(self._path(n, "_SUCCESS")))

    def read(self) -> DataFrame:
        versions = self.versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/v{versions[-1]}") if versions else self.spark.createDataFrame([], self.schema)

    def take(self, batch_id: int, batch: DataFrame, change: Change) -> None:
        """Writes the version of a batch, ``change(table, batch)``, unless it or a later one is there."""
        versions = self.versions()
        if versions and batch_id <= versions[-1]:
            return
        change(self.read(), batch).write.mode("overwrite").parquet(f"{self.root}/v{batch_id}")
        for old in [*versions, batch_id][: -self.keep]:
            self._fs().delete(self._path(f"v{old}"), True)


class KeyedSnapshot(_Folder):
    """A table dealt into ``parts`` by hash of ``key``; a batch rewrites the parts of its keys and leaves the files of the others.

    ``manifests/<batch>.json`` names for each part the batches whose folders hold its rows. It is
    written beside and renamed, which is the commit: readers see the table before or after a
    batch. Files that none of the last ``keep`` manifests names are deleted.

    ``take``: ``change(rows, batch)`` gets the stored rows of the touched parts and returns them anew; rows of
    one key always share a part. ``replace``: what is made of a batch's rows takes the place of all rows of their keys; it is
    laid beside what a part holds, of which only folders that hold one of these keys are written anew. Once a part has ``LAYERS``
    folders they become one. A large part is written as several files. ``parts`` is fixed when the
    table is made, by the size that a part may have.
    """

    #: Folders of a part that are read side by side.
    LAYERS = 8

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, *, parts: int = 64, keep: int = 2):
        super().__init__(spark, root)
        self.schema, self.key, self.keep = schema, key, keep
        self.parts = (self.manifest() or {"parts": parts})["parts"]

    def manifests(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json"))

    def manifest(self, batch_id: int | None = None) -> dict | None:
        own = self.manifests()
        if not own:
            return None
        lines = self.spark.read.text(f"{self.root}/manifests/{own[-1] if batch_id is None else batch_id}.json", wholetext=True).first()[0]
        found = json.loads(lines)
        return found | {"held": {p: b if isinstance(b, list) else [b] for p, b in found["held"].items()}}

    def _part(self, key: str):
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.parts)).cast("int")

    def _rows(self, held: dict[str, list[int]], spark: SparkSession | None = None) -> DataFrame:
        spark = spark or self.spark
        paths = [f"{self.root}/data/{batch}/_part={part}" for part, batches in held.items() for batch in batches]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows((self.manifest() or {"held": {}})["held"])

    def take(self, batch_id: int, batch: DataFrame, change: Change, *, batch_key: str | None = None) -> None:
        """Takes a batch in, unless it or a later one is there; ``batch_key``: its column that stands for the key."""
        last = self.manifest()
        if last and batch_id <= last["batch"]:
            return
        held = dict(last["held"]) if last else {}
        touched = {str(r[0]) for r in batch.select(self._part(batch_key or self.key)).distinct().collect()}  # no more than there are parts
        rows = change(self._rows({p: b for p, b in held.items() if p in touched}), batch)
        rows.withColumn("_part", self._part(self.key)).hint("rebalance", "_part").write.mode("overwrite").partitionBy("_part").parquet(f"{self.root}/data/{batch_id}")
        written = {n.removeprefix("_part=") for n in self._names("data", str(batch_id)) if n.startswith("_part=")}
        if not written <= touched:
            raise ValueError("the change gave rows with keys of parts that its batch does not touch")
        held = {p: b for p, b in held.items() if p not in touched} | {p: [batch_id] for p in sorted(written, key=int)}
        self._commit({"batch": batch_id, "parts": self.parts, "held": held})
        self._sweep()

    def replace(self, batch_id: int, batch: DataFrame, make: Callable[[DataFrame], DataFrame], *, batch_key: str | None = None) -> None:
        """Puts ``make(batch)`` in place of the stored rows of the batch's keys, unless it or a later one is there.

        ``make`` gives rows of the batch's keys only, without a shuffle: the batch is dealt by part before, stored rows are not.
        """
        last = self.manifest()
        if last and batch_id <= last["batch"]:
            return
        held = last["held"] if last else {}
        spark, own = batch.sparkSession, batch_key or self.key
        with settings(spark, FREED_SHUFFLES | SMALL_BATCHES):
            keys = batch.select(F.col(own).alias(self.key))
            keys = F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys
            anew = {p: b for p, b in held.items() if len(b) >= self.LAYERS}
            rest = {p: b for p, b in held.items() if p not in anew}
            if rest:  # which folders hold one of the keys; only their column of keys is read
                folder = F.regexp_extract(F.col("_metadata.file_path"), r"/data/(-?\d+/_part=\d+)/[^/]*$", 1)
                for row in self._rows(rest, spark).select(self.key, folder.alias("folder")).join(keys, self.key, "left_semi").select("folder").distinct().collect():
                    b, p = row["folder"].split("/_part=")
                    anew[p] = [*anew.get(p, []), int(b)]
            parts = lambda df, key: df.withColumn("_part", self._part(key))
            columns = self._rows({}).columns
            rows = parts(make(parts(batch, own).hint("rebalance", "_part").drop("_part")).select(*columns), self.key)
            if anew:
                rows = rows.unionByName(parts(self._rows(anew, spark).join(keys, self.key, "left_anti").select(*columns), self.key))
            rows.write.mode("overwrite").option("compression", "zstd").partitionBy("_part").parquet(f"{self.root}/data/{batch_id}")
        written = {n.removeprefix("_part=") for n in self._names("data", str(batch_id)) if n.startswith("_part=")}
        after = {p: [x for x in held.get(p, []) if x not in anew.get(p, [])] + [batch_id] * (p in written) for p in sorted({*held, *written}, key=int)}
        self._commit({"batch": batch_id, "parts": self.parts, "held": {p: b for p, b in after.items() if b}})
        self._sweep()

    def _commit(self, manifest: dict) -> None:
        fs, name = self._fs(), f"{manifest['batch']}.json"
        out = fs.create(self._path("manifests", f"_{name}"), True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(self._path("manifests", f"_{name}"), self._path("manifests", name)):
            raise RuntimeError(f"the manifest of batch {manifest['batch']} could not be put in place")

    def _sweep(self) -> None:
        own = self.manifests()
        named = {(str(b), p) for k in own[-self.keep :] for p, layers in self.manifest(k)["held"].items() for b in layers}
        fs = self._fs()
        for batch in self._names("data"):
            if int(batch) <= own[-1]:
                stored = {n.removeprefix("_part=") for n in self._names("data", batch) if n.startswith("_part=")}
                for part in stored:
                    if (batch, part) not in named:
                        fs.delete(self._path("data", batch, f"_part={part}"), True)
                if not any((batch, part) in named for part in stored):
                    fs.delete(self._path("data", batch), True)
        for k in own[: -self.keep]:
            fs.delete(self._path("manifests", f"{k}.json"), False)
