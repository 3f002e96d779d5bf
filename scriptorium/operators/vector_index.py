"""A stored inverted file of vectors: cells around centroids, residuals as bytes, exact search by bounds.

``write_index`` fits centroids by k-means in Spark (twice the root of the rows as many cells, on a
sample of at most ``FIT_PER_CELL`` rows a cell by hash of the id; tasks send sums of their cells only) and
stores every row in the cell of its nearest centroid:

    blocks       a row for each block of a cell: ids, residuals as signed bytes, vectors; sorted by cell,
                 partitioned by ranges of cells, so a search reads the codes of its cells and the vectors of its candidates
    centroids    centre, radius (distance of its farthest row), step of the residual codes, rows

``Index.search`` looks into the ``probes`` nearest cells of each query, ranks by codes and rates the
best ``REFINE * k`` by their vectors. With ``exact`` it rates vectors and then also looks into every other
cell whose distance less its radius is within the distance found for rank k: no neighbour is lost,
whatever the data; where they have clusters few cells remain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.durable import checkpoint
from scriptorium.operators.knn import _matrix, _ranked

#: Rows a cell that k-means is fitted on, at most.
FIT_PER_CELL = 64
#: Candidates by codes for each of the k neighbours.
REFINE = 4
#: Folders of cells.
PARTS = 64
ROW_GROUP = 4 << 20
#: Distances of equal rows may differ in the last places.
SLACK = 1e-9


def _near(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances less what all centroids share, rows by centroids."""
    return (centroids**2).sum(axis=1) - 2 * x @ centroids.T


def _vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return rows.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))


def fit_centroids(rows: DataFrame, cells: int, *, rounds: int = 5) -> np.ndarray:
    """Centroids of (id, vector) by k-means from ``cells`` rows chosen by hash; a cell that loses its rows keeps its place."""
    n = rows.count()
    share = min(1.0, FIT_PER_CELL * cells / max(n, 1))
    mark = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    fit = checkpoint(rows.filter(mark <= int(share * (1 << 20))).select("vector", F.xxhash64("id", F.lit(1)).alias("_order")))
    centroids = np.array([r.vector for r in fit.orderBy("_order").limit(cells).collect()], np.float64)
    for _ in range(rounds if len(centroids) else 0):

        def sums(batches: Iterator[pa.RecordBatch], centroids=centroids) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
            for batch in batches:
                x = _matrix(batch.column(0))
                for k in range(0, len(x), 4096):
                    part = x[k : k + 4096]
                    cell = _near(part, centroids).argmin(axis=1)
                    np.add.at(total, cell, part)
                    count += np.bincount(cell, minlength=len(centroids))
            own = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(count[own]), pa.array(list(total[own]), pa.list_(pa.float64()))], ["cell", "n", "total"])

        parts = fit.select("vector").mapInArrow(sums, "cell int, n long, total array<double>").select("cell", "n", F.posexplode("total").alias("d", "x"))
        summed = parts.groupBy("cell", "d").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        means = summed.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("d", (F.col("x") / F.col("n")).alias("x")))).alias("m")).select("cell", F.col("m.x").alias("mean"))
        centroids = centroids.copy()
        for r in means.collect():
            centroids[r.cell] = r["mean"]
    return centroids


def _assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, vector) with ``cell``, ``far`` (distance to its centre) and ``spread`` (largest residual)."""
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 4096):
                part = batch.slice(k, 4096)
                x = _matrix(part.column(1))
                cell = _near(x, centroids).argmin(axis=1)
                rest = x - centroids[cell]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(np.sqrt((rest**2).sum(axis=1))), pa.array(np.abs(rest).max(axis=1))], ["id", "vector", "cell", "far", "spread"])

    return rows.mapInArrow(run, f"id {kind}, vector array<double>, cell int, far double, spread double")


def write_index(vectors: DataFrame, path: str, *, id_col: str = "id", vector_col: str = "embedding", cells: int | None = None, block: int = 4096) -> Index:
    """Writes the index of all rows that have a vector; distinct ids, vectors of one length."""
    rows = _vectors(vectors, id_col, vector_col)
    n = rows.count()
    cells = cells or max(1, round(2 * n**0.5))
    centroids = fit_centroids(rows, cells)
    spark = vectors.sparkSession
    own = checkpoint(_assigned(rows, centroids))
    seen = {r.cell: r for r in own.groupBy("cell").agg(F.max("far").alias("radius"), F.max("spread").alias("spread"), F.count(F.lit(1)).alias("n")).collect()}  # a row a cell
    step = np.array([(seen[c]["spread"] if c in seen else 0.0) / 127 or 1.0 for c in range(len(centroids))])
    # A full cell is many blocks, dealt by hash, so no group grows with its cell.
    blocks_of = {c: max(1, -(-r["n"] // block)) for c, r in seen.items()}
    wide = {c: k for c, k in blocks_of.items() if k > 1}
    parts = F.lit(1) if not wide else F.coalesce(F.get(F.array(*[F.lit(wide.get(c, 1)) for c in range(len(centroids))]), F.col("cell")), F.lit(1))
    packed = own.withColumn("block", F.pmod(F.xxhash64("id"), parts).cast("int")).groupBy("cell", "block").agg(F.sort_array(F.collect_list(F.struct("id", "vector"))).alias("x"))
    packed = packed.select((F.col("cell") * PARTS / F.lit(max(1, len(centroids)))).cast("int").alias("part"), "cell", "block", F.col("x.id").alias("ids"), F.col("x.vector").alias("vectors"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                one = batch.slice(k, 1)
                cell = one.column(1)[0].as_py()
                rest = _matrix(one.column(4)[0].values) - centroids[cell]
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([np.rint(rest / step[cell]).astype(np.int8).tobytes()])], [*one.schema.names, "codes"])

    kind = dict(rows.dtypes)["id"]
    coded = packed.mapInArrow(code, f"part int, cell int, block int, ids array<{kind}>, vectors array<array<double>>, codes binary")
    coded.repartitionByRange("cell", "block").sortWithinPartitions("part", "cell").write.mode("overwrite").partitionBy("part").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/blocks")
    about = [(c, centroids[c].tolist(), float(seen[c]["radius"]), float(step[c]), int(seen[c]["n"])) for c in range(len(centroids)) if c in seen]
    spark.createDataFrame(about, "cell int, centre array<double>, radius double, step double, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    return Index(spark, path, id_col=id_col)


class Index:
    """An inverted file in a folder, opened for searching."""

    def __init__(self, spark: SparkSession, path: str, *, id_col: str = "id"):
        self.spark, self.path, self.id_col = spark, path, id_col
        own = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
        self.cell = np.array([r.cell for r in own], np.int32)
        self.centre = np.array([r.centre for r in own], np.float64)
        self.radius, self.step, self.size = (np.array([r[c] for r in own]) for c in ("radius", "step", "n"))
        self.blocks = spark.read.parquet(f"{path}/blocks") if own else None

    def _asking(self, queries: DataFrame, choose, kind: str) -> DataFrame:
        """(cell, asked: query_id, vector, reach): queries by the cells that ``choose`` (distances of a query to all centres, reach) names; ``reach`` is NULL at first."""
        centre, cell = self.centre, self.cell

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, len(batch), 1024):
                    part = batch.slice(k, 1024)
                    x = _matrix(part.column(1))
                    far = np.sqrt(np.maximum(_near(x, centre) + (x**2).sum(axis=1)[:, None], 0))
                    row, at = np.nonzero(choose(far, np.asarray(part.column(2).to_numpy(zero_copy_only=False), np.float64)))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(cell[at])], ["query_id", "vector", "cell"])

        return queries.select("query_id", "vector", "reach").mapInArrow(run, f"query_id {kind}, vector array<double>, cell int")

    def _found(self, asking: DataFrame, k: int, kind: str, *, by_codes: bool, query_block: int = 1024) -> DataFrame:
        """Candidates (query_id, cell, block, at, id, distance): the best of each block and query."""
        centre, step, place = self.centre, self.step, {int(c): i for i, c in enumerate(self.cell)}
        grouped = asking.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(64)).cast("int"))
        # Queries of a cell go in bundles: a cell near to a third of all queries is many.
        grouped = grouped.groupBy("cell", "part").agg(F.collect_list(F.struct("query_id", "vector")).alias("q")).select("cell", F.col("q.query_id").alias("query_ids"), F.col("q.vector").alias("query_vectors"))
        rows = self.blocks.select("cell", "block", "ids", "codes" if by_codes else "vectors")
        pairs = rows.join(grouped, "cell").select("cell", "block", "ids", "codes" if by_codes else "vectors", "query_ids", "query_vectors")
        id_kind = self.blocks.schema["ids"].dataType.elementType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for one in range(len(batch)):
                    cell, block = batch.column(0)[one].as_py(), batch.column(1)[one].as_py()
                    ids, asked = batch.column(2)[one].values, batch.column(4)[one].values
                    q = _matrix(batch.column(5)[one].values)
                    if by_codes:
                        at = place[cell]
                        x = np.frombuffer(batch.column(3)[one].as_py(), np.int8).reshape(len(ids), -1) * step[at] + centre[at]
                    else:
                        x = _matrix(batch.column(3)[one].values)
                    most = min(k, len(x))
                    for low in range(0, len(q), query_block):
                        part = q[low : low + query_block]
                        query, row, far = [], [], []
                        for i, v in enumerate(part):
                            d = x - v
                            d = np.sqrt(np.einsum("ij,ij->i", d, d)).round(12)
                            # Ties at rank k stay, for they are told apart by id among all blocks.
                            some = np.flatnonzero(d <= np.partition(d, most - 1)[most - 1])
                            some = some[np.lexsort((some, d[some]))][:most]  # ids stand in order
                            query.append(np.full(len(some), low + i))
                            row.append(some)
                            far.append(d[some])
                        query, row = np.concatenate(query), np.concatenate(row)
                        n = len(row)
                        yield pa.RecordBatch.from_arrays([asked.take(pa.array(query)), pa.array(np.full(n, cell, np.int32)), pa.array(np.full(n, block, np.int32)), pa.array(row.astype(np.int32)), ids.take(pa.array(row)), pa.array(np.concatenate(far))], ["query_id", "cell", "block", "at", "id", "distance"])

        return pairs.mapInArrow(run, f"query_id {kind}, cell int, block int, at int, id {id_kind}, distance double")

    def _refined(self, found: DataFrame, queries: DataFrame) -> DataFrame:
        """Candidates with the distances of their vectors."""
        rows = self.blocks.select("cell", "block", F.posexplode("vectors").alias("at", "x"))
        both = found.drop("distance").join(rows, ["cell", "block", "at"]).join(queries.select("query_id", F.col("vector").cast("array<double>").alias("v")), "query_id")
        square = F.aggregate(F.zip_with("x", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
        return both.select("query_id", "id", F.round(F.sqrt(square), 12).alias("distance"))

    def search(self, queries: DataFrame, k: int = 10, *, probes: int = 8, exact: bool = False) -> DataFrame:
        """``query_id``, the id, ``distance`` and ``position`` of the k nearest (or, not ``exact``, near) rows of each query (distinct query_id, vector)."""
        kind = dict(queries.dtypes)["query_id"]
        asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), F.lit(None).cast("double").alias("reach"))
        if self.blocks is None:
            return queries.filter("false").select("query_id", F.lit(None).cast("long").alias(self.id_col), F.lit(0.0).alias("distance"), F.lit(0).alias("position"))
        most = min(probes, len(self.cell))
        first = lambda far, reach: far <= np.partition(far, most - 1, axis=1)[:, most - 1 : most]
        if not exact:
            found = _ranked(self._found(self._asking(asked, first, kind), REFINE * k, kind, by_codes=True), REFINE * k, "id").drop("position")
            return _ranked(self._refined(found, queries), k, self.id_col)
        near = checkpoint(_ranked(self._found(self._asking(asked, first, kind), k, kind, by_codes=False), k, "id").select("query_id", "id", "distance", "position"))
        reach = near.filter(F.col("position") == k).select("query_id", F.col("distance").alias("reach"))
        radius = self.radius
        # Where fewer than k rows were found every other cell is looked into.
        others = lambda far, reach: ~first(far, reach) & (far - radius <= np.where(np.isnan(reach), np.inf, reach)[:, None] + SLACK)
        rest = self._found(self._asking(asked.drop("reach").join(reach, "query_id", "left"), others, kind), k, kind, by_codes=False)
        return _ranked(near.select("query_id", "id", "distance").unionByName(rest.select("query_id", "id", "distance")), k, self.id_col)

    def pairs_read(self, queries: DataFrame, *, probes: int = 8) -> DataFrame:
        """One row: pairs of a query and a row in its probed cells, and their share of all pairs."""
        kind = dict(queries.dtypes)["query_id"]
        asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), F.lit(None).cast("double").alias("reach"))
        most = min(probes, len(self.cell))
        asking = self._asking(asked, lambda far, reach: far <= np.partition(far, most - 1, axis=1)[:, most - 1 : most], kind)
        size = self.spark.read.parquet(f"{self.path}/centroids").select("cell", "n")
        total = int(self.size.sum())
        own = asking.join(size, "cell").agg(F.sum("n").alias("pairs"))
        return own.crossJoin(queries.agg((F.count(F.lit(1)) * total).alias("every"))).select("pairs", (F.col("pairs") / F.col("every")).alias("share"))
