import numpy as np
from pyspark.sql import functions as F

from scriptorium.operators import knn, vector_index
from scriptorium.plans import queries

SF = "/root/testdata/sf0.01"


def rows(frame, key="vec_id"):
    return sorted((r.query_id, r.position, r[key], round(r.distance, 9)) for r in frame.collect())


def test_exact_search_equals_all_pairs_also_without_clusters(spark, tmp_path):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = queries._asked(spark, SF)
    index = vector_index.write_index(vectors, str(tmp_path / "v"), id_col="vec_id", block=16)
    assert rows(index.search(asked, 7, probes=3, exact=True)) == rows(knn.nearest_many(vectors, asked, 7, id_col="vec_id"))


def test_recall_and_share_of_pairs_on_clusters(spark, tmp_path):
    vectors = queries._clustered(spark, SF)
    asked = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    index = vector_index.write_index(vectors, str(tmp_path / "v"), id_col="vec_id")
    probes = max(1, len(index.cell) // 15)
    recall = knn.recall(knn.nearest_many(vectors, asked, 10, id_col="vec_id"), index.search(asked, 10, probes=probes), id_col="vec_id", query_col="query_id").first()[0]
    share = index.pairs_read(asked, probes=probes).first()["share"]
    print(f"recall {recall:.3f}, share of pairs {share:.3f}")
    assert recall >= 0.9 and share <= 0.1
    plan = index.blocks.select("cell", "codes").filter("part = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "vectors" not in plan.split("ReadSchema")[1]


def test_ties_few_rows_nulls_and_no_rows(spark, tmp_path):
    vectors = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(9, 0, -1)] + [(20, [5.0, 5.0]), (21, None)], "id long, embedding array<double>")
    asked = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [5.0, 5.1])], "query_id string, vector array<double>")
    index = vector_index.write_index(vectors, str(tmp_path / "v"), cells=3, block=2)
    for k in (3, 50):
        assert rows(index.search(asked, k, probes=1, exact=True), "id") == rows(knn.nearest_many(vectors, asked, k), "id")
    assert [r.id for r in index.search(asked, 3, probes=3).filter("query_id = 'a'").orderBy("position").collect()] == [1, 2, 3]
    none = vector_index.write_index(vectors.filter("id > 20"), str(tmp_path / "none"))
    assert none.search(asked, 3).count() == 0


def test_every_row_is_stored_once_in_the_cell_of_its_nearest_centre(spark, tmp_path):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(300, 4))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, embedding array<double>")
    index = vector_index.write_index(vectors, str(tmp_path / "v"), cells=12, block=10)
    stored = {i: r.cell for r in index.blocks.select("cell", "ids").collect() for i in r.ids}
    near = ((data[:, None] - index.centre[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert stored == {i: int(index.cell[c]) for i, c in enumerate(near)} and index.blocks.agg(F.max(F.size("ids"))).first()[0] < 40
