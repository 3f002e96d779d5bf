import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from scriptorium.operators import fulltext
from scriptorium.sources import schemas
from scriptorium.streaming import incremental as inc
from scriptorium.streaming import metrics
from scriptorium.streaming.snapshots import KeyedSnapshot, Snapshot

ARTICLES = "source string, provider_id string, url_original string, title string, author string, published_at timestamp, saved_at timestamp, category string, word_count long, fulltext string, fulltext_html string, fulltext_source string, summary string, raw_json string, seq long"
STORED = ARTICLES.replace(", seq long", "") + ", url_canonical string, fulltext_fetched_at timestamp"


def batches(spark, path, rows, schema, cuts):
    for k, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[i:j], schema).coalesce(1).write.mode("append").parquet(f"{path}/{k}")
        yield f"{path}/{k}"


def test_article_stream_equals_one_batch_and_restarts(spark, tmp_path):
    names = [x.split()[0] for x in ARTICLES.split(", ")]
    rows = [tuple({"source": "s", "provider_id": f"p{k % 4}", "url_original": f"u/{k % 3}", "title": f"t{k}", "seq": k}.get(n) for n in names) for k in range(9)]
    results = []
    for name, cuts in (("one", []), ("three", [3, 6])):
        src, table = str(tmp_path / name), Snapshot(spark, str(tmp_path / f"{name}-table"), STORED)
        for _ in batches(spark, f"{src}-parts", rows, ARTICLES, cuts):
            spark.read.parquet(_).write.mode("append").parquet(src)
            stream = spark.readStream.schema(ARTICLES).parquet(src)
            inc.ingest_articles(stream, table, str(tmp_path / f"{name}-cp"), now="2025-01-01 00:00:00").awaitTermination()
        versions = table.versions()
        inc.ingest_articles(spark.readStream.schema(ARTICLES).parquet(src), table, str(tmp_path / f"{name}-cp"), now="2025-01-01 00:00:00").awaitTermination()
        assert table.versions() == versions
        results.append(sorted((r.provider_id, r.url_canonical, r.title) for r in table.read().collect()))
    assert results[0] == results[1] and results[0]


def test_index_and_chunks_follow_new_files(spark, tmp_path):
    schema = "id long, title string, fulltext string"
    src = str(tmp_path / "docs")
    postings = KeyedSnapshot(spark, str(tmp_path / "postings"), "doc_id long, term string, field string, tf long, positions array<int>", "doc_id", parts=4)
    for k, word in enumerate(["alpha", "beta"]):
        spark.createDataFrame([(k, word, f"{word} " * 60)], schema).write.mode("append").parquet(src)
        inc.refresh_index(spark.readStream.schema(schema).parquet(src), postings, str(tmp_path / "cp"), ["title", "fulltext"]).awaitTermination()
        assert fulltext.search(postings.read(), [word]).count() == 1
    out = str(tmp_path / "chunks")
    query = inc.chunk_stream(spark.readStream.schema(schema).parquet(src)).writeStream.option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start(out)
    query.awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_high_water_mark(spark):
    rows = spark.createDataFrame([("2025-01-01",), ("2025-02-01",)], "d string").select(F.to_timestamp("d").alias("updated_at"))
    assert [inc.changed_since(rows, m).count() for m in ("2025-01-15T00:00:00Z", None, "nonsense")] == [1, 2, 2]


def test_marks_of_jobs(spark, tmp_path):
    path = str(tmp_path / "marks")
    assert inc.read_mark(spark, path, "embed") is None
    for mark in ("9", "16"):
        inc.save_mark(spark, path, "embed", mark, at="2024-01-01 00:00:00")
    assert inc.read_mark(spark, path, "embed") == "16" and inc.read_mark(spark, path, "other") is None


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_a_batch_rewrites_the_parts_of_its_keys_only(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "id long, text string")
    put = lambda old, new: old.join(new.select("id"), "id", "left_anti").unionByName(new)
    table = KeyedSnapshot(spark, str(tmp_path / "t"), "id long, text string", "id", parts=8)
    assert table.read().count() == 0
    table.take(0, rows(*[(k, "old") for k in range(100)]), put)
    before = files(tmp_path / "t" / "data")
    table.take(1, rows((7, "new"), (200, "added")), put)
    after = files(tmp_path / "t" / "data")
    assert len(before.items() & after.items()) == len(before) and 1 <= len(after) - len(before) <= 2
    assert {(r.id, r.text) for r in table.read().collect()} == {(k, "old") for k in range(100) if k != 7} | {(7, "new"), (200, "added")}
    table.take(1, rows((7, "twice")), put)  # a batch that comes again
    assert files(tmp_path / "t" / "data") == after and table.manifests() == [0, 1]
    # Files that only forgotten manifests name go; parts that lose all rows are empty.
    table.take(2, rows((7, "newest")), put)
    assert table.manifests() == [1, 2] and len(files(tmp_path / "t" / "data").keys() & before.keys()) < len(before)
    table.take(3, rows(*[(k, "") for k in [*range(100), 200]]), lambda old, new: old.join(new, "id", "left_anti"))
    assert table.read().count() == 0
    # The number of parts is the table's.
    assert KeyedSnapshot(spark, str(tmp_path / "t"), "id long, text string", "id", parts=99).parts == 8


def test_what_a_failed_batch_wrote_is_not_read(spark, tmp_path):
    rows = spark.createDataFrame([(k, "a") for k in range(20)], "id long, text string")
    table = KeyedSnapshot(spark, str(tmp_path / "t"), "id long, text string", "id", parts=4)
    table.take(0, rows, lambda old, new: new)
    commit, table._commit = table._commit, lambda manifest: (_ for _ in ()).throw(ConnectionError("lost"))
    with pytest.raises(ConnectionError):
        table.take(1, rows.withColumn("text", F.lit("b")), lambda old, new: new)
    assert {r.text for r in table.read().collect()} == {"a"}
    table._commit = commit
    table.take(1, rows.withColumn("text", F.lit("b")), lambda old, new: new)
    assert {r.text for r in table.read().collect()} == {"b"} and table.read().count() == 20
    with pytest.raises(ValueError):
        table.take(2, rows.limit(1), lambda old, new: rows)


def test_whole_snapshots_keep_the_last_versions(spark, tmp_path):
    table = Snapshot(spark, str(tmp_path / "t"), "id long")
    for k in range(4):
        table.take(k, spark.range(k), lambda old, new: new)
    assert table.versions() == [2, 3] and table.read().count() == 3


def test_embedding_goes_on_after_the_batch_that_failed(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.range(40).repartition(4).write.parquet(src)
    seen = []

    def embed(batch):
        seen.append(batch.count())
        if len(seen) == 3:
            raise RuntimeError("lost")
        return batch

    start = lambda: inc.embed_stream(spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(src), out, str(tmp_path / "cp"), embed)
    with pytest.raises(StreamingQueryException):
        start().awaitTermination()
    assert len(seen) == 3
    start().awaitTermination()
    assert len(seen) == 5 and sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(40))


def test_a_split_that_failed_between_its_sinks_fills_none_twice(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([(k, k if k % 3 else None) for k in range(30)], "id long, v long").coalesce(1).write.parquet(src)
    places = [str(tmp_path / x) for x in ("good", "bad", "counts")]
    (tmp_path / "bad").write_text("in the way")
    start = lambda: inc.split_stream(spark.readStream.schema("id long, v long").parquet(src), {"no value": F.col("v").isNotNull(), "large": F.col("v") < 25}, *places, str(tmp_path / "cp"))
    with pytest.raises(StreamingQueryException):
        start().awaitTermination()
    assert spark.read.parquet(places[0]).count() == 16
    (tmp_path / "bad").unlink()
    start().awaitTermination()
    good, bad, counts = (spark.read.parquet(x) for x in places)
    assert good.count() == 16 and {(r.reason, r["count"]) for r in bad.groupBy("reason").count().collect()} == {("no value", 10), ("large", 4)}
    assert [(r.rows, r.rejected) for r in counts.collect()] == [(30, 14)]


def test_counters_are_taken_while_rows_are_written(spark, tmp_path):
    events, out = str(tmp_path / "events"), str(tmp_path / "out")
    got = metrics.write_observed(spark.range(10), {"rows": F.count(F.lit(1)), "large": F.count_if(F.col("id") > 6)}, lambda df: df.write.parquet(out), job_id="j", phase="p", path=events, at="2024-01-01 00:00:00")
    assert got == {"rows": 10, "large": 3} and spark.read.parquet(out).count() == 10
    row = spark.read.parquet(events).first()
    assert (row.job_id, row.phase, row.type, row.payload) == ("j", "p", "observed", '{"rows": 10, "large": 3}')


@pytest.fixture
def typed_state(spark):
    before = spark.conf.get(inc.ROCKSDB[0])
    spark.conf.set(*inc.ROCKSDB)
    yield
    spark.conf.set(inc.ROCKSDB[0], before)


def test_domain_delay_stream(spark, tmp_path, typed_state):
    schema = "seq long, url string, success boolean, retriable boolean"
    src, rows = str(tmp_path / "s"), [(0, False, True), (1, False, True), (2, True, True), (3, False, True), (4, False, False), (5, False, True), (6, True, False), (7, True, True)]
    for part in (rows[:4], rows[4:]):
        spark.createDataFrame([(k, "https://www.e.com/", a, b) for k, a, b in part[::-1]], schema).coalesce(1).write.mode("append").parquet(src)
        inc.domain_delay_stream(spark.readStream.schema(schema).parquet(src)).writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()
    assert [(r.domain, r.streak, r.delay) for r in got] == [("e.com", s, 2.0 * 1.5**s) for s in (1, 2, 0, 1, 1, 2, 0, 0)]


def test_an_idle_host_is_forgotten(spark, tmp_path, typed_state):
    schema = "seq long, url string, success boolean, retriable boolean, at timestamp"
    src = str(tmp_path / "s")
    for rows in ([(0, "https://a.com/", "2024-01-01 00:00:00"), (1, "https://b.com/", "2024-01-01 00:00:00")], [(2, "https://b.com/", "2024-01-01 20:00:00")], [(3, "https://c.com/", "2024-01-02 10:00:00")], [(4, "https://a.com/", "2024-01-02 11:00:00"), (5, "https://b.com/", "2024-01-02 11:00:00")]):
        frame = spark.createDataFrame([(k, url, False, True, at) for k, url, at in rows], schema.replace("timestamp", "string")).withColumn("at", F.to_timestamp("at"))
        frame.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src).withWatermark("at", "1 hour")
        inc.domain_delay_stream(stream, at_col="at").writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = {r.seq: r.streak for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 1, 4: 1, 5: 3}


def test_schemas_parse(spark):
    for name in dir(schemas):
        if name.isupper():
            assert spark.createDataFrame([], getattr(schemas, name)).count() == 0


def test_replaced_keys_leave_other_folders_as_they_are(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "id long, text string").repartition(3)
    make = lambda new: new.select("id", F.explode(F.split("text", " ")).alias("text"))
    stored = lambda: sorted((r.id, r.text) for r in table.read().collect())
    table = KeyedSnapshot(spark, str(tmp_path / "t"), "id long, text string", "id", parts=2)
    table.LAYERS = 4
    table.replace(-1, rows(*[(k, "old older") for k in range(20)]), make)
    first = files(tmp_path / "t" / "data")
    table.replace(0, rows(*[(k, "new") for k in range(20, 40)]), make)
    assert first.items() <= files(tmp_path / "t" / "data").items() and {len(b) for b in table.manifest()["held"].values()} == {2}
    table.replace(0, rows((1, "twice")), make)  # a batch that comes again
    table.replace(1, rows((7, "newer words"), (50, "added")), make)
    want = sorted([(k, w) for k in range(20) if k != 7 for w in ("old", "older")] + [(k, "new") for k in range(20, 40)] + [(7, "newer"), (7, "words"), (50, "added")])
    assert stored() == want
    assert sorted(len([b for b in layers if b == -1]) for layers in table.manifest()["held"].values()) == [0, 1]
    for k in range(2, 9):  # many layers become one, and what no manifest names goes
        table.replace(k, rows((100 + k, f"t{k}"), (200 + k, "")), make)
        want += [(100 + k, f"t{k}"), (200 + k, "")]
        assert stored() == sorted(want) and max(len(b) for b in table.manifest()["held"].values()) <= 4
    table.take(9, rows((7, "taken")), lambda old, new: old.join(new.select("id"), "id", "left_anti").unionByName(new))
    assert stored() == sorted([x for x in want if x[0] != 7] + [(7, "taken")])
    assert not any(p.startswith(("-1/", "0/", "1/")) for p in files(tmp_path / "t" / "data") if "_part=" + str(table.read().filter("id = 7").select(table._part("id")).first()[0]) in p)
