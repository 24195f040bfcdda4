"""Ingest and progress over deliveries that come again, in other batches and after restarts."""

from brieflake.streaming import ingest as ST

TEXT = " ".join(f"word{i}" for i in range(60))


def deliver(spark, folder, name, ids):
    rows = [(i, f"{TEXT} {i}", "en", "s", 1) for i in ids]
    spark.createDataFrame(rows, ST.SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, tmp_path):
    q = ST.ingest(spark, str(tmp_path / "in" / "*"), str(tmp_path / "out"), str(tmp_path / "ck"), 1)
    assert q.awaitTermination(120)


def test_documents_delivered_again_count_once(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        folder = tmp_path / "in"
        deliver(spark, folder, "a", [1, 2, 3])
        deliver(spark, folder, "b", [2, 3, 4, 4])
        run(spark, tmp_path)
        deliver(spark, folder, "c", [1, 4, 5])
        run(spark, tmp_path)  # a restart
        run(spark, tmp_path)  # nothing new
        got = [r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).select("doc_id").collect()]
        assert sorted(got) == [1, 2, 3, 4, 5]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_progress_by_term(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        folder, schema = str(tmp_path / "in"), "term int, number int, done boolean"
        first, then = [(2020, 1, False), (2020, 2, False), (2021, 7, True)], [(2020, 2, False), (2021, 3, None), (2022, 1, None), (2020, 9, False)]
        for k, rows in enumerate((first, then)):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{k}")
            q = ST.follow_terms(spark.readStream.schema(schema).parquet(f"{folder}/*"), str(tmp_path / "out"), str(tmp_path / "ck"))
            assert q.awaitTermination(120)
        want = {(2020, 9, False), (2021, 7, True), (2022, 1, False)}
        assert {tuple(r) for r in ST.latest_progress(spark, str(tmp_path / "out")).collect()} == want
        assert {tuple(r) for r in ST.term_progress(spark.createDataFrame(first + then + first, schema)).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
