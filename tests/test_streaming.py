import datetime as dt

from weftline.operators import graph
from weftline.operators.review import review
from weftline.operators.cells import notebook_cells
from weftline.sources import logs
from weftline.streaming import failures, lineage
from weftline.streaming.review import stream_review

BOOK = "path string, language string, source string, version bigint"


def book(path, table, version):
    return (path, "python", f'spark.table("m.s.{table}").write.saveAsTable("m.s.out_{table}")', version)


def read_tables(spark, store):
    return {(r.path, r.fqn) for r in lineage.current_refs(spark, store).where("reference_type = 'reads_from'").collect()}


def test_lineage_follows_versions(spark, tmp_path):
    arriving, store = str(tmp_path / "in"), str(tmp_path / "store")

    def arrive(*rows):
        spark.createDataFrame(list(rows), BOOK).coalesce(1).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(BOOK).parquet(arriving)
        lineage.stream_lineage(stream, store, str(tmp_path / "checkpoint")).awaitTermination()

    arrive(book("/a", "one", 1), book("/b", "one", 1), book("/a", "two", 2))
    assert read_tables(spark, store) == {("/a", "m.s.two"), ("/b", "m.s.one")}
    arrive(book("/a", "three", 3), ("/b", "python", "pass", 2))
    assert read_tables(spark, store) == {("/a", "m.s.three")}
    # A late, older version changes nothing.
    arrive(book("/a", "late", 1))
    assert read_tables(spark, store) == {("/a", "m.s.three")}
    nodes, edges = lineage.current_graph(spark, store)
    assert {r.id for r in nodes.collect()} == {"notebook::/a", "notebook::/b", "table::m.s.three", "table::m.s.out_three"}
    assert edges.count() == 2
    lineage.compact(spark, store, str(tmp_path / "compact"))
    assert read_tables(spark, str(tmp_path / "compact")) == {("/a", "m.s.three")}


def test_only_newer_versions_reach_the_store(spark, tmp_path):
    arriving, store = str(tmp_path / "in"), str(tmp_path / "store")
    for batch in (
        [book("/a", "one", None), book("/b", "one", 5), (None, "python", "pass", 1)],
        [book("/a", "two", None), book("/b", "old", 4)],
        [book("/a", "three", 1), book("/b", "same", 5)],
    ):
        spark.createDataFrame(batch, BOOK).coalesce(1).write.mode("append").parquet(arriving)
        query = lineage.stream_lineage(spark.readStream.schema(BOOK).parquet(arriving), store, str(tmp_path / "checkpoint"))
        query.awaitTermination()
        # The state is Spark's own; no Python runs for a notebook.
        assert "StateStoreSave" in query._jsq.explainInternal(False) and "Python" not in query._jsq.explainInternal(False)
    rows = {(r.path, r.version, r.batch_id) for r in spark.read.schema(lineage.STORE_SCHEMA).parquet(store).collect()}
    assert rows == {("/a", None, 0), ("/a", None, 1), ("/a", 1, 2), ("/b", 5, 0), ("/b", 5, 2), (None, 1, 0)}
    assert read_tables(spark, store) == {("/a", "m.s.three"), ("/b", "m.s.same")}


def test_a_batch_may_run_again(spark, tmp_path):
    store = str(tmp_path / "store")
    batch = spark.createDataFrame([book("/a", "one", 1)], BOOK)
    for _ in range(2):
        lineage.upsert_notebooks(batch, 0, store)
    assert lineage.current_refs(spark, store).count() == 2


def test_merged_store_equals_batch_lineage(spark, tmp_path):
    rows = [book(f"/n{i}", f"t{i % 3}", 1) for i in range(10)]
    given = spark.createDataFrame(rows, BOOK)
    lineage.upsert_notebooks(given, 0, str(tmp_path / "s"))
    _, streamed = lineage.current_graph(spark, str(tmp_path / "s"))
    empty = spark.createDataFrame([], "id string, node_type string, fqn string, name string, metadata map<string,string>")
    _, batch = graph.add_notebook(empty, spark.createDataFrame([], "src string, dst string, edge_type string"), given)
    assert {tuple(r) for r in streamed.collect()} == {tuple(r) for r in batch.collect()}


EVENT = "pipeline_id string, id string, event_type string, timestamp timestamp, level string, exceptions array<struct<message:string>>"


def test_failures_equal_the_batch_counts(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    texts = ["timeout", "OOM", "conflict", None]
    rows = [
        ("p", str(i), "flow", start + dt.timedelta(hours=i), "ERROR", [(texts[i % 4],)] if i % 5 else None) for i in range(100)
    ]
    arriving, store = str(tmp_path / "in"), str(tmp_path / "counts")
    for part in range(4):
        spark.createDataFrame(rows[part * 25 : part * 25 + 25], EVENT).coalesce(1).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(EVENT).parquet(arriving)
        failures.stream_failures(stream, store, str(tmp_path / "checkpoint")).awaitTermination()
    got = {tuple(r) for r in failures.current_failures(spark, store).collect()}
    want = {tuple(r) for r in failures.failure_counts(spark.createDataFrame(rows, EVENT)).collect()}
    assert got == want and sum(n for _, _, n in got) == 80


def test_events_from_json_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.json").write_text(
        '{"pipeline_id":"p","id":"1","timestamp":"2024-01-01T00:00:00Z","exceptions":[{"message":"timed out"}]}\n'
        '{"pipeline_id":"p","id":"2","timestamp":"2024-01-01T05:00:00Z","level":"INFO"}\n'
    )
    stream = logs.load_events(logs.stream_json_events(spark, str(tmp_path / "in")))
    failures.stream_failures(stream, str(tmp_path / "c"), str(tmp_path / "checkpoint")).awaitTermination()
    assert [(r.probable_cause, r.n) for r in failures.current_failures(spark, str(tmp_path / "c")).collect()] == [("timeout", 1)]


def test_stream_review_equals_batch(spark, tmp_path):
    rows = [(f"/n{i}", "python", f"x = df.collect()\nprint({i})", 1) for i in range(5)]
    books = spark.createDataFrame(rows, BOOK)
    books.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(BOOK).parquet(str(tmp_path / "in"))
    stream_review(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    pick = ["path", "rule_id", "code_snippet"]
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(pick).collect()}
    assert got == {tuple(r) for r in review(notebook_cells(books)).select(pick).collect()} and len(got) == 10


def test_streamed_rows_are_spread_before_texts_are_made(spark, tmp_path):
    """A small file is one split, but its notebooks are made and reviewed in more tasks than one."""
    from weftline.plans.queries import QUERIES

    orders = spark.range(400).selectExpr("id AS o_orderkey", "id % 20 AS o_custkey")
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    found = QUERIES["stream_review"](spark, str(tmp_path))
    assert found.count() == 300 and len(found.inputFiles()) > 1
