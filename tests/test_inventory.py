import base64

import pytest
from pyspark.sql import functions as F

from weftline.functions.names import fqn, resolve_name, split_fqn
from weftline.operators import filters, inventory
from weftline.sources import files, reports, volumes


def test_names(spark):
    df = spark.createDataFrame([("t",), ("s.t",), ("c.s.t",), ("a.b.c.d",), ("/x",), ("",), (None,)], "n string")
    parts = df.select("n", split_fqn("n").alias("p"), resolve_name("n", F.lit("C"), F.lit("S")).alias("r")).collect()
    by_name = {r.n: (tuple(r.p) if r.p else None, r.r) for r in parts}
    assert by_name["t"] == ((None, None, "t"), "C.S.t")
    assert by_name["s.t"] == ((None, "s", "t"), "C.s.t")
    assert by_name["c.s.t"] == (("c", "s", "t"), "c.s.t")
    assert by_name["a.b.c.d"][0] is None and by_name["/x"][0] is None and by_name[""][0] is None
    composed = spark.createDataFrame([("", None, "t"), ("c", "", "t")], "c string, s string, t string")
    assert [r[0] for r in composed.select(fqn("c", "s", "t")).collect()] == ["t", "c.t"]


def test_filters(spark):
    df = spark.createDataFrame([("Prod_1",), ("dev%",), (None,)], "name string")
    assert filters.name_filter(df, "name").count() == 3
    assert [r.name for r in filters.name_filter(df, "name", "PROD").collect()] == ["Prod_1"]
    assert [r.name for r in filters.name_filter(df, "name", "%").collect()] == ["dev%"]
    paths = spark.createDataFrame([("/a/b",), ("/a/bc",), ("/x",)], "path string")
    assert filters.scope(paths, "/a/b").count() == 2 and filters.scope(paths, "").count() == 3


def test_listing(spark):
    rows = [
        ("/", "DIRECTORY", None), ("/n0", "NOTEBOOK", "PYTHON"), ("/d", "DIRECTORY", None), ("/d/n1", "NOTEBOOK", None),
        ("/d/e", "REPO", None), ("/d/e/n2", "NOTEBOOK", "SQL"), ("/d/f", "FILE", None), ("/x", "LIBRARY", None), ("/x/n3", "NOTEBOOK", "R"),
        ("/dd", "DIRECTORY", None), ("/dd/n4", "NOTEBOOK", "R"),
    ]
    objects = spark.createDataFrame(rows, "path string, object_type string, language string")

    def names(root="/", depth=10, closed=None):
        hidden = spark.createDataFrame([(c,) for c in closed], "path string") if closed else None
        return sorted(r.name for r in filters.list_notebooks(objects, root, depth, hidden).collect())

    assert names() == ["n0", "n1", "n2", "n4"]
    assert names(depth=0) == ["n0"] and names(depth=1) == ["n0", "n1", "n4"]
    assert names("/d") == ["n1", "n2"] and names("/d", 0) == ["n1"]
    assert names(closed=["/d/e"]) == ["n0", "n1", "n4"] and names(closed=["/d"]) == ["n0", "n4"]
    assert names("/d", closed=["/d"]) == []
    assert filters.list_notebooks(objects, "/d").where("name = 'n1'").first().language == ""


def test_defaults_by_type(spark):
    rows = [("0", 0, False), ("", None, None), ("false", 2, True), (None, 5, None)]
    df = spark.createDataFrame(rows, "t string, n int, b boolean")
    filled = filters.with_defaults(df, {"t": "none", "n": 1, "b": True})
    assert [tuple(r) for r in filled.collect()] == [("0", 1, True), ("none", 1, True), ("false", 2, True), ("none", 5, True)]


def test_inventories(spark):
    clusters = spark.createDataFrame(
        [("1", "Main", None, None, "15", "n", None, None, None), ("2", None, "RUNNING", "me", "15", "n", "d", 30, 0)],
        "cluster_id string, cluster_name string, state string, creator_user_name string, spark_version string, "
        "node_type_id string, driver_node_type_id string, autotermination_minutes int, num_workers int",
    )
    listed = {r.cluster_id: r for r in inventory.inventory("cluster", clusters).collect()}
    assert (listed["1"].state, listed["1"].creator_user_name, listed["1"].driver_node_type_id) == ("UNKNOWN", "", "n")
    assert (listed["1"].autotermination_minutes, listed["1"].num_workers) == (0, None)
    assert (listed["2"].cluster_name, listed["2"].driver_node_type_id, listed["2"].num_workers) == ("", "d", 0)
    assert [r.cluster_id for r in inventory.inventory("cluster", clusters, "main").collect()] == ["1"]
    warehouses = spark.createDataFrame(
        [("w", "W", None, None, None, None, 0, None, None)],
        "id string, name string, state string, cluster_size string, warehouse_type string, creator_name string, "
        "num_clusters int, auto_stop_mins int, enable_serverless_compute boolean",
    )
    assert tuple(inventory.inventory("warehouse", warehouses).first()) == ("w", "W", "UNKNOWN", "", "", "", 1, 0, False)


def test_statistics_and_profile(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "a.parquet"))
    spark.range(7).withColumn("x", F.lit("y")).coalesce(1).write.parquet(str(tmp_path / "b.parquet"))
    spark.range(0).write.parquet(str(tmp_path / "none.parquet"))
    name = F.regexp_extract("file_path", r"([^/]+)\.parquet/", 1)
    statistics = inventory.file_statistics(spark, str(tmp_path), name)
    found = {r.table: (r.num_records, r.size_bytes) for r in statistics.collect()}
    assert found["a"][0] == 1000 and found["b"][0] == 7
    sizes = sum(f.stat().st_size for f in (tmp_path / "b.parquet").glob("*.parquet"))
    assert found["b"][1] == sizes
    tables = spark.createDataFrame(
        [
            ("a", "MANAGED", {"spark.sql.statistics.numRows": "5"}),
            ("b", "MATERIALIZED_VIEW", {"spark.sql.statistics.numRows": "9", "spark.sql.statistics.totalSize": "many"}),
            ("c", None, {"spark.sql.statistics.totalSize": "11"}),
            ("d", "view", None),
        ],
        "full_name string, table_type string, properties map<string,string>",
    )
    profile = inventory.table_profile(tables, statistics.withColumnRenamed("table", "full_name"))
    rows = {r.full_name: (r.row_count, r.size_bytes) for r in profile.collect()}
    assert rows["a"][0] == 1000 and rows["b"] == (9, None) and rows["c"] == (None, 11) and rows["d"] == (None, None)


def test_columns(spark):
    df = spark.createDataFrame([(1, [1.0])], "id int not null comment 'key', xs array<double>")
    rows = inventory.column_inventory(spark, {"t": df.schema}, {"t": ["id"]}).orderBy("position").collect()
    assert [tuple(r) for r in rows] == [("t", 0, "id", "int", False, "key", True), ("t", 1, "xs", "array<double>", True, None, False)]


def test_table_info(spark):
    schema = spark.createDataFrame([], "b int, a string").schema
    columns = inventory.column_inventory(spark, {"m.s.t": schema})
    profile = spark.createDataFrame([("m.s.t", 5), ("m.s.u", 6)], "full_name string, row_count bigint")
    found = {r.full_name: r for r in inventory.table_info(profile, columns).collect()}
    assert [c.name for c in found["m.s.t"].columns] == ["b", "a"] and found["m.s.u"].columns is None


def test_sql(spark):
    spark.range(1500).createOrReplaceTempView("numbers")
    full = inventory.run_sql(spark, "SELECT id FROM numbers WHERE id < 3 ORDER BY id")
    assert (full.rows, full.truncated, full.total_row_count) == ([{"id": "0"}, {"id": "1"}, {"id": "2"}], False, None)
    cut = inventory.run_sql(spark, "SELECT id, cast(null AS int) n FROM numbers")
    assert (cut.row_count, cut.truncated, cut.total_row_count, cut.columns) == (1000, True, 1500, ["id", "n"])
    exact = inventory.run_sql(spark, "SELECT * FROM numbers", limit=1500)
    assert (exact.row_count, exact.truncated) == (1500, False)
    for bad in ("SELEC 1", "SELECT * FROM no_such_table"):
        failed = inventory.run_sql(spark, bad)
        assert failed.error and failed.rows == []


def test_files(spark, tmp_path):
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    (tmp_path / "a.txt").write_text("héllo")
    (tmp_path / "sub" / "b.bin").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "sub" / "deep" / "c.txt").write_text("x" * 100)
    listed = {(r.name, r.is_directory, r.file_size) for r in files.list_files(spark, str(tmp_path)).collect()}
    assert listed == {("a.txt", False, 6), ("sub", True, None)}
    deep = {r.path.replace(str(tmp_path), "") for r in files.list_files(spark, str(tmp_path), recursive=True).collect()}
    assert deep == {"/a.txt", "/sub", "/sub/b.bin", "/sub/deep", "/sub/deep/c.txt"}
    read = {r.path.rsplit("/", 1)[1]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert (read["a.txt"].encoding, read["a.txt"].content, read["a.txt"].truncated) == ("utf-8", "héllo", False)
    assert read["b.bin"].content == base64.b64encode(b"\xff\xfe\x00").decode()
    # Two bytes end inside the é, so what is left is no text.
    cut = {r.path.rsplit("/", 1)[1]: r for r in files.read_files(spark, str(tmp_path), 2).collect()}
    assert (cut["a.txt"].encoding, cut["a.txt"].content, cut["a.txt"].truncated) == ("base64", base64.b64encode(b"h\xc3").decode(), True)
    assert (cut["c.txt"].encoding, cut["c.txt"].content, cut["c.txt"].content_length) == ("utf-8", "xx", 2)


def test_long_binary_is_one_base64_line(spark):
    df = spark.createDataFrame([("p", bytearray(b"\xff" * 500))], "path string, content binary")
    assert files.file_contents(df).first().content == base64.b64encode(b"\xff" * 500).decode()


def test_report_json(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 1.5)], "k string, n string, x double")
    assert reports.to_report_json(df).first().json == '{"k":"a","n":null,"x":1.5}'
    assert tuple(reports.to_report_json(df, "k").first()) == ("a", '{"k":"a","n":null,"x":1.5}')
    reports.write_reports(df, str(tmp_path / "r"))
    assert (spark.read.text(str(tmp_path / "r")).first().value) == '{"k":"a","n":null,"x":1.5}'


def test_work_folder_needs_a_shared_place(spark, monkeypatch):
    from weftline import session

    class Cluster:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Remote:
        sparkContext = Cluster()

        class conf:
            @staticmethod
            def get(key, default):
                return None

    with pytest.raises(RuntimeError):
        session.work_folder(Remote(), "x")
    monkeypatch.setattr(Remote.conf, "get", staticmethod(lambda key, default: "hdfs://shared/"))
    assert session.work_folder(Remote(), "x").startswith("hdfs://shared/x-")


def test_a_listing_shows_empty_folders_and_cuts_only_the_root(spark, tmp_path):
    root = tmp_path / "R"
    (root / "a" / "R").mkdir(parents=True)
    (root / "empty").mkdir()
    (root / "a" / "R" / "f.txt").write_text("x")
    (root / "g.txt").write_text("yy")
    own = files.list_files(spark, str(root)).collect()
    assert {(r.name, r.is_directory, r.file_size) for r in own} == {
        ("a", True, None), ("empty", True, None), ("g.txt", False, 2)
    }
    below = files.list_files(spark, str(root), recursive=True).collect()
    assert {(r.path.removeprefix(str(root)), r.is_directory) for r in below} == {
        ("/a", True), ("/a/R", True), ("/a/R/f.txt", False), ("/g.txt", False)
    }


def test_first_bytes_of_a_file_beyond_two_gib(spark, tmp_path):
    (tmp_path / "d").mkdir()
    with open(tmp_path / "d" / "huge.bin", "wb") as file:
        file.write(b"first bytes")
        file.truncate(5 << 30)  # a hole, which takes no disk
    (tmp_path / "d" / "small.txt").write_text("x")
    (tmp_path / "gone").symlink_to(tmp_path / "nowhere")
    read = {r.path.rsplit("/", 1)[1]: r for r in files.read_files(spark, str(tmp_path), 11).collect()}
    assert (read["huge.bin"].content, read["huge.bin"].truncated, read["huge.bin"].error) == ("first bytes", True, None)
    assert (read["small.txt"].content, read["small.txt"].truncated) == ("x", False)
    assert read["gone"].content is None and "nowhere" in read["gone"].error or "No such file" in read["gone"].error
    below = {r.path.rsplit("/", 1)[1]: r.file_size for r in files.list_files(spark, str(tmp_path / "d")).collect()}
    assert below == {"huge.bin": 5 << 30, "small.txt": 1}
    missing = files.list_files(spark, str(tmp_path / "not there")).collect()
    assert len(missing) == 1 and "No such file" in missing[0].error


def test_tasks_share_a_flat_folder(spark, tmp_path):
    names = [f"f{i}.txt" for i in range(500)]
    for name in names:
        (tmp_path / name).write_text(name)
    found = volumes.volume_files(spark, str(tmp_path), 3, slots=7)
    assert found.rdd.getNumPartitions() == 7
    assert {(r.path, bytes(r.content)) for r in found.collect()} == {(f"{tmp_path}/{n}", n[:3].encode()) for n in names}


def test_counts_come_from_footers(spark, tmp_path):
    for n in (0, 10, 1000):
        spark.range(n).repartition(3).write.parquet(str(tmp_path / f"t{n}"))
    places = {f"t{n}": str(tmp_path / f"t{n}") for n in (0, 10, 1000)}
    found = inventory.footer_statistics(spark, places)
    assert {r.table: r.num_records for r in found.collect()} == {"t0": 0, "t10": 10, "t1000": 1000}
    assert found.where("size_bytes > 0").count() == 3
    plan = inventory.footer_counts(spark, places)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedAggregation: [COUNT(*)]") >= 3
