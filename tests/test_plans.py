"""Plans that have to stay as they are to hold at scale."""

from pyspark.sql import functions as F

from weftline.operators import filters, lineage, review, runs
from weftline.operators.cells import notebook_cells
from weftline.operators.graph import merge_edges, roots, table_edges
from weftline.operators.lineage import workspace_refs
from weftline.plans import corpora
from weftline.sources import logs, notebooks

SF = "/root/testdata/sf0.001"
BOOK = "path string, language string, source string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored_books(spark, tmp_path):
    rows = [(f"/W/t{i % 3}/n{i}", "python", f'spark.table("m.s.t{i}")') for i in range(20)]
    path = str(tmp_path / "books")
    spark.createDataFrame(rows, BOOK).withColumn("owner", F.lit("x")).write.parquet(path)
    return spark.read.parquet(path)


def test_text_is_never_shuffled(spark, tmp_path):
    books = stored_books(spark, tmp_path)
    for df in (
        notebook_cells(books),
        lineage.all_refs(notebook_cells(books)),
        workspace_refs(books),
        lineage.column_refs(lineage.sql_statements(notebook_cells(books))),
        review.review(notebook_cells(books)),
        notebooks.to_ipynb(books),
    ):
        plan = plan_of(df)
        assert "Exchange" not in plan and "EvalPython" not in plan and "InPandas" not in plan
        assert "owner" not in plan.split("ReadSchema")[-1]


def test_filters_reach_the_files(spark, tmp_path):
    books = stored_books(spark, tmp_path)
    plan = plan_of(notebook_cells(filters.scope(books, "/W/t1")))
    assert "StringStartsWith(path,/W/t1)" in plan


def test_only_references_are_shuffled_for_edges(spark, tmp_path):
    books = stored_books(spark, tmp_path)
    edges = merge_edges(table_edges(lineage.all_refs(notebook_cells(books)).select("path", "fqn", "reference_type")))
    plan = plan_of(edges)
    assert plan.count("Exchange hashpartitioning") == 1 and "source" not in plan.split("Exchange hashpartitioning")[0]


def test_no_nested_loops(spark, small_graph):
    nodes, edges = small_graph
    objects = corpora.workspace_objects(spark, SF)
    closed = objects.where("path like '%sub'").select("path")
    records = corpora.run_records(spark, SF)
    for df in (
        filters.list_notebooks(objects, "/Workspace", 3, closed),
        roots(nodes, edges),
        runs.task_errors(logs.load_task_runs(records), corpora.run_outputs(spark, SF)),
        lineage.pipeline_refs(corpora.pipeline_notebooks(spark, SF), corpora.pipeline_holders(spark, SF)),
    ):
        plan = plan_of(df)
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_groups_are_reduced_before_the_shuffle(spark):
    records = logs.load_runs(corpora.run_records(spark, SF))
    plan = plan_of(runs.latest_runs(records))
    assert "partial_max_by" in plan.split("Exchange")[1]
    events = corpora.pipeline_event_records(corpora.table(spark, SF, "events"))
    assert "WindowGroupLimit" in plan_of(runs.pipeline_events(events)).split("Exchange")[1]
