import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from weftline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def small_graph(spark):
    """raw → etl → clean → report → agg; a job and a pipeline run etl."""
    nodes = [
        ("table", "main.bronze.raw", "raw"),
        ("table", "main.silver.clean", "clean"),
        ("table", "main.gold.agg", "agg"),
        ("notebook", "/W/etl", "etl"),
        ("notebook", "/W/report", "report"),
        ("job", "123", "ETL Job"),
        ("pipeline", "456", "Events"),
    ]
    edges = [
        ("table::main.bronze.raw", "notebook::/W/etl", "reads_from"),
        ("notebook::/W/etl", "table::main.silver.clean", "writes_to"),
        ("table::main.silver.clean", "notebook::/W/report", "reads_from"),
        ("notebook::/W/report", "table::main.gold.agg", "writes_to"),
        ("job::123", "notebook::/W/etl", "triggers"),
        ("pipeline::456", "notebook::/W/etl", "contains"),
    ]
    node_rows = [(f"{t}::{f}", t, f, n, {}) for t, f, n in nodes]
    return (
        spark.createDataFrame(
            node_rows, "id string, node_type string, fqn string, name string, metadata map<string,string>"
        ),
        spark.createDataFrame(edges, "src string, dst string, edge_type string"),
    )
