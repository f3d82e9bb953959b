import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from weftline.plans import queries as registry
from weftline.plans.queries import TABLES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(value):
        return None if isinstance(value, float) and math.isnan(value) else round(value, 6) if isinstance(value, float) else value

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, db, name):
    found = contract.queries()[name](spark, SF)
    rows = normal(found.columns, [tuple(r) for r in found.collect()])
    oracle = contract.oracle_sql().get(name)
    if oracle is None:
        assert rows
        return
    answer = db.sql(oracle)
    assert sorted(answer.columns) == sorted(found.columns)
    assert rows == normal(answer.columns, answer.fetchall())


def test_entry(spark):
    found = contract.entry(spark)
    assert found.columns[:2] == ["change_id", "node_id"] and found.count() > 0




@pytest.mark.parametrize("file_bytes", [10_000, 1 << 26])
def test_text_files_are_bounded(spark, monkeypatch, file_bytes):
    """One language is many files, none much larger than asked, and the queries answer alike."""
    from weftline.plans import queries as registry
    from weftline.sources import files

    monkeypatch.setattr(registry._text_files, "__defaults__", (file_bytes,))
    folder = f"{contract.SMALL}"
    longest = max(len((r.text or "").encode()) + 1 for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    sizes = [r.file_size for r in files.list_files(spark, registry._text_files(spark, folder), recursive=True).where("not is_directory").collect()]
    assert max(sizes) <= max(2 * longest, 4 * file_bytes) and (len(sizes) > 20) == (file_bytes == 10_000)
    got = {n: sorted(map(str, contract.queries()[n](spark, folder).collect())) for n in ("file_listing", "file_reading")}
    monkeypatch.undo()
    assert got == {n: sorted(map(str, contract.queries()[n](spark, folder).collect())) for n in got}


def test_review_cells_stay_flat():
    """A text is one literal, however long, so that no session's first query runs out of stack."""
    from weftline.plans import corpora

    longest = max((text for _, text, _ in corpora.REVIEW_CELLS), key=len)
    assert longest.count("\n") >= 300 and corpora.sql_text(longest).count("||") == 0


def test_the_other_queries_stand_without_the_text_operators():
    """Without a library that the text operators need, the registry has all others."""
    import subprocess
    import sys

    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=os.path.dirname(contract.__file__))
    assert int(out.stdout) == len([n for n in contract.queries() if n != "pipeline" and not n.startswith("op")])


def test_a_question_about_edges_stores_no_nodes(spark, tmp_path):
    rows = [(k, k % 5) for k in range(40)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint").write.parquet(str(tmp_path / "orders.parquet"))
    counts = registry.QUERIES["graph_staleness"](spark, str(tmp_path)).collect()
    (stored,) = [parts for key, parts in registry._STORED.items() if key[1] == str(tmp_path)]
    assert "stored edges" in stored and "stored nodes" not in stored
    nodes, edges = registry.workspace_graph(spark, str(tmp_path))
    assert sum(r.n for r in counts) == edges.count() and nodes.count() > 0
