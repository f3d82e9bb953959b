import base64
import json

from pyspark.sql import functions as F

from weftline.functions.text import source_lines, strip
from weftline.operators.cells import cell_counts, classify_cells, notebook_cells, split_cells
from weftline.sources.notebooks import load_notebooks, load_text_notebooks, to_ipynb

PYTHON = """# Databricks notebook source

# COMMAND ----------

df = spark.table("main.bronze.raw")

# COMMAND ----------


# COMMAND ----------

%SQL
SELECT 1

# COMMAND ----------

# MAGIC %md
# MAGIC # Title
# MAGIC text

# COMMAND ----------

# MAGIC %sql
# MAGIC SELECT 2

# COMMAND ----------

%conda list

# COMMAND ----------

%sh ls
"""


def notebooks(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, language string, source string")


def test_split_keeps_gaps_and_types(spark):
    cells = notebook_cells(notebooks(spark, ("/a", "PYTHON", PYTHON))).orderBy("cell_index").collect()
    assert [(c.cell_index, c.cell_type, c.language) for c in cells] == [
        (0, "python", "python"),
        (1, "python", "python"),
        (3, "sql", "sql"),
        (4, "markdown", "markdown"),
        (5, "python", "python"),
        (6, "python", "python"),
        (7, "magic", "shell"),
    ]
    by_index = {c.cell_index: c.content for c in cells}
    assert by_index[3] == "SELECT 1"
    assert by_index[4] == "# Title\ntext"
    assert by_index[5].startswith("# MAGIC %sql")
    assert by_index[6] == "%conda list"
    assert by_index[7] == "ls"


def test_default_language(spark):
    source = "SELECT 1\n\n-- COMMAND ------\n\nSELECT 2"
    books = notebooks(spark, ("/s", "sql", source), ("/n", None, source), ("/k", "kotlin", source))
    types = {(r.path, r.cell_type) for r in notebook_cells(books).collect()}
    assert types == {("/s", "sql"), ("/n", "python"), ("/k", "unknown")}
    forced = {r.cell_type for r in notebook_cells(books, default_language="python").collect()}
    assert forced == {"python"}


def test_two_steps_equal_one(spark):
    books = notebooks(spark, ("/a", "python", PYTHON), ("/e", "python", ""), ("/w", "r", " \n\t "))
    one = notebook_cells(books)
    two = classify_cells(split_cells(books))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert {r.path: r.cell_count for r in cell_counts(one).collect()} == {"/a": 7}


def test_short_separator_is_text(spark):
    cells = notebook_cells(notebooks(spark, ("/a", "python", "x\n# COMMAND ----\ny")))
    assert cells.count() == 1


def test_strip_and_lines(spark):
    df = spark.createDataFrame([("\n  a b \r\n\x0b",)], "t string")
    assert df.select(strip("t")).first()[0] == "a b"
    lines = spark.createDataFrame([("a\n\nb",), ("",)], "t string").select(source_lines("t")).collect()
    assert [r[0] for r in lines] == [["a\n", "\n", "b"], [""]]


def test_long_run_of_blanks(spark):
    text = "a" + " " * 200_000 + "b  "
    assert spark.createDataFrame([(text,)], "t string").select(F.length(strip("t"))).first()[0] == 200_002


def test_load_decodes_base64_only_when_it_is_text(spark):
    text = "été = spark.table('t')"
    encoded = base64.b64encode(text.encode()).decode()
    rows = [("/a", encoded, None), ("/b", text, None), ("/c", "SELECT 1 FROM t", None), ("/d", "abcd", "text"), ("/e", "YWI", None)]
    df = spark.createDataFrame(rows, "path string, source string, encoding string")
    plain = {r.path: r.source for r in load_notebooks(df.drop("encoding")).collect()}
    assert plain["/e"] == "YWI"
    assert plain["/a"] == text and plain["/b"] == text and plain["/c"] == "SELECT 1 FROM t"
    marked = {r.path: r.source for r in load_notebooks(df.withColumn("encoding", F.coalesce("encoding", F.lit("base64")))).collect()}
    assert marked["/a"] == text and marked["/d"] == "abcd"


def test_load_text_folder(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "nb.py").write_text("a = 1\n# COMMAND -----\nb = 2")
    loaded = load_text_notebooks(spark, str(tmp_path)).collect()
    assert loaded[0].path.endswith("/x/nb.py") and loaded[0].source.count("\n") == 2


def test_ipynb(spark):
    sql = "-- Databricks notebook source\n-- note\n\nSELECT 1;\n\n-- COMMAND ----------\n\n%python\nx = 1"
    books = notebooks(spark, ("/p", "PYTHON", PYTHON), ("/s", "SQL", sql), ("/e", "python", ""))
    docs = {r.path: json.loads(r.ipynb_json) for r in to_ipynb(books).collect()}
    cells = docs["/p"]["cells"]
    # The header stands alone in its cell, so that cell goes.
    assert [c["cell_type"] for c in cells] == ["code", "code", "markdown", "code", "code", "code"]
    assert cells[0]["source"] == ['df = spark.table("main.bronze.raw")']
    assert cells[0] == {
        "cell_type": "code", "execution_count": None, "metadata": {}, "outputs": [], "source": cells[0]["source"],
    }
    assert cells[1]["metadata"] == {"language": "sql"} and cells[1]["source"] == ["SELECT 1"]
    assert cells[2] == {"cell_type": "markdown", "metadata": {}, "source": ["# Title\n", "text"]}
    assert cells[5]["source"] == ["%sh ls"]
    assert docs["/p"]["metadata"]["kernelspec"] == {"display_name": "Python 3", "language": "python", "name": "python3"}
    # A header that shares its cell with code stays.
    assert docs["/s"]["cells"][0]["source"][0] == "-- Databricks notebook source\n"
    assert docs["/s"]["cells"][1]["metadata"] == {"language": "python"}
    assert docs["/s"]["metadata"]["language_info"] == {"name": "sql"}
    assert docs["/e"]["cells"] == [] and docs["/e"]["nbformat"] == 4 and docs["/e"]["nbformat_minor"] == 5
