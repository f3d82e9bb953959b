from pyspark.sql import functions as F

from weftline.functions import sqltext
from weftline.operators import lineage
from weftline.operators.cells import notebook_cells


def cells(spark, *rows):
    return spark.createDataFrame(
        [("/n", i, kind, text) for i, (kind, text) in enumerate(rows)],
        "path string, cell_index int, cell_type string, content string",
    )


def refs_of(spark, *rows, **options):
    found = lineage.table_refs(cells(spark, *rows), **options).collect()
    return {(r.fqn, "w" if r.reference_type == "writes_to" else "r") for r in found}


CODE_CASES = [
    ('spark.table("c.s.t")', {("c.s.t", "r")}),
    ("spark.table( 's.t' )", {("s.t", "r")}),
    ('spark.read.table("t")', {("t", "r")}),
    ('DeltaTable.forName(spark, "c.s.t")', {("c.s.t", "r")}),
    ('spark.read.format("delta").load("/mnt/x")', set()),
    ('spark.read.format("delta").load("dbfs:/x")', {("dbfs:/x", "r")}),
    ('spark.table("a.b.c.d")', set()),
    ('dlt.read("b") + dlt.read_stream("c")', {("b", "r"), ("c", "r")}),
    ('spark.readStream.table("c.s.t")', {("c.s.t", "r")}),
    ('df.write.mode("overwrite").option("a", "b").saveAsTable("c.s.o")', {("c.s.o", "w")}),
    ('df.write.insertInto("o")', {("o", "w")}),
    ('df.writeTo("c.s.o").append()', {("c.s.o", "w")}),
    ('spark.sql("SELECT * FROM c.s.t")', {("c.s.t", "r")}),
    ("spark.sql(f'INSERT INTO o SELECT * FROM t')", {("o", "w"), ("t", "r")}),
    ('spark.sql("""\nMERGE INTO o USING t ON o.a = t.a\n""")', {("o", "w"), ("t", "r")}),
    ('spark.sql("USE CATALOG main")', set()),
    ("x = 1 + 2", set()),
]


def check_refs(spark, kind, cases):
    rows = [(str(i), 0, kind, text) for i, (text, _) in enumerate(cases)]
    given = spark.createDataFrame(rows, "path string, cell_index int, cell_type string, content string")
    found = {str(i): set() for i in range(len(cases))}
    for r in lineage.table_refs(given).collect():
        found[r.path].add((r.fqn, "w" if r.reference_type == "writes_to" else "r"))
    wrong = [(text, found[str(i)], expected) for i, (text, expected) in enumerate(cases) if found[str(i)] != expected]
    assert not wrong


def test_code(spark):
    check_refs(spark, "python", CODE_CASES)


SQL_CASES = [
    ("SELECT id FROM users", {("users", "r")}),
    ("SELECT * FROM a, b x, c AS y WHERE a.i = x.i", {("a", "r"), ("b", "r"), ("c", "r")}),
    ("SELECT * FROM a JOIN b ON a.i = b.i, c", {("a", "r"), ("b", "r"), ("c", "r")}),
    ("SELECT * FROM (SELECT * FROM a) x, b", {("a", "r"), ("b", "r")}),
    ("SELECT * FROM a LEFT JOIN b USING (i) CROSS JOIN c", {("a", "r"), ("b", "r"), ("c", "r")}),
    ("SELECT * FROM (a JOIN b ON a.i = b.i) JOIN (c)", {("a", "r"), ("b", "r"), ("c", "r")}),
    ("SELECT EXTRACT(YEAR FROM d), TRIM(BOTH FROM n) FROM t", {("t", "r")}),
    ("SELECT substring(n FROM 2) FROM t WHERE a IS NOT DISTINCT FROM b", {("t", "r")}),
    ("SELECT * FROM `my cat`.`s.x`.t", {("my cat.s.x.t", "r")}),
    ("SELECT * FROM range(10), t", {("t", "r")}),
    ("SELECT * FROM VALUES (1, 2) AS v(a, b)", set()),
    ("SELECT * FROM t LATERAL VIEW explode(xs) e AS x, y JOIN u", {("t", "r"), ("u", "r")}),
    ("SELECT (SELECT max(a) FROM b) FROM c WHERE x IN (SELECT y FROM d)", {("b", "r"), ("c", "r"), ("d", "r")}),
    ("SELECT 'FROM fake', \"JOIN fake\" FROM t -- FROM gone\n/* JOIN gone */", {("t", "r")}),
    ("SELECT 'it''s FROM fake' FROM t", {("t", "r")}),
    ("SELECT 'a\\'b FROM fake' FROM t", {("t", "r")}),
    ("INSERT INTO o (a, b) SELECT a, b FROM t", {("o", "w"), ("t", "r")}),
    ("INSERT OVERWRITE TABLE o PARTITION (d = 1) SELECT * FROM t", {("o", "w"), ("t", "r")}),
    ("INSERT INTO o SELECT * FROM o", {("o", "w")}),
    ("CREATE TABLE IF NOT EXISTS o (id INT)", {("o", "w")}),
    ("CREATE OR REPLACE TEMP VIEW v AS SELECT * FROM t", {("v", "w"), ("t", "r")}),
    ("CREATE TABLE o AS WITH c AS (SELECT 1 FROM t) SELECT * FROM c", {("o", "w"), ("t", "r"), ("c", "r")}),
    ("MERGE INTO o AS t USING (SELECT * FROM s) AS q ON t.i = q.i WHEN NOT MATCHED THEN INSERT *", {("o", "w"), ("s", "r")}),
    ("UPDATE t SET a = 1", {("t", "r")}),
    ("DELETE FROM t WHERE a = 1", {("t", "r")}),
    ("DROP TABLE IF EXISTS t", {("t", "r")}),
    ("CREATE TABLE o SHALLOW CLONE t", {("o", "w"), ("t", "r")}),
    ("SELECT 1 FROM t1; SELECT 2 FROM t2;", {("t1", "r"), ("t2", "r")}),
    ("SHOW TABLES FROM db", set()),
    ("THIS IS NOT SQL AT ALL $$$$", set()),
    ("SELECT count(*) FROM a UNION ALL SELECT 1 FROM b ORDER BY 1", {("a", "r"), ("b", "r")}),
    ("((SELECT * FROM a)) -- deep", {("a", "r")}),
]


def test_sql(spark):
    check_refs(spark, "sql", SQL_CASES)


def test_other_cells_hold_no_refs(spark):
    code = 'spark.table("c.s.t")'
    assert refs_of(spark, ("scala", code), ("r", code), ("magic", code), ("markdown", code), ("unknown", code)) == set()


def test_excluding_ctes(spark):
    sql = "WITH c AS (SELECT * FROM t), d AS (SELECT * FROM c) SELECT * FROM d JOIN u"
    assert refs_of(spark, ("sql", sql)) == {("t", "r"), ("c", "r"), ("d", "r"), ("u", "r")}
    assert refs_of(spark, ("sql", sql), exclude_ctes=True) == {("t", "r"), ("u", "r")}


def test_dedup_takes_the_first(spark):
    found = lineage.table_refs(cells(spark, ("sql", "SELECT * FROM t AS first"), ("sql", "SELECT * FROM t AS second"))).collect()
    assert [(r.fqn, r.alias) for r in found] == [("t", "first")]


def test_defaults_and_names(spark):
    statements = lineage.sql_statements(cells(spark, ("sql", "SELECT * FROM t JOIN s.u JOIN c.s.v")))
    refs = lineage.sql_refs(statements, "main", "def").collect()
    assert {r.fqn for r in refs} == {"main.def.t", "main.s.u", "c.s.v"}
    names = lineage.table_names(lineage.sql_statements(cells(spark, ("sql", "SELECT * FROM t1 JOIN t1 ON 1=1"))), ["path"])
    assert [r.fqn for r in names.collect()] == ["t1"]


def test_statement_kinds_and_errors(spark):
    text = "WITH c AS (SELECT 1) INSERT INTO o SELECT * FROM c; (SELECT 1) UNION (SELECT 2); SELECT * FROM (SELECT 1 UNION SELECT 2); gibberish here"
    typed = lineage.statement_types(lineage.sql_statements(cells(spark, ("sql", text)))).orderBy("stmt_index").collect()
    assert [t.statement_type for t in typed] == ["Insert", "Union", "Select", None]
    assert typed[3].error.startswith("no known statement starts with: gibberish")
    summary = lineage.text_types(lineage.sql_statements(cells(spark, ("sql", text)))).first()
    assert (summary.statements, summary.errors) == (4, 1)


COLUMN_CASES = [
    ("SELECT id, name n, u.age AS years FROM users u WHERE age > 18",
     [(".id", "select"), (".name", "select"), ("u.age", "select"), (".age", "where")]),
    ("SELECT t.*, count(*) c FROM t GROUP BY a HAVING max(b) > 1 ORDER BY c DESC NULLS LAST",
     [("t.*", "select"), (".a", "group_by"), (".b", "select"), (".c", "order_by")]),
    ("SELECT sum(x) OVER (PARTITION BY p ORDER BY o) s, y FROM t",
     [(".x", "select"), (".p", "select"), (".o", "order_by"), (".y", "select")]),
    ("SELECT CASE WHEN a IS NULL THEN b ELSE CAST(c AS INT) END d FROM t",
     [(".a", "select"), (".b", "select"), (".c", "select")]),
    ("SELECT a FROM t JOIN u ON t.i = u.i AND u.k IN (SELECT k FROM v WHERE w = 1)",
     [(".a", "select"), ("t.i", "join"), ("u.i", "join"), ("u.k", "join"), (".k", "select"), (".w", "where")]),
    ("SELECT date, timestamp, DATE '2024-01-01' FROM t WHERE EXTRACT(YEAR FROM d) = 1",
     [(".date", "select"), (".timestamp", "select"), (".d", "where")]),
    ("UPDATE t SET a = b WHERE c = 1", [(".a", "unknown"), (".b", "unknown"), (".c", "where")]),
    ("INSERT INTO t (a, b) SELECT c, d FROM s", [(".c", "select"), (".d", "select")]),
    ("CREATE TABLE t (a INT, b STRING)", []),
    ("SELECT a FROM t JOIN u USING (k)", [(".a", "select")]),
    ("SELECT x FROM t LATERAL VIEW explode(xs) e AS x, y", [(".x", "select"), (".xs", "select")]),
]


def test_columns(spark):
    rows = [(str(i), 0, "sql", text) for i, (text, _) in enumerate(COLUMN_CASES)]
    given = spark.createDataFrame(rows, "path string, cell_index int, cell_type string, content string")
    found = {str(i): [] for i in range(len(rows))}
    for r in lineage.column_refs(lineage.sql_statements(given)).collect():
        found[r.path].append((f"{r.qualifier}.{r.column}", r.context))
    wrong = [
    (text, sorted(found[str(i)]), sorted(expected))
        for i, (text, expected) in enumerate(COLUMN_CASES)
        if sorted(found[str(i)]) != sorted(expected)
    ]
    assert not wrong


def test_long_statements_do_not_break_the_regex_engine(spark):
    tuples = ", ".join(f"({i}, 'x{i}')" for i in range(20_000))
    columns = ", ".join(f"c{i}" for i in range(20_000))
    tables = ", ".join(f"t{i} a{i}" for i in range(3_000))
    nested = "SELECT * FROM " + "(SELECT * FROM " * 60 + "base" + ")" * 60
    texts = [
        f"INSERT INTO o VALUES {tuples}", f"SELECT {columns} FROM t", f"SELECT 1 FROM {tables}", nested, "(" * 5000,
        "SELECT * FROM t WHERE " + " OR ".join(f"c = {i}" for i in range(20_000)),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, sql string")
    counted = df.select("i", F.explode_outer(sqltext.split_statements(F.col("sql"))).alias("s")).select(
        "i",
        F.size(sqltext.table_refs_of(F.col("s"))).alias("tables"),
        F.size(sqltext.column_refs_of(F.col("s"))).alias("columns"),
    )
    by_text = {r.i: (r.tables, r.columns) for r in counted.collect()}
    assert by_text[0][0] == 1 and by_text[1] == (1, 20_000) and by_text[2][0] == 3_000
    assert by_text[3] == (1, 0) and by_text[4] == (0, 0) and by_text[5] == (1, 20_000)


PIPELINE = """# Databricks notebook source
import dlt
@dlt.table(comment="x", name="bronze")
def ignored():
    return spark.readStream.table("main.raw.events")

@dlt.view()
def silver():
    return dlt.read("bronze").join(dlt.read_stream("s.lookup")).join(spark.readStream.table("plain")).join(dlt.read("a.b.c.d"))

@dlt.table
def without_parentheses():
    return dlt.read("c.s.t")
"""


def test_pipeline(spark):
    books = spark.createDataFrame([("/p", "python", PIPELINE)], "path string, language string, source string")
    pipelines = spark.createDataFrame(
        [("1", "main", "gold", ["/p", "/missing"]), ("2", None, None, ["/p"])],
        "pipeline_id string, target_catalog string, target_schema string, notebook_paths array<string>",
    )
    found = {(r.pipeline_id, r.fqn, r.reference_type) for r in lineage.pipeline_refs(books, pipelines).collect()}
    qualified = {(f, k) for p, f, k in found if p == "1"}
    assert qualified == {
    ("main.gold.bronze", "writes_to"), ("main.gold.silver", "writes_to"), ("main.raw.events", "reads_from"),
    ("main.gold.bronze", "reads_from"), ("s.lookup", "reads_from"), ("plain", "reads_from"),
    ("main.gold.a.b.c.d", "reads_from"), ("c.s.t", "reads_from"),
    }
    assert ("2", "bronze", "writes_to") in found and ("2", "bronze", "reads_from") in found


def test_workspace_refs_is_the_sum_of_both_readings(spark):
    books = spark.createDataFrame(
        [("/p", "python", PIPELINE), ("/s", "sql", "SELECT * FROM t"), ("/e", "python", "")],
        "path string, language string, source string",
    )
    both = lineage.workspace_refs(books)
    ordinary = {(r.path, r.table, r.reference_type) for r in both.where("not as_pipeline").collect()}
    expected = {(r.path, r.table, r.reference_type) for r in lineage.all_refs(notebook_cells(books)).collect()}
    assert ordinary == expected and both.where("as_pipeline").count() == 8


def test_scan_report_counts_cells_and_distinct_references(spark):
    given = cells(
        spark,
        ("markdown", "SELECT * FROM no"),
        ("sql", "SELECT * FROM a.t JOIN a.t JOIN u; INSERT INTO o SELECT * FROM a.t"),
        ("python", 'spark.table("a.t")\nspark.sql("SELECT * FROM u")'),
        ("python", "pass"),
    )
    report = lineage.scan_report(given).first()
    assert (report.cell_count, report.table_reference_count) == (4, 3)
    assert [(r.table, r.reference_type, r.schema, r.table_name) for r in report.table_references] == [
        ("a.t", "reads_from", "a", "t"), ("o", "writes_to", None, "o"), ("u", "reads_from", None, "u"),
    ]
    distinct = {(r.fqn, r.reference_type) for r in lineage.table_refs(given).collect()}
    assert {(r.table, r.reference_type) for r in report.table_references} == distinct
