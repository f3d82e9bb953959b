import random
import re

from pyspark.sql import functions as F

from weftline.operators.review import match_line, review, review_report, snippet
from weftline.operators.rules import DEFAULT_RULES, Rule
from weftline.plans import corpora

FLAGS = {"i": re.IGNORECASE, "m": re.MULTILINE, "s": re.DOTALL}


def cells_of(spark, *rows):
    return spark.createDataFrame(
        [("/n", i, kind, text) for i, (kind, text) in enumerate(rows)],
        "path string, cell_index int, cell_type string, content string",
    )


def rules_of(spark, kind, text, **options):
    return [r.rule_id for r in review(cells_of(spark, (kind, text)), **options).orderBy("rule_pos").collect()]


def brute(kind, text):
    """The same rules by Python's own regex engine."""
    hits = []
    for rule in DEFAULT_RULES:
        flags = sum(FLAGS[f] for f in rule.flags)
        if rule.cell_types is not None and kind not in rule.cell_types:
            continue
        found = list(re.finditer(rule.pattern, text, flags))
        if len(found) >= rule.at_least and not any(re.search(u, text, flags) for u in rule.unless):
            line = text[: found[0].start()].count("\n")
            lines = text.split("\n")
            first = max(0, line - 2)
            hits.append((rule.rule_id, rule.message.replace("{n}", str(len(found))), "\n".join(lines[first : line + 3])))
    return hits


FRAGMENTS = [
    "SELECT * FROM t", "select *\nfrom a.b ;", "SELECT COUNT(*) FROM x", "CROSS  JOIN y", "df.join(broadcast(x), 'id')", "a.join(b)",
    "for x in xs:", "  df.write.save('/mnt/a')", "\n", "\n\n", "df = 1\n", "result = 2\n", "df.show()", "WHERE CAST(a AS INT)",
    "SELECT DISTINCT a", "ORDER BY a", "(SELECT 1", "( select 2", "FROM t WHERE year", "=", "BETWEEN", "CREATE TABLE t", "CLUSTER BY",
    ".groupBy('a').count()", ".withColumn('a', b)", ".repartition( 1 )", ".cache()", ".unpersist()", "display(df)", "display(df) # x",
    "mlflow.start_run(", "mlflow.end_run(", "with mlflow.start_run():", "mlflow.log_metrics", "mlflow.set_experiment(", "def f(x):",
    'def g(a):\n    """doc"""', "from x import *", "'dbfs:/a'", "%pip install", "print (1)", "password = 'x'", "Token='y'", "bearer abc",
    "dapi" + "0" * 32, "INSERT INTO t", "MERGE INTO m", "OPTIMIZE", "@udf", ".writeStream", ".toPandas()", ".collect( )", "é ü", "JOIN été ", "🙂",
    "spark.sql('SELECT * FROM t')", "df = 1\nresult = 2\ndata = 3\ndf.show()", "for y in ys:\n  z.write.save(1)",
]


def test_rules_match_brute_force(spark):
    rng = random.Random(11)
    rows = [
        (rng.choice(["sql", "python", "scala", "r", "magic"]), rng.choice([" ", "\n"]).join(rng.choices(FRAGMENTS, k=rng.randint(1, 9))))
        for _ in range(1500)
    ]
    found = {}
    for r in review(cells_of(spark, *rows)).orderBy("rule_pos").collect():
        found.setdefault(r.cell_index, []).append((r.rule_id, r.message, r.code_snippet))
    fired = set()
    for i, (kind, text) in enumerate(rows):
        want = brute(kind, text)
        assert found.get(i, []) == want, (kind, text)
        fired |= {w[0] for w in want}
    assert fired == {r.rule_id for r in DEFAULT_RULES}


def test_every_rule_fires_on_its_cell(spark):
    texts = [(kind, text.format(i="m.l0.t1", o="m.l1.t2", k=7)) for kind, text, _ in corpora.REVIEW_CELLS]
    found = {}
    for r in review(cells_of(spark, *texts)).collect():
        found.setdefault(r.cell_index, []).append(r.rule_id)
    for i, (_, _, rules) in enumerate(corpora.REVIEW_CELLS):
        assert sorted(found.get(i, [])) == sorted(rules), texts[i]


def test_categories(spark):
    text = "x = df.collect()\nprint(x)\ndf.cache()"
    assert rules_of(spark, "python", text) == ["PERF002", "STD005", "OPT013"]
    assert rules_of(spark, "python", text, categories="standards") == ["STD005"]
    assert rules_of(spark, "python", text, categories=" Performance , optimization") == ["PERF002", "OPT013"]
    assert rules_of(spark, "python", text, categories="none") == []


def test_own_rules(spark):
    todo = Rule("TODO1", "standards", "info", None, r"TODO", "i", "Open task.", "Do it.")
    assert rules_of(spark, "r", "x # todo", rules=[todo]) == ["TODO1"]


def test_one_credential_finding_per_cell(spark):
    cells = cells_of(spark, ("python", "token = 'a'\npassword = 'b'\nBearer x"), ("sql", "-- Bearer abc=="))
    assert sorted(r.message for r in review(cells).where("rule_id = 'STD020'").collect()) == [
        "Hardcoded Bearer token detected.", "Hardcoded password detected.",
    ]


def test_snippets(spark):
    lines = [f"line{i}" for i in range(9)]
    for at in (0, 1, 4, 7, 8):
        text = "\n".join([*lines[:at], "🙂 hit.collect()", *lines[at + 1 :]])
        got = review(cells_of(spark, ("python", text))).first().code_snippet
        assert got == "\n".join(text.split("\n")[max(0, at - 2) : at + 3])
    df = spark.createDataFrame([("\n".join(f"l{i}" for i in range(20)),)], "content string")
    wide = df.select(snippet(F.col("content"), match_line(F.col("content"), "l10"), 10, 5)).first()[0]
    assert wide == "\n".join(f"l{i}" for i in range(5))


def test_long_cells_do_not_break_the_regex_engine(spark):
    assigns = "df = 1\n" * 20_000
    texts = [
        ("python", assigns + "df.show()"), ("python", assigns), ("python", "for x in xs:\n" + "y = 1\n" * 20_000 + "df.write.save(1)"),
        ("sql", "SELECT DISTINCT a\n" + "b\n" * 50_000 + "ORDER BY a"), ("python", "a(" * 50_000), ("sql", "(SELECT " * 20_000),
        ("python", "x = '" + "🙂a" * 50_000 + "'"),
    ]
    found = {}
    for r in review(cells_of(spark, *texts)).collect():
        found.setdefault(r.cell_index, set()).add(r.rule_id)
    assert found == {0: {"PERF005"}, 2: {"PERF010"}, 3: {"OPT003"}, 5: {"OPT004"}}


def test_report_orders_by_severity(spark):
    cells = cells_of(
        spark, ("python", "print(1)"), ("markdown", "print(1)"), ("python", "df.collect()\nprint(2)\ntoken = 'x'"), ("sql", "SELECT 1")
    )
    more = spark.createDataFrame([("/clean", 0, "python", "x = 1")], cells.schema)
    reports = {r.path: r for r in review_report(cells.union(more)).collect()}
    report = reports["/n"]
    assert [(f.severity, f.cell_index, f.rule_id) for f in report.findings] == [
        ("critical", 2, "PERF002"), ("critical", 2, "STD020"), ("info", 0, "STD005"), ("info", 2, "STD005"),
    ]
    assert (report.cell_count, report.total_findings) == (4, 4)
    assert report.severity_counts == {"critical": 2, "info": 2}
    assert report.categories_checked == ["optimization", "performance", "standards"]
    assert set(report.findings[0].asDict()) == {
        "cell_index", "rule_id", "category", "severity", "message", "suggestion", "code_snippet",
    }
    clean = reports["/clean"]
    assert (clean.total_findings, clean.severity_counts, clean.findings) == (0, {}, [])
