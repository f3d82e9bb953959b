"""The review rules: what to look for in a cell, and what to say about it."""

from __future__ import annotations

from dataclasses import dataclass

CATEGORIES = ["performance", "standards", "optimization"]
SEVERITIES = ["critical", "high", "medium", "low", "info"]

_CODE = ("python", "scala")
_PYTHON = ("python",)
_SQL = ("sql",)


@dataclass(frozen=True)
class Rule:
    """Fires once per cell where ``pattern`` occurs and nothing in ``unless`` does.

    ``flags`` are regex flags (i, m, s) of the pattern and the exceptions,
    ``cell_types`` the kinds of cells it reads (None: all), ``at_least`` the
    number of matches needed. ``{n}`` in the message becomes that number.
    ``hints`` are texts of which every match contains at least one (in lower
    case where the pattern ignores case); a cell without any is not searched.
    """

    rule_id: str
    category: str
    severity: str
    cell_types: tuple[str, ...] | None
    pattern: str
    flags: str
    message: str
    suggestion: str
    unless: tuple[str, ...] = ()
    at_least: int = 1
    hints: tuple[str, ...] = ()


_QUOTED_PATHS = ("dbfs:/", "/mnt/", "abfss://", "s3://", "gs://")

# Fixed values from here on: patterns, severities and texts of the rules.
# PERF005 and PERF010 are written so that long cells cannot exhaust the regex
# engine's stack; they fire on the same cells, from the same line on.

_PASSWORD = r"""(?:password|passwd|pwd)\s*=\s*["'][^"']+["']"""
_TOKEN = r"""(?:token|api_key|apikey|secret)\s*=\s*["'][^"']+["']"""
_PLATFORM_TOKEN = r"(?:dapi)[a-f0-9]{32,}"
_BEARER = r"(?:Bearer\s+)[a-zA-Z0-9\-._~+/]+=*"
_CREDENTIAL_ADVICE = "Use Databricks secrets (dbutils.secrets.get()) or environment variables instead."

DEFAULT_RULES = [
    Rule(
        "PERF001", "performance", "high", _SQL,
        r"SELECT\s+\*\s+FROM\s+\w+(?:\.\w+)*\s*(?:;|\s*$)", "im",
        "SELECT * without WHERE clause may cause a full table scan.",
        "Add a WHERE clause or select only needed columns to reduce data scanned.",
        hints=("*",),
    ),
    Rule(
        "PERF001", "performance", "high", _PYTHON,
        r"""(?:spark\.sql|sql)\(\s*(?:f?["']|f?\"\"\")\s*SELECT\s+\*\s+FROM\s""", "i",
        "SELECT * without column pruning found in spark.sql() call. This reads all columns from the table.",
        "Specify explicit column names instead of SELECT * for better performance and schema safety.",
        hints=("*",),
    ),
    Rule(
        "PERF002", "performance", "critical", _CODE,
        r"\.collect\(\s*\)", "",
        ".collect() brings all data to the driver. This can cause OOM errors on large datasets.",
        "Use .limit(N).collect() or .take(N) to limit data brought to the driver.",
        hints=(".collect(",),
    ),
    Rule(
        "PERF003", "performance", "critical", _PYTHON,
        r"\.toPandas\(\s*\)", "",
        ".toPandas() brings all data to the driver as a Pandas DataFrame. Can cause OOM.",
        "Use .limit(N).toPandas() or use Pandas API on Spark (pyspark.pandas) instead.",
        hints=(".toPandas(",),
    ),
    Rule(
        "PERF004", "performance", "medium", _CODE,
        r"\.join\(\s*(?!.*broadcast)", "i",
        "Join without broadcast hint. If one side is small, broadcasting can improve performance.",
        "Consider using F.broadcast(small_df) for joins with a small table (<100MB).",
        hints=(".jo",),
    ),
    Rule(
        "PERF005", "performance", "medium", _CODE,
        r"(?:(?:df|result|data)\s*=.*\n){3}(?:(?!.*\.show\(\))(?:df|result|data)\s*=.*\n)*+.*\.show\(\)", "",
        "Multiple DataFrame transformations may trigger repeated computation.",
        "Cache intermediate DataFrames with .cache() or .persist() if reused.",
        hints=(".show()",),
    ),
    Rule(
        "PERF006", "performance", "medium", _SQL,
        r"SELECT\s+COUNT\s*\(\s*\*\s*\)\s+FROM\s+\w+(?:\.\w+)*\s*(?:;|\s*$)", "im",
        "COUNT(*) without WHERE scans the entire table.",
        "Add a filter clause or use table statistics (DESCRIBE DETAIL) for approximate counts.",
        hints=("count",),
    ),
    Rule(
        "PERF007", "performance", "high", _SQL,
        r"CROSS\s+JOIN", "i",
        "CROSS JOIN produces a cartesian product — potentially explosive row count.",
        "Replace CROSS JOIN with a filtered JOIN if possible.",
        hints=("cro",),
    ),
    Rule(
        "PERF008", "performance", "medium", _PYTHON,
        r"@udf|udf\(|F\.udf\(", "",
        "Python UDFs serialize data to Python, causing significant overhead.",
        "Replace with built-in Spark functions or Pandas UDFs (@pandas_udf) for better performance.",
        hints=("udf",),
    ),
    Rule(
        "PERF009", "performance", "medium", _CODE,
        r"\.join\(.*(?:id|key|customer_id|user_id|account_id)", "i",
        "Join on a potentially high-cardinality key without a skew hint.",
        "If data is skewed, add SKEW JOIN hints or use salting: "
        "spark.sql('SELECT /*+ SKEW_JOIN(t, 'id') */ ...'). "
        "Enable AQE: spark.conf.set('spark.sql.adaptive.enabled', 'true').",
        hints=(".jo",),
    ),
    Rule(
        "PERF010", "performance", "high", _CODE,
        r"for\s+\w+\s+in\s+.*:\s*\n[\s\S]*(?:\.write\.|saveAsTable|\.save\()", "m",
        "Write operation inside a loop — likely to create many small files.",
        "Accumulate data and write once outside the loop, or use Delta merge/upsert patterns. "
        "Many small files degrade read performance significantly.",
        hints=("for",),
    ),
    Rule(
        "PERF011", "performance", "high", _CODE,
        r"\.writeStream\b", "",
        "Structured Streaming writeStream detected — verify a checkpoint location is configured.",
        "Always set a checkpoint location: "
        ".option('checkpointLocation', '/path/to/checkpoint'). "
        "Without it, the stream cannot recover from failures.",
        hints=(".writeStream",),
    ),
    Rule(
        "STD001", "standards", "low", _CODE,
        r"def\s+\w+\s*\(", "",
        "Function definition without docstring.",
        "Add a docstring to document the function's purpose, parameters, and return value.",
        unless=(r"""def\s+\w+\s*\([^)]*\)\s*(?:->.*)?:\s*\n\s*(?:\"\"\"|''')""",),
        hints=("def",),
    ),
    Rule(
        "STD002", "standards", "medium", _CODE,
        r"from\s+\S+\s+import\s+\*", "",
        "Wildcard import (import *) detected.",
        "Import specific names to improve readability and avoid namespace conflicts.",
        hints=("import",),
    ),
    Rule(
        "STD003", "standards", "medium", _CODE,
        r"""["'](?:dbfs:/|/mnt/|abfss://|s3://|gs://)[^"']+["']""", "",
        "Hardcoded storage path detected.",
        "Use configuration variables or Unity Catalog volumes instead of hardcoded paths.",
        hints=_QUOTED_PATHS,
    ),
    Rule(
        "STD004", "standards", "low", _CODE,
        r"^\s*%(?:sh|pip|fs)\b", "m",
        "Magic command (%sh, %pip, %fs) used — not recommended in production notebooks.",
        "Use dbutils or cluster libraries/init scripts for production workflows.",
        hints=("%sh", "%pip", "%fs"),
    ),
    Rule(
        "STD005", "standards", "info", _CODE,
        r"\bprint\s*\(", "",
        "print() statement found — may be leftover debug output.",
        "Use logging module or remove print statements in production code.",
        hints=("print",),
    ),
    Rule(
        "STD010", "standards", "low", _SQL,
        r"SELECT\s+\*", "i",
        "SELECT * used — consider specifying column names explicitly.",
        "List specific columns to improve readability and reduce data transfer.",
        hints=("*",),
    ),
    Rule(
        "STD011", "standards", "medium", _SQL,
        r"(?:FROM|JOIN|INTO)\s+(?![\w]+\.[\w]+)(\w+)(?:\s|;|$)", "i",
        "Unqualified table name — may resolve differently across environments.",
        "Use fully-qualified table names (catalog.schema.table) for clarity and portability.",
        hints=("from", "jo", "nto"),
    ),
    Rule(
        "STD020", "standards", "critical", None,
        _PASSWORD, "i",
        "Hardcoded password detected.",
        _CREDENTIAL_ADVICE,
        hints=("=",),
    ),
    Rule(
        "STD020", "standards", "critical", None,
        _TOKEN, "i",
        "Hardcoded token/API key detected.",
        _CREDENTIAL_ADVICE,
        unless=(_PASSWORD,),
        hints=("=",),
    ),
    Rule(
        "STD020", "standards", "critical", None,
        _PLATFORM_TOKEN, "i",
        "Possible Databricks personal access token detected.",
        _CREDENTIAL_ADVICE,
        unless=(_PASSWORD, _TOKEN),
        hints=("dap",),
    ),
    Rule(
        "STD020", "standards", "critical", None,
        _BEARER, "i",
        "Hardcoded Bearer token detected.",
        _CREDENTIAL_ADVICE,
        unless=(_PASSWORD, _TOKEN, _PLATFORM_TOKEN),
        hints=("bearer",),
    ),
    Rule(
        "OPT001", "optimization", "info", _SQL,
        r"(?:MERGE\s+INTO|INSERT\s+(?:INTO|OVERWRITE))", "i",
        "Write operation without OPTIMIZE/Z-ORDER — consider adding after bulk writes.",
        "Run OPTIMIZE table_name ZORDER BY (frequently_filtered_columns) "
        "after bulk writes to improve read performance.",
        unless=(r"OPTIMIZE|ZORDER|Z-ORDER",),
        hints=("merge", "nto", "overwr"),
    ),
    Rule(
        "OPT002", "optimization", "medium", _SQL,
        r"WHERE.*\bCAST\b.*\bAS\b", "i",
        "CAST in WHERE clause may prevent predicate pushdown.",
        "Move CAST operations out of filter predicates. "
        "Store data in the correct type, or filter before casting.",
        hints=("where",),
    ),
    Rule(
        "OPT003", "optimization", "low", _SQL,
        r"SELECT\s+DISTINCT.*ORDER\s+BY", "is",
        "DISTINCT with ORDER BY — both are expensive operations.",
        "Consider if both are necessary. GROUP BY may be more efficient than DISTINCT.",
        hints=("order",),
    ),
    Rule(
        "OPT004", "optimization", "medium", _SQL,
        r"\(\s*SELECT\b", "i",
        "Deeply nested subqueries ({n} levels) — may hurt readability and performance.",
        "Refactor using CTEs (WITH clause) for better readability and optimizer hints.",
        at_least=3,
        hints=("(",),
    ),
    Rule(
        "OPT005", "optimization", "medium", _SQL,
        r"FROM\s+\S+\s+WHERE\s+.*(?:date|dt|year|month|partition)", "i",
        "Possible partition column in WHERE but no equality/range filter for pruning.",
        "Use equality (=) or range (BETWEEN) filters on partition columns for optimal pruning.",
        unless=(r"=|>=|<=|BETWEEN|IN\s*\(",),
        hints=("where",),
    ),
    Rule(
        "OPT006", "optimization", "info", _SQL,
        r"CREATE\s+(?:OR\s+REPLACE\s+)?(?:TABLE|DELTA\s+TABLE)\s+\S+", "i",
        "New Delta table created without CLUSTER BY (liquid clustering) or PARTITIONED BY.",
        "For Delta Lake 3.1+ / Databricks Runtime 14.2+, prefer liquid clustering over static partitions:\n"
        "  CREATE TABLE my_table (id BIGINT, event_date DATE, ...)\n"
        "  CLUSTER BY (event_date, customer_id);",
        unless=(r"CLUSTER\s+BY|ZORDER|Z-ORDER|PARTITIONED?\s+BY",),
        hints=("create",),
    ),
    Rule(
        "OPT010", "optimization", "info", _CODE,
        r"\.groupBy\(.*\)\.count\(\)", "",
        "groupBy().count() — consider if approximate count is sufficient.",
        "For large datasets, approx_count_distinct() is much faster than exact count.",
        hints=(".groupBy(",),
    ),
    Rule(
        "OPT011", "optimization", "high", _CODE,
        r"for\s+\w+\s+in\s+.*:\s*\n\s*.*\.withColumn\(", "",
        "withColumn() inside a loop creates a new DataFrame per iteration — very slow.",
        "Use select() with a list of column expressions instead:\n"
        "  df.select([F.col(c).alias(new_name) for c in columns])",
        hints=(".withColumn(",),
    ),
    Rule(
        "OPT012", "optimization", "medium", _CODE,
        r"\.repartition\(\s*1\s*\)", "",
        ".repartition(1) causes a full shuffle. Use .coalesce(1) to reduce partitions without shuffle.",
        "Replace .repartition(1) with .coalesce(1) when reducing to fewer partitions.",
        hints=(".repartition(",),
    ),
    Rule(
        "OPT013", "optimization", "low", _CODE,
        r"\.cache\(\)", "",
        ".cache() without .unpersist() — cached data stays in memory.",
        "Call .unpersist() when cached DataFrame is no longer needed to free memory.",
        unless=(r"\.unpersist\(\)",),
        hints=(".cache()",),
    ),
    Rule(
        "OPT014", "optimization", "info", _CODE,
        r"\bdisplay\s*\(\s*\w+\s*\)(?!\s*#)", "",
        "display() on a large DataFrame can be slow.",
        "Use display(df.limit(100)) to preview large DataFrames efficiently.",
        hints=("display",),
    ),
    Rule(
        "OPT015", "optimization", "medium", _CODE,
        r"mlflow\.start_run\(", "",
        "mlflow.start_run() without mlflow.end_run() or context manager.",
        "Use mlflow.end_run() after training, or wrap in a context manager:\n"
        "  with mlflow.start_run():\n"
        "      ...  # training code",
        unless=(r"mlflow\.end_run\(|with\s+mlflow\.start_run",),
        hints=("mlflow.",),
    ),
    Rule(
        "OPT016", "optimization", "info", _CODE,
        r"mlflow\.start_run\(|mlflow\.set_experiment\(", "",
        "MLflow experiment started but no params/metrics logged.",
        "Log hyperparameters and metrics for full experiment tracking:\n"
        "  mlflow.log_params({'lr': 0.01, 'epochs': 10})\n"
        "  mlflow.log_metrics({'accuracy': acc, 'loss': loss})",
        unless=(r"mlflow\.log_(?:param|params|metric|metrics|artifact)",),
        hints=("mlflow.",),
    ),
]
