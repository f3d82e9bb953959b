"""Failure messages to probable causes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import ColumnLike, as_col, rx

# Fixed values: (pattern, cause, suggestion), tried in this order.
ERROR_CAUSES = [
    (
        r"(?:schema|column).*(?:not found|missing|does not exist)",
        "schema_drift",
        "Check for upstream schema changes. Run impact analysis to identify affected assets.",
    ),
    (
        r"(?:out of memory|OOM|java\.lang\.OutOfMemoryError)",
        "resource_contention",
        "Increase driver/executor memory, reduce data volume, or optimize the query.",
    ),
    (
        r"(?:timeout|timed out|deadline exceeded)",
        "timeout",
        "Increase timeout settings, optimize the query, or check for resource contention.",
    ),
    (
        r"(?:permission denied|access denied|unauthorized|forbidden)",
        "permission_error",
        "Review table/resource ACLs and service principal permissions.",
    ),
    (
        r"(?:connection refused|network|unreachable|DNS)",
        "connectivity",
        "Check network connectivity, firewall rules, and endpoint availability.",
    ),
    (
        r"(?:concurrent.*(?:update|write)|conflict|optimistic locking)",
        "concurrency_conflict",
        "Implement retry logic or schedule jobs to avoid concurrent writes to the same table.",
    ),
    (
        r"(?:FileNotFoundException|path does not exist|No such file)",
        "missing_data",
        "Verify upstream data has been produced. Check storage paths and mount points.",
    ),
    (
        r"(?:ParseException|AnalysisException|syntax error)",
        "query_error",
        "Fix the SQL syntax or semantic error in the query/notebook.",
    ),
]
UNKNOWN_CAUSE = ("unknown", "Review the full error message and stack trace for details.")


def diagnose(message: ColumnLike) -> Column:
    """``struct<probable_cause, suggestion>`` of the first pattern that matches."""
    text = as_col(message)

    def verdict(cause: str, advice: str) -> Column:
        return F.struct(F.lit(cause).alias("probable_cause"), F.lit(advice).alias("suggestion"))

    chosen = verdict(*UNKNOWN_CAUSE)
    for pattern, cause, advice in reversed(ERROR_CAUSES):
        chosen = F.when(text.rlike(rx(pattern, "i")), verdict(cause, advice)).otherwise(chosen)
    return chosen
