"""Review of notebooks as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.cells import notebook_cells
from weftline.operators.review import review
from weftline.operators.rules import DEFAULT_RULES, Rule


def stream_review(
    notebooks: DataFrame,
    path: str,
    checkpoint: str,
    categories: str | Sequence[str] = "all",
    rules: Sequence[Rule] = DEFAULT_RULES,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append the findings of every arriving notebook to a parquet table.

    The review keeps no state, so the stream runs the batch expression.
    """
    return (
        review(notebook_cells(notebooks), categories, rules)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
