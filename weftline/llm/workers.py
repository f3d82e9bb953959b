"""Python code on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftline.packaging import ship

#: Rows of an Arrow batch; what a Python worker holds at once follows this and the longest texts.
BATCH_ROWS = 2_000


def map_batches(
    df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str
) -> DataFrame:
    """``df.mapInArrow`` with the package at hand on the executors, and in batches that leave their memory alone."""
    ship(df.sparkSession)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(size, "0")) <= BATCH_ROWS:
        df.sparkSession.conf.set(size, str(BATCH_ROWS))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()  # the worker stays, for the next task or query

    return df.mapInArrow(tidy, schema)
