"""Global positions and running totals without a global window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id puts the partition above these


def positions(df: DataFrame, order: Sequence[Column], sums: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``position``, its row number from 0 in ``order``, and ``before_<c>`` for each column in ``sums``.

    The rows are sorted by range over all partitions and written once, so that
    positions hold when executors are lost. Only one total for each partition
    meets in a single task. Ties get any order; put enough columns into
    ``order`` that no value of all of them is frequent. An empty ``df`` stays empty.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    stored = materialize(cut.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    stored = stored.withColumn("_part", F.shiftright("_id", _ROW_BITS)).withColumn(
        "_row", F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = stored.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_sum_{c}") for c in sums])
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
        *[F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_off_{c}") for c in sums],
    )
    if sums:
        inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
        stored = stored.withColumns({f"_in_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    joined = stored.join(F.broadcast(offsets), "_part")  # one row for each partition
    return joined.select(
        *df.columns,
        (F.col("_offset") + F.col("_row")).alias("position"),
        *[(F.col(f"_off_{c}") + F.col(f"_in_{c}")).alias(f"before_{c}") for c in sums],
    )
