"""Joins that hold when one key owns a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 1_000
SPREAD = 16
#: Rows of a key at the bar that ``often_met`` counts.
COUNTED = 10_000


def hot_keys(df: DataFrame, key: str, total: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(key, fan)`` for every key holding more than ``hot_rows`` rows.

    The bar is raised to a thousandth of the table where that is more, so at
    most ``MAX_HOT_KEYS`` keys qualify, however large the table is; that
    bound is what makes broadcasting them safe. ``fan`` is the number of
    pieces a key is cut into.
    """
    bar = max(hot_rows, total // MAX_HOT_KEYS)
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bar)
    return counts.select(key, F.ceil(F.col("n") / bar).cast("int").alias("fan"))


def hot_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    left_total: int | None = None,
    right_total: int | None = None,
) -> DataFrame:
    """Equi-join on ``key`` with the rows of hot keys spread over many tasks.

    A hot key of one side is cut into pieces by a hash of the row, and the
    other side's rows of that key are repeated once per piece; every matching
    pair meets in exactly one piece, so the result is that of the plain join.
    A side too small to hold a hot key is not counted at all.

    ``how`` is ``inner``, or ``left`` for a right side that is unique per key:
    only the left side is cut then, as a left row repeated over pieces would
    find no partner in some of them. Rows of a side should differ from one
    another, since equal rows share a piece.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type: {how}")
    left_hot = found_hot(left, key, None, hot_rows) if left_total is None else often_met(left, key, left_total, hot_rows)
    right_hot = found_hot(right, key, right_total, hot_rows) if how == "inner" else []
    return join_cut(left, right, key, how, left_hot, right_hot)


def found_hot(df: DataFrame, key: str, total: int | None, hot_rows: int) -> list[Row]:
    """The rows of ``hot_keys``, which are few; none of a table too small for one."""
    if total is None:  # told by the counts themselves, so that ``df`` is worked out once
        most, total = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
        if (most or 0) <= hot_rows:
            return []
    return hot_keys(df, key, total, hot_rows).collect() if total > hot_rows else []


def often_met(df: DataFrame, key: str, total: int, hot_rows: int) -> list[Row]:
    """``found_hot`` of a table of ``total`` rows, told by some of its rows where many would have to be counted.

    This chooses how a join is dealt out and nothing else: a key just beside the bar may be taken for the other kind.
    """
    part = COUNTED / hot_rows
    if total <= hot_rows or part >= 1:
        return found_hot(df, key, total, hot_rows)
    bar = max(hot_rows, total // MAX_HOT_KEYS)
    counts = df.select(key).sample(part, seed=1).groupBy(key).agg((F.count(F.lit(1)) / F.lit(part)).alias("n")).where(F.col("n") > bar)
    return counts.select(key, F.ceil(F.col("n") / bar).cast("int").alias("fan")).collect()


def join_cut(left: DataFrame, right: DataFrame, key: str, how: str, left_hot: list[Row], right_hot: list[Row]) -> DataFrame:
    """``hot_join`` for known hot keys; without any it is the plain join, which leaves bucketed sides where they are."""
    if not left_hot and not right_hot:
        return left.join(right, key, how)

    # At most 2 * MAX_HOT_KEYS rows, see hot_keys.
    pieces = {k: [n, 1] for k, n in left_hot}
    for k, n in right_hot:
        pieces.setdefault(k, [1, 1])[1] = n
    kind = left.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("left_fan", T.IntegerType()), T.StructField("right_fan", T.IntegerType())])
    fans = F.broadcast(left.sparkSession.createDataFrame([(k, *n) for k, n in pieces.items()], schema))

    def cut(df: DataFrame, own: str, other: str) -> DataFrame:
        # Rows without a key match nothing but, in a left join, all stay.
        spread = F.when(F.col(key).isNull(), SPREAD).otherwise(F.coalesce(F.col(f"{own}_fan"), F.lit(1)))
        repeat = F.coalesce(F.col(f"{other}_fan"), F.lit(1))
        row_hash = F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")])
        return (
            df.join(fans, key, "left")
            .withColumn(f"{own}_salt", F.pmod(row_hash, spread).cast("int"))
            .withColumn(f"{other}_salt", F.explode(F.sequence(F.lit(0), repeat - 1)))
            .drop("left_fan", "right_fan")
        )

    joined = cut(left, "left", "right").join(cut(right, "right", "left"), [key, "left_salt", "right_salt"], how)
    return joined.drop("left_salt", "right_salt")


def spread_join(
    left: DataFrame, right: DataFrame, key: str, salt_on: str, how: str = "inner", pieces: int = SPREAD
) -> DataFrame:
    """Join a large side whose keys may be hot with a small one, without counting.

    Every key's left rows go to ``pieces`` tasks by a hash of ``salt_on``; the
    right side is repeated that many times. Each left row sees all right rows
    of its key once, so ``inner``, ``left``, ``left_semi`` and ``left_anti``
    are exact.
    """
    cut = left.withColumn("piece", F.pmod(F.xxhash64(salt_on), F.lit(pieces)).cast("int"))
    repeated = right.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    return cut.join(repeated, [key, "piece"], how).drop("piece")
