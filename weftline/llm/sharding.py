"""Shards along a Hilbert curve through several metadata dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.ordering import positions
from weftline.session import materialize


def _curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """Digit and next state of the curve by ``state * 2**dims + corner``; a state is an entry corner and a direction."""
    size, mask = 1 << dims, (1 << dims) - 1

    def turn(value: int, by: int) -> int:
        by %= dims
        return ((value << by) | (value >> (dims - by))) & mask

    def ungray(value: int) -> int:
        out = 0
        while value:
            out ^= value
            value >>= 1
        return out

    def entry(digit: int) -> int:
        even = 2 * ((digit - 1) // 2) if digit else 0
        return even ^ (even >> 1)

    def direction(digit: int) -> int:
        odd = digit if digit % 2 else digit - 1
        return ((odd ^ (odd + 1)).bit_length() - 1) % dims if digit else 0

    digits, states = [], []
    for state in range(size * dims):
        start, axis = divmod(state, dims)
        for corner in range(size):
            digit = ungray(turn(corner ^ start, dims - (axis + 1) % dims))
            digits.append(digit)
            states.append((start ^ turn(entry(digit), axis + 1)) * dims + (axis + direction(digit) + 1) % dims)
    return digits, states


def hilbert_index(axes: Sequence[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a cell whose integer coordinates (0 to ``2**bits - 1``) are ``axes``.

    A plain column expression: one step for each bit looks up the curve's
    digit and next state. Needs 2 to 5 axes and ``len(axes) * bits`` below 63.
    """
    dims = len(axes)
    if not 2 <= dims <= 5 or dims * bits > 62:
        raise ValueError("2 to 5 axes, and at most 62 bits together")
    digits, states = (F.array(*[F.lit(v) for v in table]) for table in _curve_tables(dims))

    def step(held: Column, bit: Column) -> Column:
        corner = F.lit(0)
        for k, axis in enumerate(axes):
            corner = corner + F.call_function("shiftright", axis, bit).bitwiseAND(F.lit(1)) * F.lit(1 << k)
        at = (held["state"] * F.lit(1 << dims) + corner).cast("int")
        return F.struct(
            (held["place"] * F.lit(1 << dims) + F.get(digits, at)).cast("long").alias("place"),
            F.get(states, at).cast("int").alias("state"),
        )

    start = F.struct(F.lit(0).cast("long").alias("place"), F.lit(0).cast("int").alias("state"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step)["place"]


def quantised(df: DataFrame, column: str, bits: int, into: str) -> DataFrame:
    """``df`` with ``into``: the share of rows at or before the column's value, in ``2**bits`` steps.

    Equal values get equal steps and the order of values is kept, so a range
    of steps is a range of values. Null counts as a value of its own, first.
    """
    values = df.groupBy(F.col(column).alias("_value")).agg(F.count("*").alias("_n"))
    ranked = positions(values, [F.col("_value").asc_nulls_first()], ["_n"])
    total = ranked.agg(F.sum("_n")).first()[0] or 1
    middle = F.col("before__n") * 2 + F.col("_n")
    steps = ranked.select("_value", F.floor(middle * (1 << bits) / (2 * total)).cast("int").alias(into))
    return df.join(steps, F.col(column).eqNullSafe(F.col("_value")), "left").drop("_value")


def hilbert_shards(
    rows: DataFrame, dimensions: Sequence[str], ties: Sequence[str], n_shards: int, law: str = "rows", bits: int = 6
) -> DataFrame:
    """``rows`` sorted along the Hilbert curve through ``dimensions`` and cut into ``n_shards`` runs.

    Adds ``curve`` (place on the curve), ``shard`` and ``slot`` (place within
    the shard, from 0 without gaps). Under the law ``rows`` the shards' counts
    differ by one at most; under ``bytes`` a row belongs to the shard in which
    the middle of its ``size`` lies, so sums differ by one row's size. ``ties``
    orders rows in one cell; together with the cell it should tell rows apart.
    Repeated rows each get a slot. A column named like a result (curve, shard, slot) or like what
    leads to it (position, before_size) is replaced or left out. Null is a value like others. No rows give no
    rows; with fewer rows than shards some shards are empty.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law {law}")
    own = {"curve", "shard", "slot", "position", "before_size"} - {*dimensions, *ties}
    cells = rows.drop(*own)
    for k, dimension in enumerate(dimensions):
        cells = quantised(cells, dimension, bits, f"_axis{k}")
    axes = [F.col(f"_axis{k}") for k in range(len(dimensions))]
    placed = cells.withColumn("curve", hilbert_index(axes, bits)).drop(*[f"_axis{k}" for k in range(len(dimensions))])
    order = [F.col("curve"), *[F.col(c).asc_nulls_first() for c in ties]]
    if law == "rows":
        ranked = positions(placed, order)
        n = max(1, ranked.count())
        shard = F.expr(f"position * {n_shards} div {n}")
        first = F.expr(f"(shard * {n} + {n_shards - 1}) div {n_shards}")
        return ranked.withColumn("shard", shard).withColumn("slot", F.col("position") - first).drop("position")
    ranked = positions(placed, order, ["size"])
    total = max(1, ranked.agg(F.sum("size")).first()[0] or 0)
    shard = F.expr(f"least({n_shards - 1}, (2 * before_size + size) * {n_shards} div {2 * total})")
    cut = ranked.withColumn("shard", shard)
    firsts = cut.groupBy("shard").agg(F.min("position").alias("_first"))  # a row for each shard
    return (
        cut.join(F.broadcast(firsts), "shard")
        .withColumn("slot", F.col("position") - F.col("_first"))
        .drop("position", "before_size", "_first")
    )


def shard_ranges(sharded: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Per shard the row count and the least and greatest value of each dimension: what a reader needs to skip shards."""
    ends = [f(c).alias(f"{name}_{c}") for c in dimensions for name, f in (("min", F.min), ("max", F.max))]
    nulls = [F.sum(F.col(c).isNull().cast("long")).alias(f"nulls_{c}") for c in dimensions]
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), *ends, *nulls)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard below ``path``, each file sorted by slot."""
    out = sharded.repartition("shard").sortWithinPartitions("shard", "slot")
    out.write.partitionBy("shard").parquet(path)


def document_rows(documents: DataFrame) -> DataFrame:
    """doc_id, source, lang, size (UTF-8 bytes of the text plus 16), text_crc32 (of no bytes for null) and a size class."""
    rows = documents.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return rows.withColumn("size_class", F.floor(F.log2("size") * 8).cast("int"))


def op1_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 runs of a Hilbert curve through source, language and size."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = materialize(document_rows(documents), "shard-rows")  # the texts are read once
    sharded = hilbert_shards(rows, ["source", "lang", "size_class"], ["size_class", "doc_id", "text_crc32"], 40, "rows")
    return sharded.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
        "source",
        "lang",
    )


QUERIES = {"op1_hilbert_shards": op1_hilbert_shards}
