"""Tables that keep their rows where the next join wants them.

A walk asks in each round which pairs it has met before. Those pairs are kept
in one bucketed table to which each round appends, so that neither side is
sent anywhere but the newly found pairs, once, to their bucket.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.session import work_folder


def bucket_count(spark: SparkSession) -> int:
    """As many buckets as a shuffle has partitions, so that bucketed tables and shuffled rows match."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Levels:
    """Rows with a ``depth``, bucketed by ``keys``; a level is written once and never changed.

    The files lie in the shared work folder. A name in the session's catalog,
    which alone carries buckets, leads to them until ``close``.
    """

    def __init__(self, spark: SparkSession, label: str, fields: Sequence[T.StructField], keys: Sequence[str]) -> None:
        self.spark, self.keys = spark, list(keys)
        self.columns = [f.name for f in fields]
        self.schema = T.StructType([*fields, T.StructField("depth", T.IntegerType())])
        self.path, self.name = work_folder(spark, label), f"weftline_{uuid.uuid4().hex}"
        self.buckets = bucket_count(spark)

        self._append(spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]))

    def _append(self, rows: DataFrame) -> None:
        writer = rows.write.mode("append").format("parquet").option("path", self.path)
        if any(isinstance(f.dataType, T.ArrayType) for f in self.schema):
            writer = writer.option("compression", "zstd")  # paths repeat one another
        writer.partitionBy("depth").bucketBy(self.buckets, *self.keys).saveAsTable(self.name)

    def add(self, rows: DataFrame, depth: int) -> int:
        """Write a level and tell its rows, counted while they are written."""
        counted = Observation()
        rows = rows.select(*self.columns).observe(counted, F.count(F.lit(1)).alias("rows"))
        self._append(rows.withColumn("depth", F.lit(depth)))
        return counted.get["rows"]

    def all(self) -> DataFrame:
        """All levels, in buckets."""
        return self.spark.table(self.name)

    def level(self, depth: int) -> DataFrame:
        return self.all().where(F.col("depth") == depth).drop("depth")

    def fresh(self, found: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """The rows of ``found`` whose keys no level (of ``known``) has."""
        known = self.all() if known is None else known
        return found.join(known.select(*self.keys), self.keys, "left_anti")

    def close(self) -> DataFrame:
        """All levels as plain files; the name goes, the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        return self.spark.read.schema(self.schema).parquet(self.path)


def bucketed(df: DataFrame, label: str, *keys: str, path: str | None = None) -> tuple[DataFrame, str]:
    """The distinct rows of ``df`` written in buckets of ``keys``, and the name to drop when it is not needed any more."""
    spark, name = df.sparkSession, f"weftline_{uuid.uuid4().hex}"
    buckets = bucket_count(spark)
    cut = df.repartition(buckets, *keys).distinct()  # where the keys' rows lie; no second shuffle
    path = path or work_folder(spark, label)
    cut.write.format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return spark.table(name), name
