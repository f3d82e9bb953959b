"""Listing and reading the files of a volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.volumes import volume_files

MAX_BYTES = 1 << 20
_SCHEME = r"^[A-Za-z0-9+.-]+:(?://[^/]*(?=/))?"


def _plain(path: Column) -> Column:
    """A path without its scheme and with single slashes."""
    return F.regexp_replace(F.regexp_replace(path, _SCHEME, ""), "/+", "/")


def _all_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def is_mounted(spark: SparkSession, path: str) -> bool:
    """Whether a path is a folder of the machines, as a mounted volume is, and not one of a store that only Spark reads."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme() == "file"


def _children(spark: SparkSession, path: str) -> DataFrame:
    """What one folder holds, from its listing."""
    if is_mounted(spark, path):
        own = volume_files(spark, path, recursive=False, hidden=True)
        return own.select(
            F.substring_index("path", "/", -1).alias("name"),
            "path",
            "is_directory",
            F.col("length").alias("file_size"),
            F.when(~F.col("is_directory"), F.col("modified")).alias("last_modified"),
            "error",
        )
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") or "/")
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = [
        (s.getPath().getName(), s.getPath().toString(), s.isDirectory(), s.getLen(), s.getModificationTime())
        for s in system.listStatus(folder)
    ]
    found = spark.createDataFrame(rows, "name string, path string, is_directory boolean, bytes bigint, millis bigint")
    return found.select(
        "name",
        _plain(F.col("path")).alias("path"),
        "is_directory",
        F.when(~F.col("is_directory"), F.col("bytes")).alias("file_size"),
        F.when(~F.col("is_directory"), F.timestamp_millis("millis")).alias("last_modified"),
        F.lit(None).cast("string").alias("error"),
    )


def list_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """``(name, path, is_directory, file_size, last_modified, error)`` below ``path``.

    Contents are not read. Without ``recursive`` the folder's own listing
    answers, empty folders included, and nothing below it is visited. With it
    the whole tree is listed by Spark, and directories are those that hold a
    file somewhere below. Of a mounted folder (``is_mounted``) tasks list its own
    part, and what cannot be listed is a row with its ``error``.
    """
    if not recursive:
        return _children(spark, path)
    root = _plain(F.lit(path.rstrip("/") + "/"))
    files = _all_files(spark, path).select(
        _plain(F.col("path")).alias("path"),
        F.col("length").alias("file_size"),
        F.col("modificationTime").alias("last_modified"),
    )
    files = files.where(F.startswith("path", root)).withColumn("relative", F.substring("path", F.length(root) + 1, F.length("path")))
    steps = F.split("relative", "/", -1)
    parents = files.select(
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/")
            )
        ).alias("relative"),
        F.col("relative").alias("file"),
    ).where(F.col("relative") != F.col("file"))
    folders = parents.select("relative").distinct().select(
        F.concat(root, F.col("relative")).alias("path"),
        F.lit(None).cast("bigint").alias("file_size"),
        F.lit(None).cast("timestamp").alias("last_modified"),
        "relative",
        F.lit(True).alias("is_directory"),
    )
    items = files.withColumn("is_directory", F.lit(False)).unionByName(folders)
    return items.select(
        F.substring_index("path", "/", -1).alias("name"),
        "path",
        "is_directory",
        "file_size",
        "last_modified",
        F.lit(None).cast("string").alias("error"),
    )


def file_contents(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``(path, encoding, content_length, truncated, content)`` of ``files(path, content)``.

    The first ``max_bytes`` bytes, as text where they are valid UTF-8 and as
    base64 otherwise. A character cut in half by the limit makes them invalid.
    """
    raw = F.substring("content", 1, max_bytes)
    text = raw.cast("string")
    is_text = F.is_valid_utf8(text)
    plain_base64 = F.regexp_replace(F.base64(raw), r"\s", "")
    return files.select(
        "path",
        F.when(is_text, "utf-8").otherwise("base64").alias("encoding"),
        F.octet_length(raw).alias("content_length"),
        (F.octet_length(raw) >= max_bytes).alias("truncated"),
        F.when(is_text, text).otherwise(plain_base64).alias("content"),
    )


def read_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``(path, encoding, content_length, truncated, content, error)`` of every file below ``path``.

    Of a mounted folder's files the first ``max_bytes`` are read and no more,
    whatever their size, and a file that cannot be read is a row with its
    ``error``. Elsewhere Spark reads whole files; one beyond 2 GiB, which it
    cannot hold as one value, is a row without content, marked ``truncated``.
    """
    null = F.lit(None).cast("string")
    if is_mounted(spark, path):
        files = volume_files(spark, path, max_bytes).where("not is_directory")
        read = file_contents(files.where("content is not null"), max_bytes).withColumn("error", null)
        unread = files.where("content is null").select("path", null, F.lit(0), F.lit(False), null, "error")
        return read.union(unread)
    files = _all_files(spark, path)
    fits = F.col("length") < (1 << 31) - 16
    large = files.where(~fits).select("path", null, F.lit(0), F.lit(True), null)
    read = file_contents(files.where(fits).select("path", "content"), max_bytes).union(large)
    return read.withColumn("error", null)
