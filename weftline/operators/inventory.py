"""Tables, columns, catalogs and compute of a workspace; capped SQL results."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.filters import name_filter, or_default

ROW_LIMIT = 1000

# The statistics a metastore keeps among the table properties,
# and per kind of listing its columns with the defaults of missing values
# (KEEP: stays null).
ROWS_PROPERTY = "spark.sql.statistics.numRows"
SIZE_PROPERTY = "spark.sql.statistics.totalSize"
KEEP = object()
LISTINGS: dict[str, dict[str, object]] = {
    "catalog": {
        "name": KEEP,
        "owner": "",
        "comment": "",
        "catalog_type": "MANAGED_CATALOG",
        "isolation_mode": "",
        "created_at": KEEP,
    },
    "schema": {"name": KEEP, "full_name": KEEP, "owner": "", "comment": "", "created_at": KEEP},
    "volume": {
        "name": KEEP,
        "full_name": KEEP,
        "volume_type": "",
        "catalog_name": KEEP,
        "schema_name": KEEP,
        "storage_location": "",
        "owner": "",
        "comment": "",
        "created_at": KEEP,
    },
    "cluster": {
        "cluster_id": KEEP,
        "cluster_name": "",
        "state": "UNKNOWN",
        "creator_user_name": "",
        "spark_version": "",
        "node_type_id": "",
        "driver_node_type_id": KEEP,
        "autotermination_minutes": 0,
        "num_workers": KEEP,
    },
    "warehouse": {
        "id": KEEP,
        "name": "",
        "state": "UNKNOWN",
        "cluster_size": "",
        "warehouse_type": "",
        "creator_name": "",
        "num_clusters": 1,
        "auto_stop_mins": 0,
        "enable_serverless_compute": False,
    },
}
_NAME_COLUMN = {"cluster": "cluster_name"}


def inventory(kind: str, df: DataFrame, needle: str = "", catalog: str = "", schema: str = "") -> DataFrame:
    """Listing of catalogs, schemas, volumes, clusters or warehouses.

    Missing values become the listing's defaults. For schemas and volumes
    ``catalog`` and ``schema`` restrict the listing and complete full names.
    """
    spec = LISTINGS[kind]
    if kind in ("schema", "volume") and catalog:
        df = df.where(F.col("catalog_name") == catalog)
    if kind == "volume" and schema:
        df = df.where(F.col("schema_name") == schema)

    def value(name: str) -> Column:
        if kind == "cluster" and name == "driver_node_type_id":
            return or_default(F.coalesce(F.nullif(name, F.lit("")), "node_type_id"), "")
        if name == "full_name":
            parts = ["catalog_name", "name"] if kind == "schema" else ["catalog_name", "schema_name", "name"]
            return F.coalesce(F.nullif(F.col(name), F.lit("")), F.concat_ws(".", *parts))
        return F.col(name) if spec[name] is KEEP else or_default(name, spec[name])

    listed = df.select(*[value(name).alias(name) for name in spec])
    return name_filter(listed, _NAME_COLUMN.get(kind, "name"), needle)


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def list_tables(tables: DataFrame, catalog: str, schema: str) -> DataFrame:
    """``(name, full_name, table_type, comment, created_at)`` of one schema."""
    mine = tables.where((F.col("catalog") == catalog) & (F.col("schema") == schema))
    return mine.select("name", "full_name", "table_type", "comment", "created_at")


def file_statistics(spark: SparkSession, path: str, table_of: Column) -> DataFrame:
    """``(table, num_records, size_bytes)`` of all parquet tables below ``path``.

    One scan that reads no column, only how many rows each file has; sizes
    come from the listing, so thousands of tables cost one job.
    ``table_of`` derives the table from the ``file_path`` column.
    """
    rows = (
        spark.read.schema(T.StructType([]))
        .option("recursiveFileLookup", "true")
        .parquet(path)
        .select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("file_size"))
    )
    files = rows.groupBy("file_path", "file_size").agg(F.count(F.lit(1)).alias("n"))
    return files.groupBy(table_of.alias("table")).agg(
        F.sum("n").alias("num_records"), F.sum("file_size").alias("size_bytes")
    )


def footer_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``(table, num_records, size_bytes)`` as ``footer_statistics`` gives it, not yet worked out and in a session of its own."""
    # Pushing aggregates down is a setting of the session, and this one is nobody else's.
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    files = own.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    parts = []
    for table, path in paths.items():
        rows = own.read.parquet(path).agg(F.count(F.lit(1)).alias("_n"))
        sizes = files.load(path).agg(F.sum("length").alias("size_bytes"))
        parts.append(rows.select(F.lit(table).alias("table"), F.col("_n").alias("num_records")).join(sizes, how="cross"))  # one row each
    return reduce(DataFrame.unionByName, parts)


def footer_statistics(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``(table, num_records, size_bytes)`` of parquet tables, given by name and path; runs a job.

    The counts are aggregates that the parquet reader answers from the files'
    footers, so no row group is read and no row is counted; sizes come from the
    listing. A table that cannot be read fails the query.
    """
    found = footer_counts(spark, paths)
    # One row for each name. Files without rows have nothing to answer with, and no count.
    rows = [(r["table"], r["num_records"] or 0, r["size_bytes"]) for r in found.collect()]
    return spark.createDataFrame(rows, "table string, num_records bigint, size_bytes bigint")


def table_profile(tables: DataFrame, statistics: DataFrame) -> DataFrame:
    """Table metadata with ``row_count`` and ``size_bytes``.

    ``tables(full_name, table_type, properties, …)``,
    ``statistics(full_name, num_records, size_bytes)``. Physical statistics come
    first, then the table's properties; a view has only the latter.
    """
    is_view = F.upper(F.coalesce("table_type", F.lit(""))).contains("VIEW")

    def known(physical: str, key: str) -> Column:
        from_properties = F.try_element_at("properties", F.lit(key)).try_cast("bigint")
        return F.coalesce(F.when(~is_view, F.col(physical)), from_properties)

    others = [c for c in tables.columns if c != "full_name"]
    return tables.join(statistics.select("full_name", "num_records", "size_bytes"), "full_name", "left").select(
        "full_name",
        *others,
        known("num_records", ROWS_PROPERTY).alias("row_count"),
        known("size_bytes", SIZE_PROPERTY).alias("table_bytes"),
    ).withColumnRenamed("table_bytes", "size_bytes")


def column_inventory(
    spark: SparkSession, schemas: dict[str, T.StructType], partition_columns: dict[str, list[str]] | None = None
) -> DataFrame:
    """``(table, position, name, type, nullable, comment, is_partition_column)``."""
    by_table = partition_columns or {}
    rows = [
        (
            table,
            i,
            f.name,
            f.dataType.simpleString(),
            f.nullable if f.nullable is not None else True,
            f.metadata.get("comment"),
            f.name in by_table.get(table, []),
        )
        for table, schema in schemas.items()
        for i, f in enumerate(schema.fields)
    ]
    return spark.createDataFrame(
        rows,
        "table string, position int, name string, type string, nullable boolean, comment string, "
        "is_partition_column boolean",
    )


def value_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table, name, value_count)``: the values that are not null, one scan for each table."""
    parts = []
    for name, df in tables.items():
        counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("value_count")) for c in df.columns]))
        parts.append(counts.select(F.lit(name).alias("table"), pairs.alias("one")).select("table", "one.*"))
    return reduce(DataFrame.unionByName, parts)


def table_info(profile: DataFrame, columns: DataFrame) -> DataFrame:
    """Profiles with their columns as an array, in order.

    ``columns`` is a column inventory whose ``table`` is the full name; the
    array of a table is as long as its schema.
    """
    entry = F.struct("position", "name", "type", "nullable", "comment", "is_partition_column")
    listed = columns.groupBy(F.col("table").alias("full_name")).agg(
        F.sort_array(F.collect_list(entry)).alias("columns")
    )
    without_position = F.transform("columns", lambda c: c.dropFields("position"))
    return profile.join(listed, "full_name", "left").withColumn("columns", without_position)


@dataclass
class QueryResult:
    """At most ``limit`` rows of a query as texts, or the error it ended in."""

    query: str
    columns: list[str] = field(default_factory=list)
    rows: list[dict[str, str | None]] = field(default_factory=list)
    truncated: bool = False
    total_row_count: int | None = None
    error: str | None = None

    @property
    def row_count(self) -> int:
        return len(self.rows)


def capped(df: DataFrame, limit: int = ROW_LIMIT) -> DataFrame:
    """The first ``limit`` rows with every value as text."""
    return df.limit(limit).select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def run_sql(spark: SparkSession, sql: str, limit: int = ROW_LIMIT) -> QueryResult:
    """Run any SQL; the rows are counted in full only when they were cut."""
    try:
        df = spark.sql(sql)
        rows = [r.asDict() for r in capped(df, limit + 1).collect()]
        result = QueryResult(sql, list(df.columns), rows[:limit], len(rows) > limit)
        if result.truncated:  # the query runs again, for its count alone
            result.total_row_count = df.count()
        return result
    except PySparkException as problem:
        return QueryResult(sql, error=str(problem))
