"""Lineage that follows the notebooks as they change."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from weftline.operators.cells import notebook_language
from weftline.operators.graph import merge_edges, notebook_nodes, table_edges, table_nodes
from weftline.operators.lineage import notebook_ref_array
from weftline.packaging import ship

# A store is an append-only table partitioned by batch: which version of which
# notebook a batch brought, and what that version mentions. A batch that runs
# again replaces its own partition, nothing else.
REFS = "array<struct<table:string,fqn:string,reference_type:string>>"
VERSION_SCHEMA = f"path string, version bigint, refs {REFS}"
STORE_SCHEMA = f"{VERSION_SCHEMA}, batch_id bigint"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def notebook_versions(notebooks: DataFrame) -> DataFrame:
    """``(path, version, refs)`` for each row of ``notebooks(path, language, source, version)``; the text stays behind."""
    refs = notebook_ref_array(F.col("source"), notebook_language())
    return notebooks.select("path", F.col("version").cast("bigint").alias("version"), refs.cast(REFS).alias("refs"))


def newest_versions(versions: DataFrame) -> DataFrame:
    """The newest version of each notebook with its references; of equal versions any."""
    newest = versions.groupBy("path").agg(F.max_by("refs", "version").alias("refs"), F.max("version").alias("version"))
    return newest.select("path", "version", "refs")


def newest_arrivals(versions: DataFrame) -> DataFrame:
    """``newest_versions`` of a stream, as an aggregate over all that has arrived: what a batch brought that is newer than all before.

    A version without a number counts as the oldest; of equal ones the later batch's passes.
    """
    now = F.current_timestamp()  # the batch's, for all of its rows
    order = F.struct(F.coalesce("version", F.lit(-(1 << 62))).alias("number"), "at")
    newest = versions.withColumn("at", now).groupBy("path").agg(F.max_by(F.struct("version", "refs", "at"), order).alias("best"))
    return newest.where(F.col("best.at") == now).select("path", "best.version", "best.refs")


class NewestVersion(StatefulProcessor):
    """Keeps the newest version of a notebook and lets only newer ones pass.

    State is the version's number: what it mentions goes on to the store, and
    nobody asks the state for it. A version without a number counts as the oldest.
    """

    def __init__(self, keep_ms: int = 0) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "version bigint", self.keep_ms or None)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:
            numbers = part["version"].fillna(-(1 << 62)).astype("int64")
            at = int(numbers.to_numpy().argmax())
            if best is None or numbers.iloc[at] >= best[0]:
                best = int(numbers.iloc[at]), part.iloc[at : at + 1]
        known = self.newest.get() if self.newest.exists() else None
        if best is not None and (known is None or best[0] >= known[0]):
            self.newest.update((best[0],))
            yield best[1][["path", "version", "refs"]]

    def close(self) -> None:
        pass


def upsert_versions(newest: DataFrame, batch_id: int, store: str) -> None:
    """Write the versions of a batch, one row for each path, as its partition."""
    newest.select("path", "version", "refs").write.mode("overwrite").parquet(f"{store}/batch_id={batch_id}")


def upsert_notebooks(batch: DataFrame, batch_id: int, store: str) -> None:
    """Add the newest version of each notebook in ``batch(path, language, source, version)``."""
    upsert_versions(newest_versions(notebook_versions(batch)), batch_id, store)


def stream_lineage(
    notebooks: DataFrame, store: str, checkpoint: str, trigger: dict | None = None, keep_days: float = 0
) -> StreamingQuery:
    """Keep ``store`` in step with a stream ``(path, language, source, version)``.

    References are found in the row that arrives; only they are sent to the
    notebook's state, which lets a version pass that is newer than all before.
    With ``keep_days`` the state of a notebook that has been silent for so long
    goes; should an older version of it arrive after that, the store still prefers the newer one.
    State that goes by notebook is kept by a Python processor, which costs about a millisecond or more for
    each notebook of a batch; without ``keep_days`` an aggregate keeps it.
    """
    spark = notebooks.sparkSession
    versions = notebook_versions(notebooks)
    if keep_days:
        ship(spark)
        kept = NewestVersion(int(keep_days * 86_400_000))
        newest = versions.groupBy("path").transformWithStateInPandas(kept, VERSION_SCHEMA, "Update", "ProcessingTime")
    else:
        newest = newest_arrivals(versions)
    writer = (
        newest.writeStream.outputMode("update")
        .foreachBatch(lambda df, batch_id: upsert_versions(df, batch_id, store))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
    )
    # The query takes the session's settings with it when it starts; this kind of state asks for this store.
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        return writer.start()
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def _stored(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(STORE_SCHEMA).parquet(store)


def current_versions(spark: SparkSession, store: str) -> DataFrame:
    """The newest version of every notebook and the batch that brought it."""
    latest = _stored(spark, store).groupBy("path").agg(F.max(F.struct("version", "batch_id")).alias("latest"))
    return latest.select("path", "latest.*")


def _current(spark: SparkSession, store: str) -> DataFrame:
    latest = current_versions(spark, store).select("path", "batch_id")
    return _stored(spark, store).join(latest, ["path", "batch_id"])


def current_refs(spark: SparkSession, store: str) -> DataFrame:
    """What the newest version of every notebook mentions."""
    return _current(spark, store).select("path", F.inline("refs"))


def current_graph(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of the stored notebooks."""
    refs = current_refs(spark, store)
    nodes = notebook_nodes(current_versions(spark, store)).unionByName(table_nodes(refs))
    return nodes, merge_edges(table_edges(refs))


def compact(spark: SparkSession, store: str, target: str) -> None:
    """Write the current state of ``store`` as one batch of a new store."""
    upsert_versions(_current(spark, store), -1, target)
