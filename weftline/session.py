"""Session builder and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folder: str | None = None


def local_session(cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("weftline")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def work_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one that ``spark.checkpoint.dir`` names.

    Only a local session may go without that setting; it then gets a
    temporary folder of its own, which goes with the application. On a cluster a machine-local folder would be
    lost with its executor, so the missing setting is an error there.
    """
    global _local_folder
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if _local_folder is None:
            _local_folder = tempfile.mkdtemp(prefix="weftline-")
            atexit.register(shutil.rmtree, _local_folder, ignore_errors=True)
        base = _local_folder
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Cut the lineage of ``df`` by writing it as a table in the shared folder.

    A written table survives the loss of executors, is columnar, and gives
    later joins its true size.
    """
    path = work_folder(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
