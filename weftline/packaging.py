"""The package on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import weftline


def ship(spark: SparkSession) -> None:
    """Give the package to the executors, once for each application, so that they need no installation."""
    context = spark.sparkContext
    if getattr(context, "_weftline_shipped", False):
        return
    root = Path(weftline.__file__).resolve().parent
    folder = os.path.realpath(tempfile.mkdtemp(prefix="weftline-code-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves the file as long as it runs
    target = os.path.join(folder, "weftline.zip")
    with zipfile.ZipFile(target, "w") as package:
        for source in sorted(root.rglob("*.py")):
            package.write(source, source.relative_to(root.parent))
    context.addPyFile(target)  # Spark itself takes it to the executors
    context._weftline_shipped = True
