"""Notebook corpus in, Jupyter documents out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import as_col, decode_utf8_or_keep, rx, source_lines, strip
from weftline.operators.cells import CELL_SEPARATOR, export_class

# The header line of an exported notebook and the kernel
# description of each notebook language.
EXPORT_HEADER = r"\A\s*(?:#|--)?\s*Databricks notebook source\s*\z"
KERNELS = {
    "python": ("Python 3", "python", "python3"),
    "sql": ("SQL", "sql", "sql"),
    "scala": ("Scala", "scala", "scala"),
    "r": ("R", "R", "ir"),
}


def load_notebooks(
    notebooks: DataFrame | str, spark: SparkSession | None = None, default_language: str = "python"
) -> DataFrame:
    """``notebooks(path, language, source)`` with the source as plain text.

    Takes a DataFrame or a parquet folder with ``path``, ``source`` and,
    optionally, ``language`` and ``encoding``. Where ``encoding`` is given,
    only rows marked ``base64`` are decoded; else the text itself decides.
    """
    if isinstance(notebooks, str):
        if spark is None:
            raise ValueError("reading a folder needs a session")
        notebooks = spark.read.parquet(notebooks)
    text = decode_utf8_or_keep("source")
    if "encoding" in notebooks.columns:
        text = F.when(F.lower("encoding") == "base64", text).otherwise(F.col("source"))
    language = F.lit(default_language)
    if "language" in notebooks.columns:
        language = F.coalesce(F.lower("language"), language)
    return notebooks.select("path", language.alias("language"), text.alias("source"))


def load_text_notebooks(spark: SparkSession, path: str, language: str = "python") -> DataFrame:
    """One notebook per text file below ``path``."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return load_notebooks(
        files.select(
            F.col("_metadata.file_path").alias("path"),
            F.lit(language).alias("language"),
            F.col("value").alias("source"),
            F.lit("text").alias("encoding"),
        )
    )


def _cell_json(cell: Column, language: Column) -> Column:
    no_metadata = F.create_map().cast("map<string,string>")
    lines = source_lines(cell["content"])
    markdown = F.struct(
        F.lit("markdown").alias("cell_type"), no_metadata.alias("metadata"), lines.alias("source")
    )
    code = F.struct(
        F.lit("code").alias("cell_type"),
        F.lit(None).cast("int").alias("execution_count"),
        F.when(cell["language"] == language, no_metadata)
        .otherwise(F.create_map(F.lit("language"), cell["language"]))
        .alias("metadata"),
        F.array().cast("array<string>").alias("outputs"),
        lines.alias("source"),
    )
    keep_nulls = {"ignoreNullFields": "false"}
    return F.when(cell["cell_type"] == "markdown", F.to_json(markdown, keep_nulls)).otherwise(
        F.to_json(code, keep_nulls)
    )


def _kernel_json(language: Column) -> Column:
    documents = {
        name: F.to_json(
            F.struct(
                F.lit(display).alias("display_name"),
                F.lit(lang).alias("language"),
                F.lit(kernel).alias("name"),
            )
        )
        for name, (display, lang, kernel) in KERNELS.items()
    }
    chosen = documents["python"]
    for name, document in documents.items():
        chosen = F.when(language == name, document).otherwise(chosen)
    return chosen


def to_ipynb(notebooks: DataFrame) -> DataFrame:
    """``(path, ipynb_json)``: every notebook as a Jupyter document.

    The cells of a notebook never leave its row, so the export of a whole
    corpus is one narrow pass.
    """
    language = F.lower(F.coalesce(as_col("language"), F.lit("python")))
    texts = F.transform(F.split("source", rx(CELL_SEPARATOR), -1), strip)
    texts = F.filter(texts, lambda t: (t != "") & ~t.rlike(rx(EXPORT_HEADER, "i")))
    cells = F.transform(texts, lambda t: export_class(t, language))
    parts = F.transform(cells, lambda cell: _cell_json(cell, language))
    document = F.concat(
        F.lit('{"cells":['),
        F.array_join(parts, ","),
        F.lit('],"metadata":{"kernelspec":'),
        _kernel_json(language),
        F.lit(',"language_info":'),
        F.to_json(F.struct(language.alias("name"))),
        F.lit('},"nbformat":4,"nbformat_minor":5}'),
    )
    return notebooks.select("path", document.alias("ipynb_json"))
