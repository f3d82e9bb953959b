"""Notebook text to cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import rx, strip

# Cell separator, magic commands with the cell type and language
# they stand for, and the cell type of each notebook language.
CELL_SEPARATOR = r"#\s*COMMAND\s*-{5,}|--\s*COMMAND\s*-{5,}"
MAGICS = {
    "sql": ("sql", "sql"),
    "python": ("python", "python"),
    "scala": ("scala", "scala"),
    "r": ("r", "r"),
    "md": ("markdown", "markdown"),
    "sh": ("magic", "shell"),
    "fs": ("magic", "dbutils"),
    "pip": ("magic", "pip"),
    "run": ("magic", "run"),
}
CODE_LANGUAGES = ["python", "sql", "scala", "r"]

_MAGIC = rx(r"\A\s*%(\w+)\s*(.*)\z", "s")


def cell_texts(source: Column) -> Column:
    """``array<struct<cell_index, content>>`` of the non-empty cells of a source.

    The index counts every piece between separators, so dropping the empty
    ones leaves gaps in it.
    """
    pieces = F.transform(
        F.split(source, rx(CELL_SEPARATOR), -1),
        lambda p, i: F.struct(i.alias("cell_index"), strip(p).alias("content")),
    )
    return F.filter(pieces, lambda c: c["content"] != "")


def notebook_language() -> Column:
    return F.coalesce(F.lower("language"), F.lit("python"))


def split_cells(notebooks: DataFrame) -> DataFrame:
    """``(path, default_language, cell_index, content)``."""
    return notebooks.select(
        "path", notebook_language().alias("default_language"), F.inline(cell_texts(F.col("source")))
    )


def _lookup(key: Column, values: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def _without_magic_prefix(content: Column) -> Column:
    text = F.regexp_replace(content, rx(r"^#\s*MAGIC\s*%md\s*", "m"), "")
    return strip(F.regexp_replace(text, rx(r"^#\s*MAGIC\s*", "m"), ""))


def scan_class(content: Column, language: Column) -> Column:
    """(cell_type, language, content) of a cell as the scanner and reviewer see it."""
    magic = F.lower(F.regexp_extract(content, _MAGIC, 1))
    plain_type = F.when(language.isin(CODE_LANGUAGES), language).otherwise(F.lit("unknown"))

    def cell(cell_type: Column, lang: Column, text: Column) -> Column:
        return F.struct(cell_type.alias("cell_type"), lang.alias("language"), text.alias("content"))

    return (
        F.when(
            content.startswith("%") & magic.isin(list(MAGICS)),
            cell(
                _lookup(magic, {m: t for m, (t, _) in MAGICS.items()}),
                _lookup(magic, {m: lang for m, (_, lang) in MAGICS.items()}),
                strip(F.regexp_extract(content, _MAGIC, 2)),
            ),
        )
        .when(
            content.startswith("# MAGIC %md"),
            cell(F.lit("markdown"), F.lit("markdown"), _without_magic_prefix(content)),
        )
        .otherwise(cell(plain_type, language, content))
    )


def export_class(content: Column, language: Column) -> Column:
    """(cell_type, language, content) of a cell as the Jupyter export sees it.

    Only ``%md`` and the four languages lose their magic line; any other
    magic stays code of the notebook's language with the line kept.
    """
    magic = F.lower(F.regexp_extract(content, _MAGIC, 1))
    body = strip(F.regexp_extract(content, _MAGIC, 2))

    def cell(cell_type: str, lang: Column, text: Column) -> Column:
        return F.struct(F.lit(cell_type).alias("cell_type"), lang.alias("language"), text.alias("content"))

    return (
        F.when(~content.startswith("%") & ~content.startswith("#"), cell("code", language, content))
        .when(magic == "md", cell("markdown", F.lit("markdown"), body))
        .when(magic.isin(CODE_LANGUAGES), cell("code", magic, body))
        .when(magic != "", cell("code", language, content))
        .when(
            content.rlike(rx(r"\A#\s*MAGIC\s+%md")),
            cell("markdown", F.lit("markdown"), _without_magic_prefix(content)),
        )
        .otherwise(cell("code", language, content))
    )


def classify_cells(cells: DataFrame, mode: str = "scan") -> DataFrame:
    """``(path, cell_index, cell_type, language, content)`` for split cells.

    ``mode='scan'`` serves lineage and review, ``mode='export'`` the Jupyter
    export, which also drops a cell holding nothing but the notebook header.
    """
    if mode not in ("scan", "export"):
        raise ValueError(f"unknown mode: {mode}")
    content, language = F.col("content"), F.col("default_language")
    if mode == "export":
        from weftline.sources.notebooks import EXPORT_HEADER

        cells = cells.where(~content.rlike(rx(EXPORT_HEADER, "i")))
    chosen = scan_class(content, language) if mode == "scan" else export_class(content, language)
    return cells.select("path", "cell_index", chosen.alias("cell")).select(
        "path", "cell_index", "cell.cell_type", "cell.language", "cell.content"
    )


def notebook_cells(notebooks: DataFrame, default_language: str | None = None) -> DataFrame:
    """Split and classify; ``default_language`` overrides the language column.

    Both happen inside the notebook's row and the finished cells are exploded
    once, so that a filter on the cell type cannot pull the classification
    back into itself and run it again.
    """
    if default_language is not None:
        notebooks = notebooks.withColumn("language", F.lit(default_language))
    language = notebook_language()

    def classified(cell: Column) -> Column:
        parts = scan_class(cell["content"], language)
        return F.struct(
            cell["cell_index"].alias("cell_index"),
            parts["cell_type"].alias("cell_type"),
            parts["language"].alias("language"),
            parts["content"].alias("content"),
        )

    return notebooks.select("path", F.inline(F.transform(cell_texts(F.col("source")), classified)))


def cell_counts(cells: DataFrame) -> DataFrame:
    """Number of non-empty cells per notebook."""
    return cells.groupBy("path").agg(F.count(F.lit(1)).alias("cell_count"))
