"""Row filters and default-filling projections for workspace listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.names import last_path_part
from weftline.functions.text import as_col

# Object types a listing descends into.
CONTAINERS = ["DIRECTORY", "REPO"]


def name_filter(df: DataFrame, column: str, needle: str = "") -> DataFrame:
    """Rows whose name holds ``needle``, ignoring case; an empty one keeps all."""
    if not needle:
        return df
    return df.where(F.lower(F.coalesce(column, F.lit(""))).contains(needle.lower()))


def scope(df: DataFrame, prefix: str, column: str = "path") -> DataFrame:
    """Rows whose path starts with ``prefix``, a plain text prefix."""
    return df.where(F.col(column).startswith(prefix)) if prefix else df


def or_default(c: Column | str, default: str | bool | int) -> Column:
    """The value, or ``default`` where it is null or nothing.

    Nothing is the empty text, false or zero, by the type of the default.
    """
    value = as_col(c)
    return F.when(value.isNull() | (value == F.lit(type(default)())), F.lit(default)).otherwise(value)


def with_defaults(df: DataFrame, spec: dict[str, object]) -> DataFrame:
    """Fill several columns; a column without a default keeps its nulls."""
    return df.withColumns({name: or_default(name, default) for name, default in spec.items()})


def list_notebooks(
    objects: DataFrame, root: str = "/", max_depth: int = 10, unreadable: DataFrame | None = None
) -> DataFrame:
    """``(path, name, language)`` of the notebooks at most ``max_depth`` folders below ``root``.

    ``objects(path, object_type, language)`` is the whole workspace. Only
    directories and repositories are descended into; ``unreadable(path)`` names
    folders that could not be listed, which drops what lies below them.
    """
    base = root.rstrip("/")
    below = objects.where(F.col("path").startswith(base + "/"))
    relative = F.expr(f"substring(path, {len(base) + 2})")
    folders = F.size(F.split(relative, "/", -1)) - 1
    notebooks = below.where((F.col("object_type") == "NOTEBOOK") & (folders <= max_depth)).select(
        "path",
        last_path_part("path").alias("name"),
        F.coalesce("language", F.lit("")).alias("language"),
        F.expr("substring(path, 1, length(path) - length(substring_index(path, '/', -1)) - 1)").alias("parent"),
    )
    # Whether a folder can be reached depends on the folders above it alone, so
    # the check runs on the distinct parents and not on every notebook.
    parents = notebooks.select("parent").distinct()
    parts = F.split("parent", "/", -1)
    root_parts = len(base.split("/"))
    steps = parents.select(
        "parent",
        F.explode(
            F.transform(F.sequence(F.lit(root_parts), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        ).alias("folder"),
    )
    containers = objects.where(F.col("object_type").isin(CONTAINERS)).select(F.col("path").alias("folder"))
    # A folder near the root is above most parents: adaptive execution splits
    # such a key on the left side, so the right side is never repeated for all.
    blocked = steps.where(F.col("folder") != base).join(containers, "folder", "left_anti").select("parent")
    if unreadable is not None:
        closed = unreadable.select(F.regexp_replace("path", "/$", "").alias("folder"))
        blocked = blocked.union(steps.join(closed, "folder", "left_semi").select("parent"))
    return notebooks.join(blocked.distinct(), "parent", "left_anti").select("path", "name", "language")


def listing_problems(objects: DataFrame, roots: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """``(root, error)`` for each of ``roots(root)`` that cannot be listed: it is not there, or it is among ``unreadable(path)``."""
    asked = roots.select("root", F.regexp_replace("root", "/+$", "").alias("path")).distinct().where("path <> ''")
    there = objects.where(F.col("object_type").isin(CONTAINERS)).select("path").distinct()
    missing = asked.join(there, "path", "left_anti")
    found = missing.select("root", F.concat(F.lit("Path not found: "), "root").alias("error"))
    if unreadable is None:
        return found
    closed = unreadable.select(F.regexp_replace("path", "/+$", "").alias("path")).distinct()
    shut = asked.join(there, "path", "left_semi").join(closed, "path", "left_semi")
    return found.union(shut.select("root", F.concat(F.lit("Failed to list workspace path: "), "root").alias("error")))
