"""Table names: composing, splitting and resolving dotted names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import ColumnLike, as_col


def fqn(catalog: ColumnLike, schema: ColumnLike, table: ColumnLike) -> Column:
    """Join the non-empty parts with dots."""
    parts = [F.nullif(as_col(p), F.lit("")) for p in (catalog, schema, table)]
    return F.concat_ws(".", *parts)


def name_struct(catalog: Column, schema: Column, table: Column) -> Column:
    return F.struct(
        catalog.cast("string").alias("catalog"),
        schema.cast("string").alias("schema"),
        table.cast("string").alias("table"),
    )


def parts_to_name(parts: Column) -> Column:
    """An array of 1 to 3 parts as (catalog, schema, table); null otherwise."""
    n = F.size(parts)
    null = F.lit(None).cast("string")
    return F.when(
        n.between(1, 3),
        name_struct(
            F.when(n == 3, F.element_at(parts, 1)).otherwise(null),
            F.when(n >= 2, F.element_at(parts, -2)).otherwise(null),
            F.element_at(parts, -1),
        ),
    )


def split_fqn(c: ColumnLike) -> Column:
    """A name written in code as (catalog, schema, table).

    Empty text, a path starting with ``/`` and names of four or more parts
    are no table reference and give null.
    """
    name = as_col(c)
    return F.when(
        (name != "") & ~name.startswith("/"), parts_to_name(F.split(name, r"\.", -1))
    )


def resolve_name(c: ColumnLike, catalog: ColumnLike, schema: ColumnLike) -> Column:
    """Qualify a 1- or 2-part name with defaults; 3 parts stay as they are."""
    name, cat, sch = as_col(c), as_col(catalog), as_col(schema)
    n = F.size(F.split(name, r"\.", -1))
    return (
        F.when(n == 3, name)
        .when(n == 2, F.concat(cat, F.lit("."), name))
        .otherwise(F.concat(cat, F.lit("."), sch, F.lit("."), name))
    )


def last_path_part(c: ColumnLike) -> Column:
    return F.substring_index(as_col(c), "/", -1)


def node_id(node_type: ColumnLike, name: ColumnLike) -> Column:
    """Graph identity: ``type::name``."""
    kind = F.lit(node_type) if isinstance(node_type, str) else node_type
    return F.concat(kind, F.lit("::"), as_col(name))
