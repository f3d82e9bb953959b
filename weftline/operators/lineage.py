"""Which tables code reads and writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import sqltext
from weftline.functions.names import parts_to_name, split_fqn
from weftline.functions.names import fqn as compose_fqn
from weftline.functions.text import extract_all, rx
from weftline.operators.cells import cell_texts, notebook_language, scan_class

_QUOTED = r"""["']([^"']+)["']\s*\)"""

# Calls that read or write a table, the calls of pipeline code,
# and the words that make a string passed to spark.sql a SQL text.
# Each call comes with the text that has to be there for it to match.
READ_CALLS = {
    "spark.table": r"spark\.table\(\s*" + _QUOTED,
    "spark.read.table": r"spark\.read\.table\(\s*" + _QUOTED,
    "DeltaTable.forName": r"DeltaTable\.forName\(\s*\w+\s*,\s*" + _QUOTED,
    "spark.read.format": r"""spark\.read\.format\(\s*["']delta["']\s*\)\.load\(\s*""" + _QUOTED,
}
PIPELINE_READ_CALLS = {
    "dlt.read(": r"dlt\.read\(\s*" + _QUOTED,
    "dlt.read_stream": r"dlt\.read_stream\(\s*" + _QUOTED,
    "spark.readStream.table": r"spark\.readStream\.table\(\s*" + _QUOTED,
}
WRITE_CALLS = {
    ".saveAsTable": r"\.write(?:\.\w+\([^)]*\))*\.saveAsTable\(\s*" + _QUOTED,
    ".insertInto": r"\.write(?:\.\w+\([^)]*\))*\.insertInto\(\s*" + _QUOTED,
    ".writeTo": r"\.writeTo\(\s*" + _QUOTED,
}
SQL_CALL = r"""spark\.sql\(\s*(?:f?["']|f?\"\"\")(.*?)(?:["']|\"\"\")\s*\)"""
SQL_WORDS = r"\b(SELECT|INSERT|CREATE|MERGE|UPDATE|DELETE)\b"


def _call_refs(content: Column, calls: dict[str, str], kind: str) -> Column:
    names = F.concat(*[extract_all(content, pattern, hint=hint) for hint, pattern in calls.items()])
    refs = F.transform(
        names,
        lambda n: F.struct(
            split_fqn(n).alias("name"),
            F.lit(None).cast("string").alias("alias"),
            F.lit(kind).alias("reference_type"),
        ),
    )
    return F.filter(refs, lambda r: r["name"].isNotNull())


def code_ref_array(content: Column) -> Column:
    """Table references made by method calls in python code."""
    return F.concat(
        _call_refs(content, READ_CALLS | PIPELINE_READ_CALLS, "reads_from"),
        _call_refs(content, WRITE_CALLS, "writes_to"),
    )


def inline_sql_array(content: Column) -> Column:
    """SQL texts passed to ``spark.sql``; quotes left by triple quoting are cut."""
    texts = extract_all(content, SQL_CALL, "s", hint="spark.sql")
    texts = F.transform(texts, lambda t: F.regexp_replace(t, r"""\A["']+|["']+\z""", ""))
    return F.filter(texts, lambda t: t.rlike(rx(SQL_WORDS, "i")))


def sql_texts(cell_type: Column, content: Column) -> Column:
    """The SQL a cell holds: all of a sql cell, the inline SQL of a python cell."""
    return (
        F.when(cell_type == "sql", F.array(content))
        .when(cell_type == "python", inline_sql_array(content))
        .otherwise(F.array().cast("array<string>"))
    )


def inline_sql(cells: DataFrame) -> DataFrame:
    """``(path, cell_index, text_pos, sql)``: SQL strings of python cells."""
    return cells.where(F.col("cell_type") == "python").select(
        "path", "cell_index", F.posexplode(inline_sql_array(F.col("content"))).alias("text_pos", "sql")
    )


def sql_statements(cells: DataFrame) -> DataFrame:
    """``(path, cell_index, text_pos, stmt_index, statement)``.

    Statements come with comments removed and literals emptied.
    """
    texts = cells.select(
        "path",
        "cell_index",
        F.posexplode(sql_texts(F.col("cell_type"), F.col("content"))).alias("text_pos", "sql"),
    )
    return texts.select(
        "path",
        "cell_index",
        "text_pos",
        F.posexplode(sqltext.split_statements(F.col("sql"))).alias("stmt_index", "statement"),
    )


def statement_types(statements: DataFrame) -> DataFrame:
    """Kind of every statement, and an error text where the verb is unknown."""
    kind = sqltext.statement_type(F.col("statement"))
    error = F.when(
        kind.isNull(), F.concat(F.lit("no known statement starts with: "), F.col("statement"))
    )
    return statements.withColumn("statement_type", kind).withColumn("error", error)


def text_types(statements: DataFrame) -> DataFrame:
    """Kind of a whole text: its last statement's, with all its errors."""
    typed = statement_types(statements)
    return typed.groupBy("path", "cell_index", "text_pos").agg(
        F.max_by("statement_type", "stmt_index").alias("statement_type"),
        F.count(F.lit(1)).alias("statements"),
        F.count("error").alias("errors"),
    )


def _sql_refs(
    statement: Column, catalog: str, schema: str, exclude_ctes: bool, verb: Column | None = None
) -> Column:
    """References of one cleaned statement, default catalog and schema filled in."""

    def named(ref: Column) -> Column:
        name = parts_to_name(ref["parts"])

        def default(part: str, value: str) -> Column:
            return F.coalesce(F.nullif(name[part], F.lit("")), F.nullif(F.lit(value), F.lit(""))).alias(part)

        return F.struct(
            F.when(
                name.isNotNull(),
                F.struct(default("catalog", catalog), default("schema", schema), name["table"].alias("table")),
            ).alias("name"),
            ref["alias"].alias("alias"),
            ref["reference_type"].alias("reference_type"),
        )

    refs = F.transform(sqltext.table_refs_of(statement, exclude_ctes, verb), named)
    return F.filter(refs, lambda r: r["name"].isNotNull())


def _as_rows(df: DataFrame, keys: list[str], refs: Column) -> DataFrame:
    hit = df.select(*keys, F.posexplode(refs).alias("ref_pos", "ref"))
    return hit.select(
        *keys,
        "ref_pos",
        F.col("ref.name.catalog").alias("catalog"),
        F.col("ref.name.schema").alias("schema"),
        F.col("ref.name.table").alias("table"),
        "ref.alias",
        "ref.reference_type",
        compose_fqn("ref.name.catalog", "ref.name.schema", "ref.name.table").alias("fqn"),
    ).where(F.col("fqn") != "")


def code_refs(cells: DataFrame) -> DataFrame:
    """References made by method calls, one row per occurrence."""
    return _as_rows(
        cells.where(F.col("cell_type") == "python"), ["path", "cell_index"], code_ref_array(F.col("content"))
    )


def sql_refs(
    statements: DataFrame, default_catalog: str = "", default_schema: str = "", exclude_ctes: bool = False
) -> DataFrame:
    """References of SQL statements, one row per occurrence.

    Takes any columns next to ``statement`` along. A name without catalog or
    schema gets the defaults, if given.
    """
    keys = [c for c in statements.columns if c != "statement"]
    return _as_rows(statements, keys, _sql_refs(F.col("statement"), default_catalog, default_schema, exclude_ctes))


def table_names(statements: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct tables of each text."""
    return sql_refs(statements).select(*keys, "fqn").distinct()


def column_refs(statements: DataFrame) -> DataFrame:
    """``(…, column_pos, qualifier, column, context)``: columns with their clause."""
    keys = [c for c in statements.columns if c != "statement"]
    hits = statements.select(
        *keys, F.posexplode(sqltext.column_refs_of(F.col("statement"))).alias("column_pos", "hit")
    )
    return hits.select(*keys, "column_pos", "hit.qualifier", "hit.column", "hit.context")


def _work_item(kind: Column, text: Column) -> Column:
    """A text to read; a statement's verb is found once and taken along."""
    return F.struct(
        kind.alias("kind"),
        text.alias("text"),
        F.when(kind == "sql", sqltext.first_keyword(text)).alias("verb"),
    )


def all_refs(cells: DataFrame, exclude_ctes: bool = False) -> DataFrame:
    """Every reference of every python and sql cell, one row per occurrence.

    A cell becomes work items, its code and each of its SQL statements, so
    text is read once and nothing is shuffled.
    """
    content, cell_type = F.col("content"), F.col("cell_type")
    statements = F.flatten(F.transform(sql_texts(cell_type, content), sqltext.split_statements))
    code = F.when(cell_type == "python", F.array(content)).otherwise(F.array().cast("array<string>"))

    items = F.concat(
        F.transform(code, lambda t: _work_item(F.lit("code"), t)),
        F.transform(statements, lambda t: _work_item(F.lit("sql"), t)),
    )
    work = (
        cells.where(cell_type.isin("python", "sql"))
        .select("path", "cell_index", F.posexplode(items).alias("item_pos", "item"))
        .select("path", "cell_index", "item_pos", "item.*")
    )
    refs = F.when(F.col("kind") == "code", code_ref_array(F.col("text"))).otherwise(
        _sql_refs(F.col("text"), "", "", exclude_ctes, F.col("verb"))
    )
    return _as_rows(work, ["path", "cell_index", "item_pos"], refs)


def notebook_ref_array(source: Column, language: Column) -> Column:
    """What one notebook mentions, ``array<struct<table, fqn, reference_type>>``, worked out inside its row.

    The references of ``all_refs``, each once, in no order.
    """
    nothing = F.array().cast(
        "array<struct<name:struct<catalog:string,schema:string,table:string>,alias:string,reference_type:string>>"
    )

    def of_cell(cell: Column) -> Column:
        statements = F.flatten(
            F.transform(sql_texts(cell["cell_type"], cell["content"]), sqltext.split_statements)
        )
        return F.concat(
            F.when(cell["cell_type"] == "python", code_ref_array(cell["content"])).otherwise(nothing),
            F.flatten(F.transform(statements, lambda s: _sql_refs(s, "", "", False))),
        )

    def classified(cell: Column) -> Column:
        parts = scan_class(cell["content"], language)
        return F.struct(parts["cell_type"].alias("cell_type"), parts["content"].alias("content"))

    cells = F.transform(cell_texts(source), classified)
    refs = F.transform(
        F.flatten(F.transform(cells, of_cell)),
        lambda r: F.struct(
            r["name"]["table"].alias("table"),
            compose_fqn(r["name"]["catalog"], r["name"]["schema"], r["name"]["table"]).alias("fqn"),
            r["reference_type"].alias("reference_type"),
        ),
    )
    return F.array_distinct(F.filter(refs, lambda r: r["fqn"] != ""))


def dedup_refs(refs: DataFrame) -> DataFrame:
    """One row per notebook, table and direction; the first occurrence wins."""
    order = [c for c in ("cell_index", "item_pos", "ref_pos") if c in refs.columns]
    first = F.min_by(
        F.struct("catalog", "schema", "table", "alias"), F.struct(*[F.col(c) for c in order])
    )
    return (
        refs.groupBy("path", "fqn", "reference_type")
        .agg(first.alias("first"))
        .select("path", "first.*", "reference_type", "fqn")
    )


def table_refs(cells: DataFrame, exclude_ctes: bool = False) -> DataFrame:
    """``refs(path, catalog, schema, table, alias, reference_type, fqn)``, deduplicated."""
    return dedup_refs(all_refs(cells, exclude_ctes))


# Decorators that declare a pipeline table or view, and the
# function name that stands in for a missing name.
TARGET_DECORATOR = (
    r"""@dlt\.(?:table|view)\s*\((?:[^)]*name\s*=\s*["']([^"']+)["'])?(?=(?:[\s\S]*?def\s+(\w+)\s*\()?)"""
)
PIPELINE_READ = r"(?:dlt\.read|dlt\.read_stream)\(\s*" + _QUOTED
STREAM_READ = r"spark\.readStream\.table\(\s*" + _QUOTED


_PIPELINE_REF = (
    "array<struct<name:struct<catalog:string,schema:string,table:string>,"
    "alias:string,reference_type:string,qualify:boolean>>"
)


def pipeline_ref_array(source: Column) -> Column:
    """References of pipeline code: reads first, then declared targets.

    ``qualify`` marks the names that live in the catalog and schema of the
    pipeline that runs the code: targets, and one-part names read by ``dlt``
    calls. Stream reads are taken as written. Names of four or more parts
    stay whole.
    """
    null = F.lit(None).cast("string")

    def whole(table: Column) -> Column:
        return F.struct(null.alias("catalog"), null.alias("schema"), table.alias("table"))

    def ref(name: Column, kind: str, qualify: Column) -> Column:
        return F.struct(
            name.alias("name"),
            null.alias("alias"),
            F.lit(kind).alias("reference_type"),
            qualify.alias("qualify"),
        )

    def read(own_default: bool):
        def as_ref(text: Column) -> Column:
            parts = F.split(text, r"\.", -1)
            written = F.size(parts).isin(2, 3)
            name = F.when(written, parts_to_name(parts)).otherwise(whole(text))
            return ref(name, "reads_from", ~written if own_default else F.lit(False))

        return as_ref

    declared = F.arrays_zip(
        extract_all(source, TARGET_DECORATOR, "", 1, "@dlt.").alias("named"),
        extract_all(source, TARGET_DECORATOR, "", 2, "@dlt.").alias("function"),
    )
    targets = F.filter(
        F.transform(declared, lambda d: F.when(d["named"] != "", d["named"]).otherwise(d["function"])),
        lambda t: t.isNotNull() & (t != ""),
    )
    return F.concat(
        F.transform(extract_all(source, PIPELINE_READ, hint="dlt.read"), read(True)),
        F.transform(extract_all(source, STREAM_READ, hint="readStream"), read(False)),
        F.transform(targets, lambda t: ref(whole(t), "writes_to", F.lit(True))),
    )


def qualify_pipeline_refs(raw: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Raw references met with every pipeline that holds their notebook.

    A notebook shared by very many pipelines is a hot path; its references
    are few, and adaptive execution splits the pipelines' side.
    """
    held = pipelines.select(
        "pipeline_id", "target_catalog", "target_schema", F.explode("notebook_paths").alias("path")
    )
    joined = held.join(raw, "path")
    catalog = F.when(F.col("qualify"), F.col("target_catalog")).otherwise(F.col("catalog"))
    schema = F.when(F.col("qualify"), F.col("target_schema")).otherwise(F.col("schema"))
    return joined.select(
        "pipeline_id",
        "path",
        catalog.alias("catalog"),
        schema.alias("schema"),
        "table",
        "reference_type",
        compose_fqn(catalog, schema, "table").alias("fqn"),
    ).where(F.col("fqn") != "")


def pipeline_refs(notebooks: DataFrame, pipelines: DataFrame) -> DataFrame:
    """References of the notebooks that pipelines hold.

    ``pipelines`` needs ``pipeline_id, target_catalog, target_schema,
    notebook_paths``. Texts are read where they lie; only what was found in
    them is shuffled to the pipelines.
    """
    raw = notebooks.select("path", F.explode(pipeline_ref_array(F.col("source"))).alias("ref")).select(
        "path", "ref.name.*", "ref.reference_type", "ref.qualify"
    )
    return qualify_pipeline_refs(raw, pipelines)


def workspace_refs(notebooks: DataFrame) -> DataFrame:
    """Everything a workspace's notebooks mention, from one pass over their text.

    ``(path, as_pipeline, catalog, schema, table, reference_type, qualify)``:
    each notebook read as ordinary code, and, where it looks like pipeline
    code, as such too. Which reading counts is for the graph to say. One row
    per occurrence, and no shuffle.
    """
    language = notebook_language()

    def cell(found: Column) -> Column:
        parts = scan_class(found["content"], language)
        return F.struct(parts["cell_type"].alias("kind"), parts["content"].alias("content"))

    cells = F.transform(cell_texts(F.col("source")), cell)
    whole = F.when(
        F.col("source").contains("dlt.") | F.col("source").contains("readStream"),
        F.array(F.struct(F.lit("pipeline").alias("kind"), F.col("source").alias("content"))),
    ).otherwise(F.array().cast("array<struct<kind:string,content:string>>"))
    cells = notebooks.select("path", F.inline(F.concat(cells, whole))).where(
        F.col("kind").isin("python", "sql", "pipeline")
    )
    statements = F.flatten(F.transform(sql_texts(F.col("kind"), F.col("content")), sqltext.split_statements))
    own = F.when(F.col("kind") == "sql", F.array().cast("array<string>")).otherwise(F.array("content"))

    items = F.concat(
        F.transform(own, lambda t: _work_item(F.col("kind"), t)),
        F.transform(statements, lambda t: _work_item(F.lit("sql"), t)),
    )
    work = cells.select("path", F.inline(items))

    def unqualified(refs: Column) -> Column:
        return F.transform(
            refs,
            lambda r: F.struct(
                r["name"].alias("name"),
                r["alias"].alias("alias"),
                r["reference_type"].alias("reference_type"),
                F.lit(False).alias("qualify"),
            ),
        )

    refs = (
        F.when(F.col("kind") == "python", unqualified(code_ref_array(F.col("text"))).cast(_PIPELINE_REF))
        .when(F.col("kind") == "sql", unqualified(_sql_refs(F.col("text"), "", "", False, F.col("verb"))).cast(_PIPELINE_REF))
        .otherwise(pipeline_ref_array(F.col("text")).cast(_PIPELINE_REF))
    )
    found = work.select("path", (F.col("kind") == "pipeline").alias("as_pipeline"), F.explode(refs).alias("ref"))
    return found.select("path", "as_pipeline", "ref.name.*", "ref.reference_type", "ref.qualify")


def scan_report(cells: DataFrame, exclude_ctes: bool = False) -> DataFrame:
    """Per notebook: cell count, reference count and the distinct references.

    One pass over the cells and one shuffle of what they mention. A notebook's
    list is bounded by its own text, which was a single value before.
    """
    cell_type, content = F.col("cell_type"), F.col("content")
    no_refs = F.array().cast(
        "array<struct<name:struct<catalog:string,schema:string,table:string>,alias:string,reference_type:string>>"
    )
    statements = F.flatten(F.transform(sql_texts(cell_type, content), sqltext.split_statements))
    found = F.concat(
        F.when(cell_type == "python", code_ref_array(content)).otherwise(no_refs),
        F.flatten(F.transform(statements, lambda s: _sql_refs(s, "", "", exclude_ctes))),
    )
    # A cell without references still gives one row, so that it counts.
    rows = cells.select("path", F.posexplode_outer(found).alias("pos", "ref"))
    full_name = compose_fqn("ref.name.catalog", "ref.name.schema", "ref.name.table")
    entry = F.struct(
        full_name.alias("table"),
        F.col("ref.reference_type").alias("reference_type"),
        F.col("ref.name.catalog").alias("catalog"),
        F.col("ref.name.schema").alias("schema"),
        F.col("ref.name.table").alias("table_name"),
    )
    report = rows.groupBy("path").agg(
        F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("cell_count"),
        F.sort_array(F.collect_set(F.when(full_name != "", entry))).alias("table_references"),
    )
    return report.select(
        "path",
        "cell_count",
        F.size("table_references").cast("bigint").alias("table_reference_count"),
        "table_references",
    )
