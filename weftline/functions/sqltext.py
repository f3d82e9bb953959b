"""What a SQL text touches: statements, tables and columns as column expressions.

Nothing here parses SQL. Comments and literals are blanked, then the text is
read once along its parentheses, which gives every query as a flat text in
which a clause runs from its keyword to the next.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import extract_all, rx, strip

_NAME_PART = r"(?:`[^`]+`|\w+)"
NAME = rf"{_NAME_PART}(?:\s*\.\s*{_NAME_PART})*"

# First keyword of a statement and the name of its kind.
STATEMENT_TYPES = {
    "SELECT": "Select",
    "INSERT": "Insert",
    "CREATE": "Create",
    "MERGE": "Merge",
    "UPDATE": "Update",
    "DELETE": "Delete",
    "DROP": "Drop",
    "ALTER": "Alter",
    "TRUNCATE": "TruncateTable",
    "DESCRIBE": "Describe",
    "DESC": "Describe",
    "USE": "Use",
    "SET": "Set",
    "VALUES": "Values",
    "CACHE": "Cache",
    "UNCACHE": "Uncache",
    "REFRESH": "Refresh",
    "COMMENT": "Comment",
    "COPY": "Copy",
    "GRANT": "Grant",
    "ANALYZE": "Analyze",
    "SHOW": "Command",
    "OPTIMIZE": "Command",
    "EXPLAIN": "Command",
    "VACUUM": "Command",
    "CALL": "Command",
}
SET_OPERATIONS = {"UNION": "Union", "INTERSECT": "Intersect", "EXCEPT": "Except"}
# Keywords that can follow a table name and are no alias.
AFTER_TABLE = (
    "AS ON USING JOIN INNER LEFT RIGHT FULL CROSS SEMI ANTI NATURAL OUTER WHERE GROUP ORDER HAVING LIMIT "
    "UNION INTERSECT EXCEPT MINUS WHEN SET SELECT VALUES LATERAL TABLESAMPLE PIVOT UNPIVOT WINDOW QUALIFY "
    "CLUSTER DISTRIBUTE SORT VERSION TIMESTAMP FOR WITH FROM INTO PARTITION OFFSET VIEW REPLACE LOCATION"
).split()

def blank_literals(sql: Column) -> Column:
    """Comments become a blank, literals an empty literal; back-ticked names stay."""
    no_escapes = F.regexp_replace(sql, r"""\\['"\\]""", "")
    no_comments = F.regexp_replace(
        no_escapes,
        rx(r"""('[^']*(?:'|\z)|"[^"]*(?:"|\z)|`[^`]*`)|--[^\n]*|/\*(?s:.*?)(?:\*/|\z)"""),
        "$1 ",
    )
    marked = F.regexp_replace(no_comments, rx(r"""(`[^`]*`)|'[^']*(?:'|\z)|"[^"]*(?:"|\z)"""), "$1''")
    # The mark belongs to literals, not to back-ticked names.
    blanked = F.regexp_replace(marked, rx(r"(`[^`]*`)''"), "$1")
    return F.when(sql.rlike(r"""['"`]|--|/\*"""), blanked).otherwise(sql)


def clean_sql(sql: Column) -> Column:
    """Blanked text without the ``FROM`` of comparisons and of EXTRACT.

    Other functions keep the ``FROM`` between their arguments until
    ``_peel`` meets them as innermost parentheses.
    """
    text = blank_literals(sql)
    plain = F.regexp_replace(text, rx(r"\bIS\s+(?:NOT\s+)?DISTINCT\s+FROM\b", "i"), "= ")
    plain = F.regexp_replace(plain, rx(r"\bEXTRACT\s*\(\s*\w+\s+FROM\b", "i"), "extract( ")
    plain = F.regexp_replace(plain, rx(r"\bTRIM\s*\(\s*(?:BOTH|LEADING|TRAILING)\b", "i"), "trim(")
    return F.when(text.rlike(r"(?i)DISTINCT|EXTRACT|TRIM"), plain).otherwise(text)


def split_statements(sql: Column) -> Column:
    """The non-empty statements of a text, cleaned, in order."""
    pieces = F.transform(F.split(clean_sql(sql), ";", -1), strip)
    return F.filter(pieces, lambda s: s != "")


def first_keyword(statement: Column) -> Column:
    """The verb of a statement; after a ``WITH`` list it is the main verb."""
    word = F.upper(F.regexp_extract(statement, rx(r"\A[\s(]*(\w+)"), 1))
    after_list = F.upper(F.regexp_extract(statement, rx(r"\)\s*(SELECT|INSERT|MERGE|UPDATE|DELETE)\b", "i"), 1))
    # FROM may come first, before the INSERT or SELECT it feeds.
    fed = F.upper(F.regexp_extract(statement, rx(r"\b(INSERT|SELECT)\b", "i"), 1))
    return (
        F.when((word == "WITH") & (after_list == ""), "SELECT")
        .when(word == "WITH", after_list)
        .when((word == "FROM") & (fed == ""), "SELECT")
        .when(word == "FROM", fed)
        .when(word == "REPLACE", "CREATE")
        .otherwise(word)
    )


def statement_type(statement: Column) -> Column:
    """Kind of a cleaned statement, null when the verb is not known.

    A query whose outermost level holds a set operation is named after the
    last such operation.
    """
    pairs = [F.lit(x) for pair in STATEMENT_TYPES.items() for x in pair]
    kind = F.try_element_at(F.create_map(*pairs), first_keyword(statement))
    words = F.regexp_extract_all(statement, F.lit(rx(r"[()]|\b(?:UNION|INTERSECT|EXCEPT)\b", "i")), 0)
    start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("string").alias("op"))

    def read(state: Column, token: Column) -> Column:
        step = F.when(token == "(", 1).when(token == ")", -1).otherwise(0)
        names = [F.lit(x) for pair in SET_OPERATIONS.items() for x in pair]
        op = F.when((state["depth"] == 0) & (step == 0), F.create_map(*names)[F.upper(token)]).otherwise(state["op"])
        return F.struct((state["depth"] + step).alias("depth"), op.alias("op"))

    outermost = F.aggregate(words, start, read, lambda s: s["op"])
    is_set_query = (kind == "Select") & statement.rlike(rx(r"\b(?:UNION|INTERSECT|EXCEPT)\b", "i"))
    return F.when(is_set_query, F.coalesce(outermost, kind)).otherwise(kind)


def name_parts(name: Column) -> Column:
    """Parts of a dotted name; back-ticks shield the dots inside them."""
    parts = F.regexp_extract_all(name, F.lit(_NAME_PART), 0)
    return F.transform(parts, lambda p: F.regexp_replace(p, "`", ""))


_INSERT_TARGET = rf"\bINSERT\s+(?:INTO|OVERWRITE)\s+(?:TABLE\s+)?(?!TABLE\b|DIRECTORY\b|LOCAL\b)({NAME})"
_CREATE_TARGET = (
    r"(?:\bCREATE\s+(?:OR\s+(?:REPLACE|REFRESH)\s+)?|\A\s*REPLACE\s+)"
    r"(?:(?:GLOBAL|TEMP|TEMPORARY|EXTERNAL|MATERIALIZED|STREAMING|LIVE|DELTA)\s+)*"
    rf"(?:TABLE|VIEW)\s+(?:IF\s+NOT\s+EXISTS\s+)?(?!IF\b)({NAME})"
)
_MERGE_TARGET = rf"\bMERGE\s+(?:WITH\s+SCHEMA\s+EVOLUTION\s+)?INTO\s+({NAME})"
_PLAIN_TARGET = (
    r"\A\s*(?:UPDATE|COPY\s+INTO|TRUNCATE\s+TABLE|DROP\s+(?:TABLE|VIEW)(?:\s+IF\s+EXISTS)?"
    r"|ALTER\s+(?:TABLE|VIEW)|DESC(?:RIBE)?\s+(?:TABLE\s+)?(?:EXTENDED\s+|FORMATTED\s+)?)\s+"
    rf"(?!TABLE\b|IF\b)({NAME})"
)
_COPY_SOURCE = rf"\A\s*CREATE\b[^()]*?\b(?:LIKE|CLONE)\s+({NAME})"

_QUERY_START = r"\s*(?:SELECT|WITH|FROM|VALUES)\b"
# Stands for a parenthesis that was peeled off; ⟨ ⟩ enclose one kept in place.
_HOLE = " ~ "


# How far before a parenthesis its own word is looked for.
_BEFORE = 200


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _peel(statement: Column, keep_plain: bool) -> Column:
    """The flat texts of a statement: each inner query, then what is left.

    With ``keep_plain`` a parenthesis that holds no query stays in its text,
    between ⟨ and ⟩; without, it goes too, and those that hold a nested join are
    handed out like queries.

    The text is cut at its parentheses once and read from left to right with a
    stack of the texts that are open; a closing parenthesis takes the innermost
    one off and looks at it alone, so every character is matched once, at any
    depth. A parenthesis without a partner is a sign like any other.
    """
    nothing = F.array().cast("array<string>")
    is_query = rx(rf"\A{_QUERY_START}", "i")

    def closed(inner: Column, before: Column) -> Column:
        """What is handed out, and what stands in the text around in place of the parenthesis."""
        text = F.when(
            before.rlike(rx(r"\b(?:TRIM|SUBSTR|SUBSTRING|OVERLAY)\s*\z", "i")),
            F.regexp_replace(inner, rx(r"\A([\s\S]*?)\bFROM\b", "i"), "$1,"),
        ).otherwise(inner)

        def judged(text: Column) -> Column:
            if not keep_plain:
                out = F.when(text.rlike(rx(r"\b(?:FROM|JOIN)\b", "i")), F.array(text)).otherwise(nothing)
                return F.struct(out.alias("out"), F.lit(_HOLE).alias("left"))
            # The ORDER BY of a window ends with its parenthesis, not with a clause.
            ordered = F.regexp_replace(text, rx(r"\A([\s\S]*?)\bORDER\s+BY\b([\s\S]*)\z", "i"), "$1 ⦃ $2 ⦄")
            plain = F.when(before.rlike(rx(r"\bOVER\s*\z", "i")), ordered).otherwise(text)
            return F.when(
                text.rlike(is_query), F.struct(F.array(text).alias("out"), F.lit(_HOLE).alias("left"))
            ).otherwise(F.struct(nothing.alias("out"), F.concat(F.lit("⟨"), plain, F.lit("⟩")).alias("left")))

        return _bound(text, judged)

    def read(state: Column, token: Column) -> Column:
        open_texts, depth = state["open"], F.size(state["open"])
        last = F.element_at(open_texts, -1)
        grown = F.struct(
            F.concat(F.slice(open_texts, 1, depth - 1), F.array(F.concat(last, token))).alias("open"),
            state["out"].alias("out"),
        )
        deeper = F.struct(F.concat(open_texts, F.array(F.lit(""))).alias("open"), state["out"].alias("out"))

        def shallower(around: Column) -> Column:
            return _bound(
                closed(last, F.substring(around, -_BEFORE, _BEFORE)),
                lambda c: F.struct(
                    F.concat(F.slice(open_texts, 1, depth - 2), F.array(F.concat(around, c["left"]))).alias("open"),
                    F.concat(state["out"], c["out"]).alias("out"),
                ),
            )

        return (
            F.when(token == "(", deeper)
            .when((token == ")") & (depth > 1), _bound(F.element_at(open_texts, -2), shallower))
            .otherwise(grown)
        )

    # Parentheses without a letter, as long lists of values have them, need no stack.
    short = F.regexp_replace(statement, r"\(([^()`_\p{L}]*)\)", "⟨$1⟩" if keep_plain else _HOLE)
    tokens = F.regexp_extract_all(short, F.lit(r"[()]|[^()]+"), F.lit(0))
    start = F.struct(F.array(F.lit("")).alias("open"), nothing.alias("out"))
    flat = F.aggregate(tokens, start, read, lambda s: F.concat(s["out"], F.array(F.array_join(s["open"], "("))))
    return F.when(statement.contains("("), flat).otherwise(F.array(statement))


_FROM_ENDS = (
    r"\b(?:SELECT|WHERE|GROUP|ORDER|HAVING|LIMIT|UNION|INTERSECT|EXCEPT|MINUS|LATERAL|WINDOW|QUALIFY|"
    r"CLUSTER|DISTRIBUTE|SORT|SET|WHEN|INSERT|FROM)\b"
)
_NO_TABLE = r"(?!(?:SELECT|VALUES|LATERAL|TABLE|WITH|FROM)\b)"
_ALIAS = rf"\A\s*{NAME}\s+(?:AS\s+)?({_NAME_PART})"


def read_tables(statement: Column) -> Column:
    """Names read by FROM, JOIN, comma lists and MERGE … USING.

    ``array<struct<name, alias>>``, inner queries first.
    """
    # A single table in parentheses needs none.
    bare = F.regexp_replace(statement, rx(rf"\b(FROM|JOIN)\s*\(\s*({NAME})\s*\)", "i"), "$1 $2")

    def items(flat: Column) -> Column:
        """Texts that start with a table: list items, joined tables."""
        words = F.regexp_extract_all(flat, F.lit(rx(_FROM_ENDS, "i")), 0)
        bodies = F.slice(F.split(flat, rx(_FROM_ENDS, "i"), -1), 2, 1 << 30)
        clauses = F.filter(
            F.arrays_zip(words.alias("word"), bodies.alias("body")),
            lambda c: F.upper(c["word"]).isin("FROM", "LATERAL"),
        )

        def tables(clause: Column) -> Column:
            listed = F.split(clause["body"], rx(r",|\bJOIN\b", "i"), -1)
            joined = F.slice(F.split(clause["body"], rx(r"\bJOIN\b", "i"), -1), 2, 1 << 30)
            return F.when(F.upper(clause["word"]) == "FROM", listed).otherwise(joined)

        is_nested_join = ~flat.rlike(rx(r"\b(?:SELECT|FROM)\b", "i"))
        return F.when(is_nested_join, F.split(flat, rx(r",|\bJOIN\b", "i"), -1)).otherwise(
            F.flatten(F.transform(clauses, tables))
        )

    def as_table(item: Column) -> Column:
        alias = F.regexp_extract(item, rx(_ALIAS, "i"), 1)
        return F.struct(
            F.regexp_extract(item, rx(rf"\A\s*(?:ONLY\s+)?{_NO_TABLE}({NAME})", "i"), 1).alias("name"),
            F.when((alias != "") & ~F.upper(alias).isin(AFTER_TABLE), F.regexp_replace(alias, "`", "")).alias("alias"),
        )

    flats = F.filter(_peel(bare, keep_plain=False), lambda t: t.rlike(rx(r"\b(?:FROM|JOIN)\b", "i")))
    merged = F.when(
        statement.rlike(rx(r"\bMERGE\b", "i")),
        F.regexp_extract_all(bare, F.lit(rx(rf"\bUSING\s+({NAME}(?:\s+(?:AS\s+)?{_NAME_PART})?)(?!\s*[(.])", "i")), 1),
    ).otherwise(F.array().cast("array<string>"))
    found = F.concat(merged, F.flatten(F.transform(flats, items)))
    # A name before a hole is a function; one glued to other text is a fragment.
    tables = F.filter(found, lambda i: i.rlike(rx(rf"\A\s*(?:ONLY\s+)?{_NO_TABLE}{NAME}(?!\s*[~.])", "i")) & ~i.rlike(
        rx(rf"\A\s*{NAME}\s*~")
    ))
    nothing = F.array().cast("array<struct<name:string,alias:string>>")
    worth_it = statement.rlike(rx(r"\b(?:FROM|JOIN|USING)\b", "i")) & ~statement.rlike(
        rx(r"\A\s*(?:SHOW|GRANT|DESC|DESCRIBE)\b", "i")
    )
    return F.when(worth_it, F.transform(tables, as_table)).otherwise(nothing)


def write_targets(statement: Column, verb: Column) -> Column:
    """Names of INSERT, CREATE and MERGE targets."""
    found = F.concat(
        extract_all(statement, _INSERT_TARGET, "i"),
        extract_all(statement, _CREATE_TARGET, "i"),
        extract_all(statement, _MERGE_TARGET, "i"),
    )
    return F.when(verb.isin("INSERT", "CREATE", "MERGE"), found).otherwise(F.array().cast("array<string>"))


def cte_names(statement: Column) -> Column:
    """Names defined by a WITH list."""
    names = extract_all(statement, rf"(?:\bWITH\s+(?:RECURSIVE\s+)?|,\s*)({_NAME_PART})(?:\s*\([^()]*\))?\s+AS\s*\(", "i")
    return F.when(
        statement.rlike(rx(r"\bWITH\b", "i")), F.transform(names, lambda n: F.lower(F.regexp_replace(n, "`", "")))
    ).otherwise(F.array().cast("array<string>"))


REF_TYPE = "array<struct<parts:array<string>,alias:string,reference_type:string>>"


def table_refs_of(statement: Column, exclude_ctes: bool = False, verb: Column | None = None) -> Column:
    """All tables of a cleaned statement as ``array<struct<parts, alias, reference_type>>``.

    ``verb`` is the statement's first keyword, if the caller has it at hand.
    The target of INSERT, CREATE and MERGE is written, every other table is
    read; a table both written and read by one statement is written only.
    """
    verb = first_keyword(statement) if verb is None else verb

    def as_ref(parts: Column, alias: Column, kind: str) -> Column:
        return F.struct(parts.alias("parts"), alias.alias("alias"), F.lit(kind).alias("reference_type"))

    no_alias = F.lit(None).cast("string")
    others = F.when(
        ~verb.isin("SELECT", "INSERT", "MERGE", "DELETE"),
        F.concat(extract_all(statement, _PLAIN_TARGET, "i"), extract_all(statement, _COPY_SOURCE, "i")),
    ).otherwise(F.array().cast("array<string>"))
    reads = F.concat(
        F.transform(others, lambda n: as_ref(name_parts(n), no_alias, "reads_from")),
        F.transform(read_tables(statement), lambda t: as_ref(name_parts(t["name"]), t["alias"], "reads_from")),
    )
    if exclude_ctes:
        ctes = cte_names(statement)
        reads = F.filter(
            reads, lambda r: ~((F.size(r["parts"]) == 1) & F.array_contains(ctes, F.lower(F.element_at(r["parts"], 1))))
        )

    def with_targets(targets: Column) -> Column:
        names = F.transform(targets, lambda p: F.array_join(p, "."))
        only_read = _bound(names, lambda n: F.filter(reads, lambda r: ~F.array_contains(n, F.array_join(r["parts"], "."))))
        return F.concat(F.transform(targets, lambda p: as_ref(p, no_alias, "writes_to")), only_read)

    # The targets are found once, not again for every table that is read.
    refs = _bound(F.transform(write_targets(statement, verb), name_parts), with_targets)
    return F.when(verb.isin(list(STATEMENT_TYPES)), refs).otherwise(F.array().cast(REF_TYPE))


# Clause keywords, and the context of a column that follows one.
CLAUSES = {
    "SELECT": "select",
    "HAVING": "select",
    "QUALIFY": "select",
    "LIMIT": "select",
    "LATERAL": "select",
    "WHERE": "where",
    "ON": "join",
    "GROUP": "group_by",
    "ORDER": "order_by",
    "SORT": "order_by",
    "CLUSTER": "order_by",
    "DISTRIBUTE": "order_by",
    "SET": "unknown",
    "MATCHED": "unknown",
    "FROM": "table",
    "JOIN": "table",
    "INTO": "table",
    "TABLE": "table",
    "VIEW": "table",
    "UPDATE": "table",
    "OVERWRITE": "table",
    "USING": "table",
    "UNION": "table",
    "INTERSECT": "table",
    "EXCEPT": "table",
}
_CLAUSE_WORDS = "|".join(k for k in CLAUSES if k not in ("MATCHED", "UPDATE", "VIEW"))
_CLAUSE = (
    rf"\b(?:{_CLAUSE_WORDS}|(?<!LATERAL )VIEW|UPDATE(?!\s+SET\b)|WHEN(?=\s+(?:NOT\s+)?MATCHED\b))\b"
)
# Words that join or modify values, and words that are values.
_OPERATOR_WORDS = "|".join(
    (
        "AND OR NOT IN IS LIKE ILIKE RLIKE BETWEEN CASE WHEN THEN ELSE DISTINCT ALL ANY SOME EXISTS BY ASC DESC NULLS "
        "FIRST LAST ROWS RANGE PRECEDING FOLLOWING UNBOUNDED CURRENT ROW PARTITION ESCAPE INTERVAL MATCHED INSERT "
        "UPDATE DELETE SET VALUES OVER FILTER WITHIN IGNORE RESPECT ROLLUP CUBE GROUPING SETS DIV LEFT RIGHT FULL INNER "
        "OUTER CROSS SEMI ANTI NATURAL VIEW"
    ).split()
)
_VALUE_WORDS = "NULL|TRUE|FALSE|END|CURRENT_DATE|CURRENT_TIMESTAMP"
_COLUMN = rf"(?:\A|[^\w`'~⟩\s.])\s*(?!\d)({NAME}(?:\s*\.\s*\*)?)(?![\w`.]|\s*[⟨'.])"


def _names_in(text: Column) -> Column:
    """Columns of a clause's text: no keywords, functions, types or aliases."""
    t = F.regexp_replace(text, rx(r"\b(?:DATE|TIMESTAMP|INTERVAL)\s*''", "i"), _HOLE)
    t = F.regexp_replace(t, rx(rf"\bAS\s+{NAME}", "i"), _HOLE)
    t = F.regexp_replace(t, rx(rf"\b(?:{_VALUE_WORDS})\b(?!\s*[.⟨])", "i"), _HOLE)
    t = F.regexp_replace(t, rx(rf"(?<!\.)\b(?:{_OPERATOR_WORDS})\b(?!\s*\.)(?!⟨)", "i"), " ; ")
    return F.regexp_extract_all(t, F.lit(rx(_COLUMN)), 1)


def column_refs_of(statement: Column) -> Column:
    """Columns of a cleaned statement with the clause nearest around each.

    ``array<struct<qualifier, column, context>>``, inner queries first, repeats
    kept. A parenthesis without a query of its own belongs to the clause it
    stands in, but for the ORDER BY of a window.
    """
    in_merge = statement.rlike(rx(r"\A\s*(?:WITH\b[\s\S]*)?\bMERGE\b", "i"))
    windows = F.regexp_replace(statement, rx(r"\bWITHIN\s+GROUP\b", "i"), "OVER")
    single = F.regexp_replace(windows, rx(r"\bLATERAL\s+VIEW\b", "i"), "LATERAL VIEW")
    texts = _peel(single, keep_plain=True)

    def of_text(text: Column, outermost: Column) -> Column:
        words = F.regexp_extract_all(text, F.lit(rx(_CLAUSE, "i")), 0)
        bodies = F.slice(F.split(text, rx(_CLAUSE, "i"), -1), 2, 1 << 30)
        clauses = F.filter(
            F.arrays_zip(words.alias("word"), bodies.alias("body")),
            lambda c: c["body"].isNotNull(),
        )

        def context(word: Column) -> Column:
            upper = F.upper(word)
            pairs = [F.lit(x) for pair in CLAUSES.items() for x in pair]
            return (
                F.when((upper == "ON") & in_merge & outermost, "unknown")
                .when(upper == "WHEN", "unknown")
                .otherwise(F.try_element_at(F.create_map(*pairs), upper))
            )

        def columns(clause: Column) -> Column:
            own = context(clause["word"])
            body = clause["body"]
            # A comma list of tables after a join condition, and what a lateral view is called.
            body = F.when(
                F.upper(clause["word"]) == "ON",
                F.regexp_replace(body, rx(rf"(?:,\s*{NAME}(?:\s+(?:AS\s+)?\w+)?\s*)+\z", "i"), ""),
            ).when(F.upper(clause["word"]) == "LATERAL", F.regexp_replace(body, r"⟩[^⟨⟩]*\z", "⟩")).otherwise(body)
            ordered = F.flatten(
                F.transform(F.regexp_extract_all(body, F.lit(r"⦃([^⦄]*)⦄"), 1), _names_in)
            )
            plain = _names_in(F.regexp_replace(body, r"⦃[^⦄]*⦄", " ; "))

            def named(where: Column):
                return lambda n: F.struct(n.alias("name"), where.alias("context"))

            hits = F.concat(F.transform(plain, named(own)), F.transform(ordered, named(F.lit("order_by"))))
            return F.when(own != "table", hits).otherwise(
                F.array().cast("array<struct<name:string,context:string>>")
            )

        return F.flatten(F.transform(clauses, columns))

    def as_column(hit: Column) -> Column:
        starred = hit["name"].endswith("*")
        parts = name_parts(hit["name"])
        parts = F.when(starred, F.concat(parts, F.array(F.lit("*")))).otherwise(parts)
        return F.struct(
            F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit("")).alias("qualifier"),
            F.element_at(parts, -1).alias("column"),
            hit["context"].alias("context"),
        )

    hits = F.flatten(F.transform(texts, lambda t, i: of_text(t, i == F.size(texts) - 1)))
    nothing = F.array().cast("array<struct<qualifier:string,column:string,context:string>>")
    return F.when(first_keyword(statement).isin(list(STATEMENT_TYPES)), F.transform(hits, as_column)).otherwise(nothing)
