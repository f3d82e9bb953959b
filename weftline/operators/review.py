"""Code review: the rules over every cell in one narrow pass."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import rx
from weftline.operators.rules import CATEGORIES, DEFAULT_RULES, SEVERITIES, Rule

SNIPPET_CONTEXT = 2
SNIPPET_LINES = 5


def _matches(rule: Rule, content: Column, lowered: Column) -> Column:
    """Cell type first, then the cheap search for hints, then the patterns."""
    pattern = rx(rule.pattern, rule.flags)
    if rule.at_least > 1:
        hit = F.regexp_count(content, F.lit(pattern)) >= rule.at_least
    else:
        hit = content.rlike(pattern)
    for exception in rule.unless:
        hit = hit & ~content.rlike(rx(exception, rule.flags))
    if rule.hints:
        text = lowered if "i" in rule.flags else content
        hit = reduce(or_, [text.contains(h) for h in rule.hints]) & hit
    if rule.cell_types is not None:
        hit = F.col("cell_type").isin(*rule.cell_types) & hit
    return hit


def match_line(content: Column, pattern: str) -> Column:
    """Zero-based line on which the first match starts."""
    before = F.element_at(F.split(content, pattern, 2), 1)
    return F.size(F.split(before, "\r\n|\r|\n", -1)) - 1


def snippet(
    content: Column, line: Column, context: int = SNIPPET_CONTEXT, max_lines: int = SNIPPET_LINES
) -> Column:
    """The line with its neighbours, at most ``max_lines`` of them."""
    lines = F.split(content, "\r\n|\r|\n", -1)
    first = F.greatest(line - context, F.lit(0))
    last = F.least(line + context + 1, F.size(lines))
    return F.array_join(F.slice(lines, first + 1, F.least(last - first, F.lit(max_lines))), "\n")


def _wanted(categories: str | Sequence[str]) -> set[str]:
    if categories == "all":
        return set(CATEGORIES)
    if isinstance(categories, str):
        categories = categories.split(",")
    return {c.strip().lower() for c in categories}


def review(
    cells: DataFrame, categories: str | Sequence[str] = "all", rules: Sequence[Rule] = DEFAULT_RULES
) -> DataFrame:
    """One row per cell and rule that fires.

    ``cells(path, cell_index, cell_type, content)`` plus any further columns
    are taken along; markdown is skipped. ``rule_pos`` is the rule's place in
    the registry. Works on a stream as it stands.
    """
    wanted = _wanted(categories)
    chosen = [r for r in rules if r.category in wanted]
    keys = [c for c in cells.columns if c not in ("cell_type", "content", "language")]
    content = F.col("content")
    empty = "array<struct<rule_pos:int,line:int>>"
    hits = [
        F.when(
            _matches(rule, content, F.col("lowered")),
            F.struct(
                F.lit(pos).alias("rule_pos"), match_line(content, rx(rule.pattern, rule.flags)).alias("line")
            ),
        )
        for pos, rule in enumerate(chosen)
    ]
    found = F.array_compact(F.array(*hits)) if hits else F.array().cast(empty)
    rows = cells.where(F.col("cell_type") != "markdown").withColumn("lowered", F.lower(content))
    rows = rows.select(*keys, "content", F.explode(found).alias("hit"))
    rows = rows.select(*keys, "content", "hit.*")

    def of_rule(values: list[str]) -> Column:
        texts = F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")
        return F.try_element_at(texts, F.col("rule_pos") + 1)

    message = of_rule([r.message for r in chosen])
    for pos, rule in enumerate(chosen):
        if "{n}" in rule.message:
            n = F.regexp_count(content, F.lit(rx(rule.pattern, rule.flags))).cast("string")
            message = F.when(F.col("rule_pos") == pos, F.replace(message, F.lit("{n}"), n)).otherwise(message)
    return rows.select(
        *keys,
        "rule_pos",
        of_rule([r.rule_id for r in chosen]).alias("rule_id"),
        of_rule([r.category for r in chosen]).alias("category"),
        of_rule([r.severity for r in chosen]).alias("severity"),
        message.alias("message"),
        of_rule([r.suggestion for r in chosen]).alias("suggestion"),
        snippet(content, F.col("line")).alias("code_snippet"),
    )


def severity_rank(level: Column) -> Column:
    rank = F.lit(len(SEVERITIES))
    for i, name in enumerate(SEVERITIES):
        rank = F.when(level == name, i).otherwise(rank)
    return rank


def review_report(
    cells: DataFrame, categories: str | Sequence[str] = "all", rules: Sequence[Rule] = DEFAULT_RULES
) -> DataFrame:
    """One row per notebook: counts and the findings, worst first.

    A notebook's list is bounded by its own cells times the number of rules.
    """
    entry = F.struct(
        severity_rank(F.col("severity")).alias("rank"),
        "cell_index",
        "rule_pos",
        "rule_id",
        "category",
        "severity",
        "message",
        "suggestion",
        "code_snippet",
    )
    level = F.col("severity")
    per_notebook = (
        review(cells, categories, rules)
        .groupBy("path")
        .agg(
            F.count(F.lit(1)).alias("total_findings"),
            F.sort_array(F.collect_list(entry)).alias("findings"),
            *[F.count_if(level == s).alias(f"n_{s}") for s in SEVERITIES],
        )
    )
    pairs = [x for s in SEVERITIES for x in (F.lit(s), F.col(f"n_{s}"))]
    counts = F.map_filter(F.create_map(*pairs), lambda _, n: n > 0)
    findings = F.transform("findings", lambda f: f.dropFields("rank", "rule_pos"))
    per_notebook = per_notebook.select(
        "path", "total_findings", counts.alias("severity_counts"), findings.alias("findings")
    )
    schema = per_notebook.schema
    all_cells = cells.groupBy("path").agg(F.count(F.lit(1)).alias("cell_count"))
    return all_cells.join(per_notebook, "path", "left").select(
        "path",
        "cell_count",
        F.coalesce("total_findings", F.lit(0)).alias("total_findings"),
        F.coalesce("severity_counts", F.create_map().cast(schema["severity_counts"].dataType)).alias(
            "severity_counts"
        ),
        F.array(*[F.lit(c) for c in sorted(_wanted(categories))]).alias("categories_checked"),
        F.coalesce("findings", F.array().cast(schema["findings"].dataType)).alias("findings"),
    )
