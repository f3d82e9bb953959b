"""Secrets in texts, found through a trigram index and proved by each rule's pattern."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import materialize

#: Alternatives that one part of a pattern may unfold into before it counts as unknown.
MOST_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` in the common part of Java's and Python's syntax; group ``checked`` (0: all) needs ``least`` characters."""

    kind: str
    pattern: str
    checked: int = 0
    least: int = 1
    base: bool = False


RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        checked=2,
        least=6,
        base=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, base=True),
    # A run of 24 or more is the whole run, so shorter ones need not be cut out first.
    Rule("hex", r"[0-9a-f]{24,}", least=24, base=True),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{24,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

#: All of some clauses; a clause holds if all trigrams of one of its alternatives occur.
Query = list[list[frozenset[str]]]


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _clause(texts: set[str]) -> Query:
    parts = {_trigrams(t) for t in texts}
    if frozenset() in parts:
        return []  # one alternative asks for nothing
    return [sorted((p for p in parts if not any(q < p for q in parts)), key=sorted)]


def _unfold(items) -> tuple[set[str] | None, Query]:
    """The texts that a parsed pattern can be, if they are few, else None; and the clauses that hold wherever it matches."""
    known: set[str] = {""}
    whole, clauses = True, []

    def close() -> None:
        nonlocal known, whole
        clauses.extend(_clause(known))
        known, whole = {""}, False

    for kind, value in items:
        name = str(kind)
        options: set[str] | None = None
        inner: Query = []
        if name == "LITERAL":
            options = {chr(value).lower()}
        elif name == "IN" and all(str(k) == "LITERAL" for k, _ in value):
            options = {chr(v).lower() for _, v in value}
        elif name == "SUBPATTERN":
            options, inner = _unfold(value[3])
        elif name == "BRANCH":
            branches = [_unfold(b) for b in value[1]]
            if all(texts is not None for texts, _ in branches):
                options = set().union(*[texts for texts, _ in branches])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, body = value
            texts, found = _unfold(body)
            if texts is not None and most <= 4 and len(texts) ** int(most) <= MOST_ALTERNATIVES:
                options = {"".join(p) for n in range(least, int(most) + 1) for p in product(texts, repeat=n)}
            elif least:
                inner = found or (_clause(texts) if texts else [])
        if options is not None and len(known) * len(options) <= MOST_ALTERNATIVES:
            known = {a + b for a in known for b in options}
            continue
        close()
        clauses.extend(inner)
        if options is not None:
            clauses.extend(_clause(options))
    if whole:
        return known, clauses
    clauses.extend(_clause(known))
    return None, clauses


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of a pattern, in lower case; empty if any text may match."""
    texts, clauses = _unfold(re._parser.parse(pattern))
    return clauses + (_clause(texts) if texts is not None else [])


def _text_id() -> Column:
    return F.xxhash64("text")


def trigram_index(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, text_id) of the wanted trigrams in ``texts`` (text_id, text), stored in order of the trigrams.

    Letters count as lower case. Equal texts share one id, so copies share
    their postings.
    """
    wanted = F.array(*[F.lit(t) for t in trigrams])
    present = F.transform(F.array(F.lower("text")), lambda low: F.filter(wanted, lambda t: F.contains(low, t)))[0]
    postings = texts.select("text_id", F.explode(present).alias("trigram")).distinct()
    return materialize(postings.select("trigram", "text_id").sortWithinPartitions("trigram"), "postings")


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """text_id and ``kinds``, the rules whose query its postings satisfy."""
    trigrams = sorted({t for query in queries.values() for clause in query for option in clause for t in option})
    held = (
        index.filter(F.col("trigram").isin(trigrams)).groupBy("text_id").agg(F.collect_set("trigram").alias("_held"))
    )  # a text has no more postings than there are wanted trigrams

    def holds(query: Query) -> Column:
        out = F.lit(True)
        for clause in query:
            met = F.lit(False)
            for option in clause:
                met = met | (F.size(F.array_intersect("_held", F.array(*[F.lit(t) for t in sorted(option)]))) == len(option))
            out = out & met
        return out

    kinds = F.array_compact(F.array(*[F.when(holds(query), F.lit(kind)) for kind, query in queries.items()]))
    return held.select("text_id", kinds.alias("kinds")).filter(F.size("kinds") > 0)


def _spans(rule: Rule, place: int) -> Column:
    """All matches of one rule as structs (start, kind, end), in code points.

    The text is cut at the matches; what lies before a match, and the matches
    before it, give its start.
    """
    pattern = F.lit(rule.pattern)
    between = F.split("text", rule.pattern, -1)
    matches = F.regexp_extract_all("text", pattern, F.lit(0))
    checked = F.regexp_extract_all("text", pattern, F.lit(rule.checked)) if rule.checked else matches
    cut = F.arrays_zip(between.alias("before"), matches.alias("match"), checked.alias("checked"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def step(held: Column, one: Column) -> Column:
        begin = held["at"] + F.length(one["before"])
        end = (begin + F.coalesce(F.length(one["match"]), F.lit(0))).cast("int")
        span = F.struct(begin.cast("int").alias("start"), F.lit(place).alias("kind"), end.alias("end"))
        good = F.coalesce(F.length(one["checked"]) >= rule.least, F.lit(False))
        found = F.when(good, F.concat(held["found"], F.array(span))).otherwise(held["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    return F.when(F.col("text").rlike(rule.pattern), F.aggregate(cut, start, step)["found"]).otherwise(empty)


def find_secrets(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``documents`` (with a column text) and ``found``: its spans (start, kind, end), sorted; kind counts ``rules`` from 0.

    Rules whose pattern has mandatory trigrams are tried on the texts only
    that the index yields; the others read every text. Matches of one rule do
    not overlap, the leftmost counts; offsets are code points, the end
    exclusive. A null text counts as empty; repeated rows get the same spans; a column ``found`` is replaced.
    """
    rows = documents.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_text_id", _text_id())
    queries = {rule.kind: query for rule in rules if (query := trigram_query(rule.pattern))}
    if queries:
        trigrams = sorted({t for query in queries.values() for clause in query for option in clause for t in option})
        index = trigram_index(rows.select(F.col("_text_id").alias("text_id"), "text"), trigrams)
        kinds = candidates(index, queries).select(F.col("text_id").alias("_text_id"), F.col("kinds").alias("_kinds"))
        rows = rows.join(materialize(kinds, "candidates"), "_text_id", "left")
    else:
        rows = rows.withColumn("_kinds", F.lit(None).cast("array<string>"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    parts = []
    for place, rule in enumerate(rules):
        spans = _spans(rule, place)
        if rule.kind in queries:
            asked = F.coalesce(F.array_contains("_kinds", rule.kind), F.lit(False))
            spans = F.when(asked, spans).otherwise(empty)
        parts.append(spans)
    return rows.withColumn("found", F.array_sort(F.concat(*parts))).drop("_text_id", "_kinds")


def written(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op7_trigram_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(documents).select("doc_id", "found")
    n_base = sum(rule.base for rule in RULES)

    def count(place: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == place)).cast("long")

    return found.select(
        "doc_id",
        *[count(place).alias(f"n_{RULES[place].kind}") for place in range(n_base)],
        F.sha2(written(F.filter("found", lambda s: s["kind"] < n_base)), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"),
    )


QUERIES = {"op7_trigram_secrets": op7_trigram_secrets}
