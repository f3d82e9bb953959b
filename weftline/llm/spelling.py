"""Spelling variants: words of a corpus that are one edit apart, and the usual form of each.

A word's letters are a multiset, that is a binary vector with a dimension for
each letter and how often it has occurred so far. One inserted or deleted
letter changes one dimension; one replaced letter changes two, one that only
the one word has and one that only the other has. Partition and enumerate:
each dimension is a part, and a signature is a word's vector without one of
its own dimensions (or all of it, as the shorter word of an insertion). Two
words that are near share such a signature, and they also share the half of
their letters that the edit leaves alone, which is why that half is written in
order and only the other half as a multiset. Signatures are joined by equality
and the candidates verified by their edit distance.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import materialize

LEAST_LETTERS = 7
LEAST_COUNT = 2
#: How many times as frequent as a word its form is at least.
RATIO = 10
#: A run whose checksum this divides loses a letter.
THINNED = 31
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def word_counts(documents: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of all whole texts of ``documents`` (doc_id, text).

    Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z in lower
    case; a run whose crc32 of ``<doc_id>:<run>`` is a multiple of 31 loses the
    letter at that number modulo its length. Null texts have no words, a null
    doc_id counts as empty, repeated rows each count, other columns are ignored.
    """
    lower = F.translate(F.col("text"), _UPPER, _UPPER.lower())
    pattern = F.lit("[a-z\\u00C0-\\u00FF]{" + str(least_letters) + ",}")
    runs = documents.filter("text is not null").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_doc"),
        F.explode(F.regexp_extract_all(lower, pattern, F.lit(0))).alias("_run"),
    )
    runs = runs.withColumn("_crc", F.crc32(F.concat("_doc", F.lit(":"), "_run")))
    at = F.pmod("_crc", F.length("_run")).cast("int")
    thinned = F.concat(F.substring("_run", 1, at), F.substring("_run", at + 2, F.length("_run")))
    words = runs.select(F.when(F.col("_crc") % THINNED == 0, thinned).otherwise(F.col("_run")).alias("word"))
    return (
        words.filter(F.length("word") >= least_letters)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= least_count)
    )


def _without_one(letters: Column) -> Column:
    """The sorted ``letters`` without one of them, for each different letter."""
    firsts = F.filter(
        F.sequence(F.lit(1), F.size(letters)),
        lambda i: (i == 1) | (F.get(letters, i - 1) != F.get(letters, i - 2)),
    )
    return F.transform(firsts, lambda i: F.concat(F.slice(letters, 1, i - 1), F.slice(letters, i + 1, F.size(letters))))


def _sorted_part(text: Column) -> Column:
    return F.sort_array(F.filter(F.split(text, ""), lambda c: c != ""))


def signatures(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """key, word, n: each word as the longer (or equally long) one of a pair, and as the shorter one."""
    size = F.length("word")

    def keys(longer: Column, shrunk: int, rest) -> Column:
        # The first half is equal, or what follows it; ``longer`` is the longer word's length.
        half = (longer / 2).cast("int")
        front, back = F.substring("word", F.lit(1), half), F.substring("word", half + 1 - shrunk, size)
        return F.concat(
            F.transform(
                rest(_sorted_part(F.substring("word", half + 1, size))),
                lambda r: F.xxhash64(longer, F.lit("front"), front, F.array_join(r, "")),
            ),
            F.transform(
                rest(_sorted_part(F.substring("word", F.lit(1), half - shrunk))),
                lambda r: F.xxhash64(longer, F.lit("back"), back, F.array_join(r, "")),
            ),
        )

    own = words.select(F.explode(keys(size, 0, _without_one)).alias("key"), "word", "n")
    as_shorter = words.select(F.explode(keys(size + 1, 1, F.array)).alias("key"), "word", "n")
    return own, as_shorter


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: each pair of ``words`` (word, n; words distinct) that are one edit apart, both ways round."""
    own, as_shorter = signatures(words)
    other = own.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    same_length = own.join(other, "key").filter(F.col("word") < F.col("near"))
    shorter = as_shorter.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    candidates = same_length.union(own.join(shorter, "key")).drop("key")
    pairs = candidates.filter(F.levenshtein("word", "near", 1) == 1).distinct()
    return pairs.union(pairs.select(F.col("near"), F.col("near_n"), F.col("word"), F.col("n")))


def spelling_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for each of ``words`` (word, n; words distinct).

    ``form`` is the most frequent near word (of several the first in code-point
    order) if it is at least ``ratio`` times as frequent, ``root`` what
    following the forms leads to. A word without form is its own root; no words
    give no rows.
    """
    words = materialize(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("_best"))
    found = words.join(near, "word", "left").withColumn("_form_n", -F.col("_best.less"))
    usual = F.col("_form_n") >= ratio * F.col("n")
    found = materialize(
        found.select(
            "word",
            F.when(usual, F.col("_best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(usual, F.col("_form_n")).alias("form_n"),
        ),
        "spelling",
    )
    # Each step is to a word ``ratio`` times as frequent, which bounds their number; each round doubles the steps made.
    most = found.agg(F.max("n")).first()[0] or 1
    steps = int(math.log(most, ratio)) + 1
    roots = found.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps + 1))):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_far"))
        roots = materialize(
            roots.join(further, "root", "left").select("word", F.coalesce("_far", "root").alias("root")), "roots"
        )
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Every word of the documents with its usual form."""
    return spelling_groups(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op13_spelling_variants": op13_spelling_variants}
