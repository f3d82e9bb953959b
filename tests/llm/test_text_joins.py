import random
import re
from itertools import combinations

import pytest
from llm_fixtures import prose
from pyspark.sql import functions as F

from weftline.llm import links, ngram_join, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 80 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(k)] = min(least.get(find(k), doc), doc)
    return [(doc, len(s), least.get(find(k)) if s else doc) for k, ((doc, _), s) in enumerate(zip(rows, sets))]


def by_key(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("which", ["documents", "odd", "nothing"])
def test_components_of_documents(request, which):
    rows = request.getfixturevalue(which)
    got = ngram_join.linked(rows).select("doc_id", "n_shingles", "component_id").collect()
    want = brute_components([(r.doc_id, r.text) for r in rows.collect()])
    assert by_key(tuple(r) for r in got) == by_key(want)


def edited(draw, words, changes):
    words = list(words)
    for _ in range(changes):
        kind, at = draw.randrange(3), draw.randrange(len(words))
        if kind == 0:
            words[at] = "new" + str(draw.randrange(10**6))
        elif kind == 1:
            words.insert(at, "more" + str(draw.randrange(10**6)))
        elif len(words) > 1:
            del words[at]
    return words


@pytest.fixture(scope="module")
def family(spark):
    """Chains of edits of all sizes around the boundary, and a passage that many texts share."""
    draw, rows = random.Random(9), []
    common = prose(99, 40)
    for size in [1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 20, 23, 25, 27, 29, 35, 60, 120, 300]:
        for copy in range(3):
            words = prose(1000 * size + copy, size).split()
            for changes in (0, 0, 1, 1, 2, 3):
                rows.append((len(rows), " ".join(words)))
                words = edited(draw, words, changes)
    for k in range(60):
        rows.append((len(rows), prose(5000 + k, 60) + " " + common + " " + prose(7000 + k, 30)))
    return rows


def test_sizes_around_the_boundary(spark, family):
    got = ngram_join.linked(spark.createDataFrame(family, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id")
    assert by_key(tuple(r) for r in got.collect()) == by_key(brute_components(family))


@pytest.mark.parametrize("most", [0, 16])
def test_any_boundary_and_frequent_shingles_last(spark, family, monkeypatch, most):
    import numpy as np

    table = spark.createDataFrame(family, "doc_id long, text string")
    heavy = np.unique(np.concatenate(list(ngram_join.shingle_sets(__import__("pyarrow").array([prose(99, 40)])))))
    monkeypatch.setattr(ngram_join, "_estimates", lambda _: (heavy, most))
    got = ngram_join.linked(table).select("doc_id", "n_shingles", "component_id").collect()
    assert by_key(tuple(r) for r in got) == by_key(brute_components(family))


def test_boundary_follows_cost():
    assert ngram_join.boundary({4: 1000}) >= 5  # a partner has 5 at most
    assert ngram_join.boundary({24: 1000}) < 24


def test_keep_one(spark, odd, nothing, odd_rows):
    got = ngram_join.keep_one(odd)
    assert got.columns == odd.columns
    groups = brute_components([(r[0], r[1]) for r in odd_rows])
    want = {c for _, n, c in groups if n} | {None}
    rows = got.select("doc_id", "text").collect()
    worded = [r for r in rows if (r.text or "").split()]
    assert sorted(r.doc_id or -1 for r in worded) == sorted(w or -1 for w in want)
    assert len(rows) - len(worded) == sum(not n for _, n, _ in groups)
    assert ngram_join.keep_one(nothing).count() == 0


def test_links(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 7), (200, 201), (300, 300), (None, 5)]
    got = {r.node: r.root for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 1, 200: 200, 201: 200, 300: 300}
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, width=50):
    """Per row the words inside runs of ``width`` words that another row also has."""
    where = {}
    words = {row: WORD.findall(text or "") for row, text in rows}
    for row, held in words.items():
        for k in range(len(held) - width + 1):
            where.setdefault(tuple(held[k : k + width]), set()).add(row)
    out = {}
    for row, held in words.items():
        covered = set()
        for k in range(len(held) - width + 1):
            if len(where[tuple(held[k : k + width])]) > 1:
                covered.update(range(k, k + width))
        if covered:
            out[row] = covered
    return out


@pytest.mark.parametrize("which", ["documents", "odd", "planted"])
def test_passages(request, spark, which):
    if which == "planted":
        draw, shared = random.Random(4), [prose(k, n) for k, n in enumerate([50, 55, 80, 200, 49, 30])]
        rows = [(k, prose(100 + k, draw.randint(0, 300)) + " " + shared[k % 6] + " " + prose(900 + k, draw.randint(0, 90))) for k in range(60)]
        table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    else:
        table = request.getfixturevalue(which)
    rows = suffix_dedup.document_rows(table)
    got = {
        r.row: {k for p in r.passages for k in range(p["first"], p["last"])}
        for r in suffix_dedup.merged(suffix_dedup.repeats(rows)).collect()
    }
    texts = {r.row: r.text for r in rows.collect()}
    want = brute_repeats(list(texts.items()))
    assert got.keys() == want.keys()
    assert all(got[k] == want[k] for k in got)


def test_no_passages(spark, nothing):
    assert suffix_dedup.repeats(suffix_dedup.document_rows(nothing)).count() == 0


def test_later_copies_go(spark):
    base = prose(1, 60)
    table = spark.createDataFrame([(k, f"{prose(10 + k, 20)} {base} {prose(20 + k, 20)}") for k in range(4)], "doc_id long, text string")
    found = {r.doc: [(p["first"], p["last"]) for p in r.passages] for r in suffix_dedup.later_passages(table).collect()}
    assert 0 not in found and found
    for doc, passages in found.items():
        assert passages == [(20, 80)]
        text = table.filter(F.col("doc_id") == doc).first().text
        assert suffix_dedup.without_words(text, passages) == f"{prose(10 + doc, 20)} {prose(20 + doc, 20)}"


def _later(table):
    """Per doc the words of ``later_passages``, and of brute force over smaller ids."""
    got = {r.doc: {k for p in r.passages for k in range(p["first"], p["last"])} for r in suffix_dedup.later_passages(table).collect()}
    first, want = {}, {}
    rows = sorted((r.doc_id, WORD.findall(r.text)) for r in table.collect())
    for doc, words in rows:
        for k in range(len(words) - 49):
            if first.setdefault(tuple(words[k : k + 50]), doc) != doc:
                want.setdefault(doc, set()).update(range(k, k + 50))
    return got, want


@pytest.mark.parametrize("size", [50, 52, 60, 70, 83])
def test_a_tail_that_others_hold_hides_no_passage(spark, size):
    """Ten rows share only the tail of a passage that two share whole, with 25 words of its head."""
    texts = []
    for k in range(8):
        whole = prose(50 + k, size)
        tail = " ".join(whole.split()[25:])
        texts += [f"{prose(1000 + 2 * k + j, 30)} {whole} {prose(2000 + 2 * k + j, 30)}" for j in range(2)]
        texts += [f"{prose(3000 + 10 * k + j, 40)} {tail} {prose(4000 + 10 * k + j, 40)}" for j in range(10)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = suffix_dedup.document_rows(table)
    got = {r.row: {k for p in r.passages for k in range(p["first"], p["last"])} for r in suffix_dedup.merged(suffix_dedup.repeats(rows)).collect()}
    assert got == brute_repeats([(r.row, r.text) for r in rows.collect()])


@pytest.mark.parametrize("parts", ["1", "7", "40"])
def test_a_passage_twice_in_a_document(spark, parts):
    """Both places count, whichever row sorts first and wherever the partitions are cut."""
    texts = []
    for k in range(12):
        shared = prose(70 + k, 60)
        twice = f"{prose(500 + k, 20)} {shared} {prose(600 + k, 25)} {shared} {prose(700 + k, 10)}"
        texts += [twice, f"{prose(800 + k, 15)} {shared}"] if k % 2 else [f"{prose(800 + k, 15)} {shared}", twice]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = suffix_dedup.document_rows(table)
        got = {r.row: {k for p in r.passages for k in range(p["first"], p["last"])} for r in suffix_dedup.merged(suffix_dedup.repeats(rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert got == brute_repeats([(r.row, r.text) for r in rows.collect()])


def test_all_copies_but_the_first_go(spark, tmp_path):
    shared = [prose(k, n) for k, n in enumerate([60, 50, 90])]
    texts = [f"{prose(100 + k, 20)} {shared[k % 3]} {prose(200 + k, 20)}" for k in range(60)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got, want = _later(table)
    assert got == want and len(want) == 57
    table.write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in suffix_dedup.op4_sparse_suffix_dedup(spark, str(tmp_path)).collect()}
    assert len(out) == 60 and {k for k, r in out.items() if r.n_removed} == set(want)
    assert all(r.n_removed == len(want.get(k, ())) for k, r in out.items())


def test_window_hashes():
    import numpy as np

    from weftline.llm.words import hash_runs

    words = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64)
    for k in (1, 8, 50, 500, 501):
        assert (suffix_dedup.window_hashes(words, k) == hash_runs(words, k)).all()
