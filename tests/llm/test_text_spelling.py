import random
import re
import zlib
from collections import Counter

import pytest

from weftline.llm import spelling

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute_counts(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            crc = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if crc % 31 == 0:
                run = run[: crc % len(run)] + run[crc % len(run) + 1 :]
            counts[run] += len(run) >= 7
    return {w: n for w, n in counts.items() if n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute_groups(counts):
    """Words that share what is left after one letter is left out, then compared."""
    left = {}
    for w in counts:
        for i in range(len(w)):
            left.setdefault(w[:i] + w[i + 1 :], set()).add(w)
        left.setdefault(w, set()).add(w)
    near = {w: set() for w in counts}
    for group in left.values():
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    counts = brute_counts(rows)
    assert {r.word: r.n for r in spelling.word_counts(documents).collect()} == counts
    out = got(spelling.spelling_groups(spelling.word_counts(documents)))
    assert out == brute_groups(counts) and any(r[4] for r in out)


def test_every_edit_is_found(spark):
    draw = random.Random(1)
    words = {}
    for size in range(7, 14):
        for _ in range(6):
            base = "".join(draw.choices("abcé", k=size))
            words[base] = 100 * draw.randint(1, 30)
            for i in range(size + 1):
                words.setdefault(base[:i] + draw.choice("abcéz") + base[i:], draw.randint(1, 40))
                words.setdefault(base[:i] + draw.choice("abcéz") + base[i + 1 :], draw.randint(1, 40))
                words.setdefault(base[:i] + base[i + 1 :], draw.randint(1, 40))
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert got(spelling.spelling_groups(df)) == brute_groups(words)


def test_forms_are_followed_and_ties_go_by_code_point(spark):
    rows = [("abcdefg", 1), ("abcdefgh", 10), ("abcdefghi", 100), ("abcdefghij", 1000), ("éaaaaaaa", 2), ("zaaaaaaa", 30), ("baaaaaaa", 30)]
    out = {r[0]: r[1:3] for r in got(spelling.spelling_groups(spark.createDataFrame(rows, "word string, n long")))}
    assert out["abcdefg"] == ("abcdefgh", "abcdefghij") and out["abcdefghij"] == (None, "abcdefghij")
    assert out["éaaaaaaa"] == ("baaaaaaa", "baaaaaaa") and out["baaaaaaa"] == (None, "baaaaaaa")


def test_words_share_few_signatures(spark):
    """Words of one letter and one other are all near in letters; their halves keep them apart."""
    rows = [("a" * i + "b" + "a" * (40 - i), 1) for i in range(41)]
    df = spark.createDataFrame(rows, "word string, n long")
    assert {r[4] for r in got(spelling.spelling_groups(df))} == {0}


@pytest.mark.parametrize("which", ["odd", "nothing"])
def test_odd_rows(request, which, odd_rows):
    counts = brute_counts([r[:2] for r in odd_rows]) if which == "odd" else {}
    out = spelling.spelling_groups(spelling.word_counts(request.getfixturevalue(which)))
    assert got(out) == brute_groups(counts)


def test_letters_in_other_scripts_and_cases(spark):
    rows = [(None, "ÀÉÈÜabc ÀÉÈÜABC àéèüabc naïvement Naïvement×÷"), (7, "naïvement " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.word: r.n for r in spelling.word_counts(df).collect()} == brute_counts(rows)
