import pytest
from llm_fixtures import prose

SF = "/root/testdata/sf0.001"
CLASH = "n_words long, shard int, slot long, position long, size long, root long, found string, kept boolean, row long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source): null and empty texts, ties, repeated rows, near copies, a very long text."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    return [
        (1, base, "en", "a"),
        (2, " ".join(near), "en", "b"),
        (3, None, None, None),
        (4, "", "en", "a"),
        (5, " \n\t ", "en", None),
        (6, base.upper(), "de", "a"),
        (7, "three short words", "de", "c"),
        (8, "Three  short\nwords", "fr", "c"),
        (9, prose(2, 60_000), "en", "a"),
        (10, prose(3, 300), "en", "b"),
        (10, prose(3, 300), "en", "b"),
        (None, prose(4, 200), "en", "b"),
        (None, None, None, None),
        (11, "one", "en", "é"),
        (12, prose(5, 70) + " " + base + " " + prose(6, 30), "en", "z"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    rows = [(*r, 7, 1, 2, 3, 4, 5, "x", False, 6) for r in odd_rows]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {CLASH}").repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
