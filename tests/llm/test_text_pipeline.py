import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from weftline.llm import mixing, quality, registry

from test_text_filters import brute_leaks, features
from test_text_joins import brute_components

SF = "/root/testdata/sf0.001"


def test_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 1 + len(numbers))) and registry.QUERIES["pipeline"] is corpus_pipeline.run
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_stages_one_by_one(spark, documents):
    """Each stage against plain Python on what the stage before kept."""
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    verdict = {r.doc_id: r.kept for r in quality.quality(documents).collect()}
    rows = {r.doc_id: r for r in documents.collect()}
    first = corpus_pipeline.keep_quality(spark, documents, SF)
    kept = {r.doc_id for r in first.collect()}
    assert first.columns == documents.columns and kept == {d for d in rows if verdict[d]}
    assert all(features(rows[d].text)[0] >= 50 for d in kept)
    second = corpus_pipeline.keep_one_copy(spark, first, SF)
    unique = {c for _, _, c in brute_components([(d, rows[d].text) for d in kept])}
    assert {r.doc_id for r in second.collect()} == unique and second.count() == len(unique)
    third = corpus_pipeline.keep_unseen(spark, second, SF)
    leaks = brute_leaks([(d, rows[d].text) for d in unique], [(r.item_id, r.text) for r in benchmark.collect()])
    clean = {d for d, _, hit, _, _ in leaks if not hit}
    assert Counter(r.doc_id for r in third.collect()) == Counter(clean)
    fourth = corpus_pipeline.mix_sources(spark, third, SF)
    copies = {r.doc_id: int(r.taken / r["size"] + 0.5) for r in mixing.mixed(third).collect()}
    assert Counter(r.doc_id for r in fourth.collect()) == +Counter(copies)
    last = corpus_pipeline.write_tokens(spark, fourth, SF)
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, at = [], 0
    for doc in sorted(Counter(copies).elements()):
        ids = [*whole.encode(rows[doc].text, add_special_tokens=False).ids, 1]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, last.collect()), key=lambda r: r[1]) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()), key=lambda r: r[1]) == want


@pytest.mark.parametrize("which", ["odd", "nothing"])
def test_odd_rows(request, spark, which):
    docs = request.getfixturevalue(which)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns, docs = docs.columns, stage(spark, docs, SF)
        assert docs.columns == columns
    assert corpus_pipeline.write_tokens(spark, docs, SF).count() == docs.count()
