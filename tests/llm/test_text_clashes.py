"""Columns of the input that are named like a result."""

from weftline.llm import decontaminate, mixing, quality, secrets, sharding


def test_results_replace_columns_of_their_names(spark, odd, odd_rows):
    benchmark = spark.createDataFrame([(1, "no such words")], "item_id long, text string")
    n = len(odd_rows)
    sharded = sharding.hilbert_shards(odd, ["source", "lang"], ["doc_id", "text"], 3)
    assert sharded.count() == n and sharded.columns.count("slot") == 1 and max(r.shard for r in sharded.collect()) == 2
    matched = decontaminate.with_matches(odd, benchmark)
    assert matched.columns.count("n_words") == 1 and matched.select("n_words").count() == n
    featured = quality.with_features(odd)
    assert {r.doc_id: r.n_words for r in featured.select("doc_id", "n_words").collect()}[7] == 3
    assert all(r.found == [] for r in secrets.find_secrets(odd).select("found").collect())
    assert mixing.mixed(odd).count() == n and mixing.mix(odd).columns == odd.columns


def test_slots_follow_the_schedule(odd):
    rows = mixing.mixed(odd, block=7).collect()
    taking = [r for r in rows if r.taken]
    assert all((r.first_slot is None) == (r.taken == 0) and (r.n_slots > 0) == (r.taken > 0) for r in rows)
    assert min(r.first_slot for r in taking) == 0 and all(r.taken <= 7 * r.n_slots for r in taking)
