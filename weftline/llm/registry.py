"""The registered queries of this subpackage and their SQL."""

import corpus_pipeline
from weftline.llm import (
    alignment,
    decontaminate,
    html_text,
    lm_scoring,
    mixing,
    ngram_join,
    quality,
    secrets,
    sharding,
    spelling,
    suffix_dedup,
    token_codec,
    vector_ranges,
)

_MODULES = (
    sharding,
    lm_scoring,
    token_codec,
    suffix_dedup,
    ngram_join,
    html_text,
    secrets,
    decontaminate,
    quality,
    mixing,
    alignment,
    vector_ranges,
    spelling,
)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
ORACLES = {name: sql for module in _MODULES for name, sql in getattr(module, "ORACLES", {}).items()}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
