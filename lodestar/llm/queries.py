"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from importlib import import_module

from .oracle import ORACLE

#: Query name and the module that has the function of that name.
_QUERIES = {
    "op1_license_scan": "licenses", "op2_mixing": "mixing", "op3_sharding": "sharding", "op4_ngram_jaccard": "jaccard", "op5_bpe": "bpe", "op6_warc": "warc",
    "op7_pii": "pii", "op8_quality_rules": "quality", "op9_progressive_jpeg": "jpeg", "op10_token_counts": "token_counts",
}


def queries() -> dict:
    import corpus_pipeline

    out = {name: getattr(import_module(f"lodestar.llm.{module}"), name) for name, module in _QUERIES.items()}
    return out | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that DuckDB can express whole: n-gram Jaccard links and the archive. The other methods' own columns (labels, draws, verdicts, tokens, media) have none, so their queries are held against brute force in tests/llm."""
    return dict(ORACLE)
