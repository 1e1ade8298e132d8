"""Loads every training-data query into the registry."""

from __future__ import annotations

from rankline.llm.registry import ORACLE, QUERIES  # noqa: F401


def load_all() -> None:
    # importing the modules registers their queries
    from rankline.llm import (bpe, chat, compress_quality, fill_middle, hamming_search, line_dedup, lm_score, mixing,
                              quality_rules, simhash, toxicity, vector_codes,
                              word_langid)  # noqa: F401
    import corpus_pipeline
    QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
