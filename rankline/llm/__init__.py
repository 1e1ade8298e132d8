"""Training-data operators (chat formatting, scoring, tokenising, dedup, mixing, search, filters).

Nothing outside this subpackage imports it; ``corpus_pipeline.py`` belongs to it.
"""
