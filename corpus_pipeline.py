"""Corpus pipeline: documents to token ids.

Five stages, each one operator of ``rankline.llm`` with its production parameters: toxic
documents go, later copies of repeated line runs go, one document of each near-duplicate group
stays, sources are mixed to their target weights (documents repeat as often as they are taken),
and texts become BPE ids.  Every stage works on all that the one before kept; ``run`` writes each
result as Parquet to the shared checkpoint folder and reads it again.

Defined results: NULL and empty texts pass as empty ones do in every stage (as documents without a
word they are one near-duplicate group, whose one row weighs nothing in the mix); rows that repeat
id and text are the same document to line dedup, and near-dedup keeps one of them; a label row
without its document teaches nothing, and without any toxic label none is rejected.  Extra
columns pass through all stages but the last.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankline.llm import bpe, line_dedup, mixing, simhash, toxicity
from rankline.llm.common import table
from rankline.session import cut_lineage

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; the labels of held-out ids teach nothing."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; runs of lines of 50 words or more stay in their first place only."""
    return line_dedup.dedup_lines(docs, across_blank=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash (3-word shingles, 2 bits)."""
    return simhash.keep_representatives(docs, shingle=3, max_bits=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the token ids, their number, and whether they decode to the text."""
    import public_tokenizers
    path = public_tokenizers.path(VOCABULARY)
    ids = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN)
    return ids.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
                      (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"))


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("SimHash near-dedup", near_dedup),
          ("mixing", mix_sources), ("byte-level BPE", tokenize)]

# The stages train a model, build a suffix array and encode by merges: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
