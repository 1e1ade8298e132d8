"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a maximal run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name based on ``base`` that no column of ``df`` has (names compare without case)."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name = f"{base}_{uuid.uuid4().hex[:6]}"
    return name


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels no model may learn from; a NULL id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int,
                    max_chars: int) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """(texts with labels, number of labelled documents by label) to learn from.

    Held-out ids, NULL ids and labels other than 0 and 1 are left out; a document with
    repeated label rows has the largest one, a NULL text counts as empty, and of several texts
    under one id the one with the smallest hash is taken.  The numbers cover all labels; of each label, at most ``per_class`` ids are drawn by a hash of the id,
    and of their texts those up to ``max_chars``.  So at most 2 * per_class * max_chars
    characters reach the driver, whatever the size of the corpus.
    """
    y = (labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
         .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y")))
    numbers = {r.y: r.n for r in y.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = [r for k in (0, 1) for r in
             y.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    of = {r.doc_id: r.y for r in drawn}
    if not of:
        return [], numbers
    ids = documents.sparkSession.createDataFrame([(i,) for i in of], "doc_id long")
    d = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= max_chars)
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"]
    got = d.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(one.alias("text")).collect()
    return [(r.text, of[r.doc_id]) for r in sorted(got, key=lambda r: r.doc_id)], numbers
