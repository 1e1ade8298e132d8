"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words: the total is shared among the sources by weight,
no source may be taken more than ``max_epochs`` times, and what is over goes to the others by
weight until none is above its cap.  Each document of a source then expects
``target / source size`` copies.  Within a source the expected copies are summed up over the
documents, one random offset per source is added, and a document is emitted once for every
whole number that its interval crosses.  Documents are summed up by falling size, so that the
words taken stay within one document of the target, and at random (by a hash of the id) among
equal sizes.

Plan: native SQL only; texts are reduced to their sizes in the scan and never shuffled.  The
running sum over a source is a sum of three bounded ones, so a source with most of the rows is
not one task: over the source's distinct sizes, over hash buckets of one size, and over
the documents of one bucket, the first two on pre-aggregated counts.  There are 256 buckets, and
16 times more for every 16 times that the rows outgrow 256 buckets of ``BUCKET_ROWS``, so a bucket stays
small though all documents be of one size and source.  The one window without a partition ranks the
sources, one row each.

The offset is a hash of the seed and the source, so reruns agree.

Defined results: a NULL text has size 0; a NULL source is a source of its own and comes last;
a source with only empty documents has target 0 and takes nothing; rows with the same
doc_id are separate rows, and identical rows may swap their copies.  An empty table gives an
empty result.  Other columns are ignored by ``plan_mix`` and kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankline.llm.common import WORD, table
from rankline.llm.registry import register
from rankline.session import cut_lineage

WEIGHTS = (3.0, 1.0, 2.0)
BUCKET_ROWS = 100_000


def targets(sizes: DataFrame, share: float, max_epochs: float, weights: tuple[float, ...]) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    In the order of cap / weight, the first sources end at their caps; the others share what is
    left at one level per unit of weight, that of the first source whose cap is not below it.
    """
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    turn = ((F.row_number().over(by_code_point) - 1) % len(weights) + 1).cast("int")
    caps = (sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn))
            .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    free = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    filled = caps.withColumn("place", F.row_number().over(order)).withColumn("level", left / free)
    at_level = F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct("place", "level"))
    filled = filled.withColumn("final", F.min(at_level).over(everything)["level"])
    return filled.select("source", "source_size",
                         F.least("cap", F.coalesce(F.col("w") * F.col("final"), F.col("cap"))).alias("target"))


def _digits(docs: DataFrame) -> int:
    """Hex digits of the hash that make a bucket.  Buckets are prefixes of the hash, so their number changes no result."""
    n, digits = docs.count(), 2
    while n > BUCKET_ROWS << 4 * digits:
        digits += 1
    return digits


def _keyed(docs: DataFrame, digits: int, wide: bool = False) -> DataFrame:
    """doc_id and the sampling key: source without NULLs, size, hash of the id, its bucket.

    ``wide`` carries the whole row along as a struct, so its names cannot clash.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    more = [F.struct("*").alias("_row")] if wide else []
    return (docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_s"),
                        size.alias("_size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_h"), *more)
            .withColumn("_b", F.substring("_h", 1, digits)))


def _places(rows: DataFrame, share: float, max_epochs: float, weights: tuple[float, ...], seed: int) -> DataFrame:
    """Per (source, size, bucket): documents before it, and its source's size, target, rate and offset."""
    buckets = cut_lineage(rows.groupBy("_s", "_size", "_b").agg(F.count(F.lit(1)).alias("n")))
    sizes = buckets.groupBy("_s", "_size").agg(F.sum("n").alias("n"))
    above = Window.partitionBy("_s").orderBy(F.col("_size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    left = Window.partitionBy("_s", "_size").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    outer = sizes.select("_s", "_size", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("_n1"))
    inner = buckets.select("_s", "_size", "_b", F.coalesce(F.sum("n").over(left), F.lit(0)).alias("_n2"))
    totals = sizes.groupBy("_s").agg(F.sum(F.col("n") * F.col("_size")).alias("source_size"))
    source = F.when(F.col("_s") != "", F.expr("substring(_s, 2)"))
    goal = targets(totals.select(source.alias("source"), "source_size"), share, max_epochs, weights)
    part = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("_s"))), 1, 8)
    goal = (goal.withColumn("_s", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
            .select("_s", "source_size", "target",
                    (F.conv(part, 16, 10).cast("double") / F.lit(4294967296.0)).alias("_offset"),
                    F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_rate")))
    return (inner.join(outer, ["_s", "_size"]).join(goal, "_s")
            .select("_s", "_size", "_b", (F.col("_n1") + F.col("_n2")).alias("_n"), "source_size", "target", "_offset", "_rate"))


def _copies(rows: DataFrame, places: DataFrame) -> DataFrame:
    inner = Window.partitionBy("_s", "_size", "_b").orderBy("_h", "doc_id")
    numbered = rows.withColumn("_k", F.row_number().over(inner)).join(places, ["_s", "_size", "_b"])
    n = F.col("_n") + F.col("_k")
    upto, till = n * F.col("_rate") + F.col("_offset"), (n - 1) * F.col("_rate") + F.col("_offset")
    return numbered.withColumn("_copies", (F.floor(upto) - F.floor(till)).cast("long"))


def plan_mix(docs: DataFrame, share: float = 1.5, max_epochs: float = 2.0,
             weights: tuple[float, ...] = WEIGHTS, seed: int = 42) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (words) for every row of ``docs``."""
    rows = cut_lineage(_keyed(docs, _digits(docs)))
    got = _copies(rows, _places(rows, share, max_epochs, weights, seed))
    source = F.when(F.col("_s") != "", F.expr("substring(_s, 2)"))
    return got.select("doc_id", source.alias("source"), F.col("_size").alias("size"), "source_size", "target",
                      F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"))


def mix(docs: DataFrame, share: float = 1.5, max_epochs: float = 2.0,
        weights: tuple[float, ...] = WEIGHTS, seed: int = 42) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``."""
    digits = _digits(docs)
    places = _places(_keyed(docs, digits), share, max_epochs, weights, seed)
    rows = _copies(_keyed(docs, digits, wide=True), places).where(F.col("_copies") > 0)
    return rows.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS s,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
t AS (SELECT s, source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY s, source),
c AS (SELECT *, CAST(source_size AS DOUBLE) * 2.0::DOUBLE AS cap,
             CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w FROM t),
f AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS place,
             (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
              - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
             / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE)) AS level FROM c),
g AS (SELECT *, least(cap, coalesce(w * (SELECT arg_min(level, place) FROM f WHERE cap / w >= level), cap)) AS target,
             CAST(('0x' || substr(md5('42|' || s), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM f),
r AS (SELECT d.doc_id, d.source, d.size, g.source_size, g.target, g.u,
             CASE WHEN g.source_size > 0 THEN g.target / CAST(g.source_size AS DOUBLE) ELSE 0::DOUBLE END AS rate,
             CAST(row_number() OVER (PARTITION BY d.s ORDER BY d.size DESC, d.h, d.doc_id) AS DOUBLE) AS n
      FROM d JOIN g USING (s))
SELECT doc_id, source, size, source_size, target,
       CAST(floor(n * rate + u) - floor((n - 1) * rate + u) AS BIGINT) AS copies,
       CAST(floor(n * rate + u) - floor((n - 1) * rate + u) AS BIGINT) * size AS taken
FROM r
"""


@register("op6_mix_sources", SQL)
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(table(spark, sf_dir, "documents"))
