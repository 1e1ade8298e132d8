"""SimHash near-dedup by segment popcounts.

A text's words (ASCII letters lower-cased) form shingles; each shingle is hashed with XXH64,
and a fingerprint bit is 1 if it is set in over half of the hashes.

Linking fingerprints at ``max_bits`` or fewer differing bits:

1. *Embedding.*  The 64 bits fall into 32 segments of two bits; a fingerprint maps to the 32
   counts of set bits.  Counts are kept in unary (0 = 00, 1 = 01, 2 = 11), so the whole vector
   is one long and the Manhattan distance of two vectors is ``bit_count(a ^ b)``.  A differing
   bit changes one count by at most one, so the Manhattan distance never exceeds the Hamming
   distance.
2. *Grid range-join.*  The axes fall into ``max_bits + 2`` groups.  Two vectors within
   Manhattan distance ``max_bits`` differ in at most ``max_bits`` groups, so they share the
   grid cell of at least one pair of groups; each fingerprint is put into one cell per pair,
   and only cell mates are compared: first by Manhattan distance, then exactly.
3. *Crowded cells.*  All pairs of a cell grow with its square, so cells over ``CROWDED``
   distinct fingerprints are searched another exact way, linear in their members: every
   member is spread over its neighbourhood (itself and its 64 one-bit flips).  Two members at
   two bits or fewer share a point of their neighbourhoods, and members that share a point
   are at two bits or fewer.  At most 65 fingerprints can share a point, so no group is large.

Equal fingerprints are collapsed before any of this, so copies cost one row each, and links
are followed by distributed connected components.

Plan: fingerprints are computed by a row-local Arrow function over whole texts; all linking
is DataFrame work on (fingerprint) rows.

Defined results: NULL and empty texts and texts without a word have fingerprint zero and link
like any other.  A component's id is the smallest doc_id in it (NULL ids do not count; NULL
if it has no other).  Repeated rows each get their row.  Extra columns are left out by
``components_of`` and kept by ``keep_representatives``.  An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankline.llm.common import table
from rankline.llm.components import components
from rankline.llm.registry import register
from rankline.session import cut_lineage

# Cells with more distinct fingerprints than this are searched by neighbourhoods.
CROWDED = 128
LOW = 0x5555555555555555


def fingerprint(text: Column, shingle: int) -> Column:
    """SimHash of whole texts as a signed long."""

    @F.arrow_udf("bigint")
    def run(texts):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest
        out = np.zeros(len(texts), np.uint64)
        weights = (np.uint64(1) << np.arange(64, dtype=np.uint64))
        for k, t in enumerate(texts):
            # bytes.lower and bytes.split know ASCII only: letters A-Z, white space 20 and 09-0D
            words = t.as_buffer().to_pybytes().lower().split() if t.is_valid else ()
            if not words:
                continue
            if len(words) > shingle:
                parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
            else:
                parts = [b" ".join(words)]
            h = np.fromiter((xxh64_intdigest(p, 42) for p in parts), np.uint64)
            ones = np.zeros(64, np.int64)
            for at in range(0, len(h), 8192):
                bits = np.unpackbits(h[at:at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8),
                                     axis=1, bitorder="little")
                ones += bits.sum(axis=0, dtype=np.int64)
            out[k] = weights[2 * ones > len(h)].sum()
        return pa.array(out.view(np.int64))

    return run(text)


def embedding(fp: Column) -> Column:
    """Set bits of every two-bit segment, in unary."""
    pair = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(pair).bitwiseAND(F.lit(LOW))
    full = fp.bitwiseAND(pair).bitwiseAND(F.lit(LOW))
    return some.bitwiseOR(F.shiftleft(full, 1))


def masks(max_bits: int) -> list[int]:
    """One mask per pair of axis groups (signed longs)."""
    n = max_bits + 2
    cuts = [2 * round(32 * i / n) for i in range(n + 1)]
    groups = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [(x | y) - (1 << 64) if (x | y) >> 63 else x | y for x, y in combinations(groups, 2)]


def links(fingerprints: DataFrame, max_bits: int, crowded: int = CROWDED) -> DataFrame:
    """(a, b) with a < b at ``max_bits`` or fewer differing bits; ``fingerprints``: distinct ``fp``.

    Every such pair is listed unless its cell is crowded; there, enough of them are listed that
    the same fingerprints are connected.
    """
    if max_bits not in (0, 1, 2):
        raise ValueError("max_bits must be 0, 1 or 2")
    none = fingerprints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    if max_bits == 0:
        return none
    fps = fingerprints.select("fp", embedding(F.col("fp")).alias("e"))
    cells = fps.select("fp", "e", F.posexplode(F.array(*[F.col("e").bitwiseAND(F.lit(m)) for m in masks(max_bits)]))
                       .alias("grid", "cell"))
    cells = cut_lineage(cells)
    size = cells.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n"))
    size = cut_lineage(size.where(F.col("n") > 1))
    shared = size.where(F.col("n") <= crowded).select("grid", "cell")
    roomy = cells.join(shared, ["grid", "cell"], "left_semi")
    x, y = roomy.alias("x"), roomy.alias("y")
    near = (x.join(y, [F.col("x.grid") == F.col("y.grid"), F.col("x.cell") == F.col("y.cell"),
                       F.col("x.fp") < F.col("y.fp"),
                       F.bit_count(F.col("x.e").bitwiseXOR(F.col("y.e"))) <= max_bits])
            .where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= max_bits)
            .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")))
    # crowded cells: members meet at the points of their neighbourhoods
    full = size.where(F.col("n") > crowded).select("grid", "cell")
    members = cells.join(full, ["grid", "cell"], "left_semi").select("fp").distinct()
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    spread = members.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("point"))
    met = spread.groupBy("point").agg(F.collect_set("fp").alias("at"))  # 65 members at most
    if max_bits == 2:
        met = met.where(F.size("at") > 1).select(F.array_min("at").alias("a"), F.explode("at").alias("b"))
    else:
        met = (met.where((F.size("at") > 1) & F.array_contains("at", F.col("point")))
               .select(F.col("point").alias("p"), F.explode("at").alias("q"))
               .select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")))
    return near.unionByName(met.where(F.col("a") < F.col("b"))).distinct()


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _components(docs: DataFrame, shingle: int, max_bits: int, crowded: int) -> DataFrame:
    """doc_id, fp, key (hash of the text), root (of the component), component_id per row."""
    rows = cut_lineage(docs.select("doc_id", fingerprint(F.col("text"), shingle).alias("fp"), _text_key(F.col("text")).alias("key")))
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(first, max_bits, crowded), "a", "b").select(F.col("node").alias("fp"), "root")
    # component of each distinct fingerprint, then its smallest id
    member = first.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    low = member.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(member.join(low, "root").select("fp", "root", "component_id"), "fp")


def components_of(docs: DataFrame, shingle: int = 3, max_bits: int = 2, crowded: int = CROWDED) -> DataFrame:
    """doc_id, fp (long) and component_id for every row of ``docs``."""
    return _components(docs, shingle, max_bits, crowded).select("doc_id", "fp", "component_id")


def keep_representatives(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest doc_id.

    Of rows that share this id, the one with the smallest hash of its text is kept, and of
    identical rows one.  A component without any id keeps a row without an id.
    """
    found = _components(docs, shingle, max_bits, CROWDED).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = found.groupBy("root").agg(F.first("component_id").alias("id"), F.min("key").alias("_key"))
    names = ["_null", "_id", "_key"]
    keep = keep.select(F.col("id").isNull().alias("_null"), F.coalesce("id", F.lit(0)).alias("_id"), "_key").distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").isNull().alias("_null"),
                       F.coalesce("doc_id", F.lit(0)).alias("_id"), _text_key(F.col("text")).alias("_key"))
    once = Window.partitionBy(*names).orderBy("_key")
    kept = rows.join(keep, names, "left_semi").withColumn("_n", F.row_number().over(once)).where(F.col("_n") == 1)
    return kept.select("_row.*")


@register("op4_simhash_near_dedup")
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = components_of(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
