"""Factor encodings: long form, positions, one-hot, vocabulary, scenarios.

Positions are computed row-locally from an array of the driver columns
(``array_position``), which replaces a melt -> pivot -> merge round trip and
its two exchanges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankline.functions.columns import driver_array, position_first, position_last
from rankline.schema import DEFAULT_FACTORS, DRIVERS

# A factor vocabulary becomes one feature column per factor; by default, absurd sizes are
# refused instead of building a schema with millions of columns.
MAX_VOCABULARY = 10_000
# Rows that one task of driver_factor_counts counts.
COUNT_ROWS = 250_000


def driver_columns(df: DataFrame) -> list[str]:
    """Columns named Driver<digits> (schema only, no job); else positions 2..18."""
    import re
    found = [c for c in df.columns if re.fullmatch(r"Driver\d+", c)]
    if not found and len(df.columns) > 2:
        found = df.columns[2:19]
    return found


def driver_long(df: DataFrame, ids: list[str], drivers: list[str] | None = None) -> DataFrame:
    """Wide -> long: one row per (ids, Driver, Factor) plus the driver number."""
    drivers = drivers or DRIVERS
    long = df.select(*ids, *drivers).unpivot(ids, drivers, "Driver", "Factor")
    return long.withColumn("DriverNumber", F.regexp_extract("Driver", r"(\d+)", 1).cast("int"))


def vocabulary_frame(*frames: DataFrame, drivers: list[str] | None = None) -> DataFrame:
    """Distinct non-null, non-empty factors over all driver columns (sorted)."""
    drivers = drivers or DRIVERS
    out = None
    for df in frames:
        cols = [d for d in drivers if d in df.columns]
        # explode of a row-local array avoids one scan per driver column
        f = df.select(F.explode(F.array(*[F.col(c) for c in cols])).alias("Factor"))
        f = f.where(F.col("Factor").isNotNull() & (F.col("Factor") != ""))
        out = f if out is None else out.unionByName(f)
    return out.distinct().orderBy("Factor")


def resolve_vocabulary(*frames: DataFrame, drivers: list[str] | None = None, most: int = MAX_VOCABULARY) -> list[str]:
    """Vocabulary as a driver-side list (it defines the feature schema); more than ``most`` factors are an error."""
    vf = vocabulary_frame(*frames, drivers=drivers)
    rows = vf.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"factor vocabulary exceeds {most} entries; raise 'most' or pass the vocabulary")
    vocab = [r.Factor for r in rows]
    return vocab or list(DEFAULT_FACTORS)


def position_columns(vocab: list[str], drivers: list[str] | None = None, last: bool = False,
                     suffix: str = "") -> list[Column]:
    arr = driver_array(drivers)
    fn = position_last if last else position_first
    return [fn(arr, f).alias(f"{f}{suffix}") for f in vocab]


def with_positions(df: DataFrame, vocab: list[str], drivers: list[str] | None = None,
                   last: bool = False, suffix: str = "") -> DataFrame:
    return df.select("*", *position_columns(vocab, drivers, last, suffix))


def onehot_columns(vocab: list[str], drivers: list[str] | None = None) -> list[Column]:
    drivers = drivers or DRIVERS
    return [F.coalesce((F.col(d) == F.lit(f)).cast("int"), F.lit(0)).alias(f"{d}_{f}")
            for d in drivers for f in vocab]


def driver_factor_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Count of (Driver, Factor) per group, NULL factors dropped.

    Rows are dealt out by group while they are wide, in tasks of about ``COUNT_ROWS`` rows whatever their number, so
    a task holds the counters of its own groups only, not those of all rows that it reads.
    """
    wide = df.select(*by, *DRIVERS)
    if by:
        wide = wide.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-wide.count() // COUNT_ROWS)), *by)
    long = driver_long(wide, by)
    return (long.where(F.col("Factor").isNotNull())
                .groupBy(*by, "Driver", "Factor").agg(F.count(F.lit(1)).alias("Count")))


def factor_heatmap(df: DataFrame, by: list[str], drivers: list[str] | None = None) -> DataFrame:
    """Factor rows x Driver columns of counts, 0-filled.

    One pass with conditional sums per driver column replaces a long form +
    pivot (which would need an extra aggregation to discover pivot values).
    """
    drivers = drivers or DRIVERS
    long = df.select(*by, F.explode(F.arrays_zip(
        F.array(*[F.lit(d) for d in drivers]).alias("Driver"),
        driver_array(drivers).alias("Factor"))).alias("_z"))
    long = long.select(*by, F.col("_z")["Driver"].alias("Driver"), F.col("_z")["Factor"].alias("Factor"))
    long = long.where(F.col("Factor").isNotNull())
    return long.groupBy(*by, "Factor").agg(
        *[F.count_if(F.col("Driver") == F.lit(d)).alias(d) for d in drivers])


def factor_scenarios(subjects: DataFrame, vocab: list[str], n_scenarios: int, seed: str,
                     n_positions: int | None = None) -> DataFrame:
    """Seeded random factor orderings per (subject, scenario).

    Each (subject, scenario, factor) gets a deterministic md5 key; sorting the
    row-local array of (key, factor) gives a shuffled ordering.  Fully
    row-local: no window, no shuffle beyond the subject list itself.
    """
    n_positions = n_positions or len(DRIVERS)
    voc = F.array(*[F.lit(f) for f in vocab])
    x = subjects.select("SubjectID", F.explode(F.sequence(F.lit(1), F.lit(n_scenarios))).alias("Scenario"))
    prefix = F.concat_ws("|", F.lit(seed), F.col("SubjectID").cast("string"), F.col("Scenario").cast("string"))
    keyed = F.array_sort(F.transform(voc, lambda f: F.struct(
        F.md5(F.concat_ws("|", prefix, f)).alias("k"), f.alias("f"))))
    x = x.withColumn("_o", keyed)
    return x.select("SubjectID", "Scenario",
                    *[F.col("_o")[i]["f"].alias(f"Driver{i + 1}") for i in range(n_positions)])
