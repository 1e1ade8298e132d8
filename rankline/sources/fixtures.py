"""Rank-observation views derived from the ``events`` table.

Each view is a pure projection of ``events`` (plus, for the raw / dirty / multi
views, a fixed replication), so its size grows with the input table.  The
definitions are the ones fixed in FIXTURES.md so that Spark and the DuckDB
oracle see identical rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankline.schema import DRIVERS, N_DRIVERS
from rankline.sources.tables import EVENT_COLUMNS, events

# Fixed values of the fixture definitions.
STD_TS_TEXT = "yyyy-MM-dd HH:mm:ss"
RAW_TS_TEXT = "M/d/yyyy H:mm"
MODEL_BY_EVENT = {"purchase": "Random Forest", "error": "XGBoost"}
MULTI_MODELS = {1: "Random Forest", 2: "XGBoost"}


def _base_rank() -> Column:
    return F.least(F.lit(265), F.lit(1) + F.floor("value")).cast("int")


def driver_expr(i: int) -> Column:
    """Factor name at driver position i (a permutation of Factor1..Factor17 per row)."""
    shift = F.floor("value").cast("bigint") + F.lit(i) * (F.lit(1) + F.col("user_id") % 16)
    return F.concat(F.lit("Factor"), ((shift % N_DRIVERS) + 1).cast("string"))


def _drivers() -> list[Column]:
    return [driver_expr(i).alias(f"Driver{i}") for i in range(1, N_DRIVERS + 1)]


def _model_of_event() -> Column:
    e = F.col("event_type")
    return F.when(e == "purchase", F.lit("Random Forest")).when(e == "error", F.lit("XGBoost"))


def rankings(ev: DataFrame) -> DataFrame:
    return ev.select(
        F.col("user_id").alias("SubjectID"),
        _base_rank().alias("Rank"),
        *_drivers(),
        F.col("ts").alias("UpdateDT"),
        (~F.col("event_type").isin("purchase", "error")).alias("OriginalDataFlag"),
        _model_of_event().alias("Model"),
    )


def _copies(ev: DataFrame, n: int, name: str) -> DataFrame:
    # Row-local replication (Generate), no join and no shuffle.
    return ev.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name))


def rankings_multi(ev: DataFrame) -> DataFrame:
    x = _copies(ev, 3, "k")
    k = F.col("k")
    rank = ((F.least(F.lit(265), F.lit(1) + F.floor("value")) - 1
             + k * (F.lit(1) + F.col("event_id") % 7)) % 265 + 1).cast("int")
    return x.select(
        F.col("user_id").alias("SubjectID"), rank.alias("Rank"), *_drivers(),
        F.col("ts").alias("UpdateDT"), (k == 0).alias("OriginalDataFlag"),
        F.when(k == 1, F.lit("Random Forest")).when(k == 2, F.lit("XGBoost")).alias("Model"),
    )


def _raw_rows(ev: DataFrame) -> DataFrame:
    # Every event once, plus an exact duplicate of every 97th event.
    x = _copies(ev, 2, "c")
    return x.where((F.col("c") == 0) | (F.col("event_id") % 97 == 0))


def rankings_raw(ev: DataFrame) -> DataFrame:
    x = _raw_rows(ev)
    return x.select(
        F.col("user_id").cast("string").alias("SubjectID"),
        _base_rank().cast("string").alias("Rank"),
        *_drivers(),
        F.date_format("ts", RAW_TS_TEXT).alias("UpdateDT"),
    )


def rankings_bad(ev: DataFrame) -> DataFrame:
    """Raw rows of which some cannot be typed, and some hold missing-value tokens."""
    eid = F.col("event_id")
    return _raw_rows(ev).select(
        F.when(eid % 79 == 0, F.lit("abc")).when(eid % 61 == 0, F.lit("99999999999999999999"))
         .otherwise(F.col("user_id").cast("string")).alias("SubjectID"),
        F.when(eid % 89 == 0, F.lit("3000000000")).when(eid % 83 == 0, F.lit("x")).when(eid % 71 == 0, F.lit("N/A"))
         .when(eid % 67 == 0, F.lit("12.0")).otherwise(_base_rank().cast("string")).alias("Rank"),
        *_drivers(),
        F.when(eid % 73 == 0, F.lit("13/45/2025 10:00")).otherwise(F.date_format("ts", RAW_TS_TEXT)).alias("UpdateDT"),
    )


def csv_lines(ev: DataFrame) -> DataFrame:
    """Lines of a CSV of the raw rows, some of them malformed: a field missing or too many, a quote left open, a
    quoted field over two lines; others hold a quoted comma or a quoted quote."""
    eid = F.col("event_id")
    fields = [F.col("user_id").cast("string"), _base_rank().cast("string"), *_drivers()[:-1]]
    head, time = F.concat_ws(",", *fields), F.date_format("ts", RAW_TS_TEXT)
    last = (F.when(eid % 31 == 0, F.lit('"Factor, 1"')).when(eid % 37 == 0, F.lit('"say \\"A\\""'))
            .otherwise(driver_expr(N_DRIVERS)))
    line = (F.when(eid % 41 == 0, F.concat_ws(",", head, last))
            .when(eid % 43 == 0, F.concat_ws(",", head, last, time, F.lit("more")))
            .when(eid % 47 == 0, F.concat_ws(",", head, last, F.concat(F.lit('"'), time)))
            .when(eid % 53 == 0, F.concat_ws(",", head, F.lit('"two\nlines"'), time))
            .otherwise(F.concat_ws(",", head, last, time)))
    return ev.select(line.alias("value"))


def rankings_dirty(ev: DataFrame) -> DataFrame:
    x = _raw_rows(ev)
    eid = F.col("event_id")
    return x.select(
        F.when(eid % 211 == 0, F.lit(None)).otherwise(F.col("user_id")).alias("SubjectID"),
        F.when(eid % 101 == 0, F.lit(None)).otherwise(_base_rank()).alias("Rank"),
        *_drivers(),
        F.when(eid % 103 == 0, F.lit("2021-02-30 00:00:00"))
         .when(eid % 107 == 0, F.lit("n/a"))
         .otherwise(F.date_format("ts", STD_TS_TEXT)).alias("UpdateDT"),
        (~F.col("event_type").isin("purchase", "error")).alias("OriginalDataFlag"),
        _model_of_event().alias("Model"),
    )


def inputs(ev: DataFrame) -> DataFrame:
    """New rows to score: some without id, some all blank, some with a repeated factor."""
    eid = F.col("event_id")
    cols = []
    for i in range(1, N_DRIVERS + 1):
        c = F.when(eid % 29 == 0, F.lit(""))
        if i in (15, 16):
            c = c.when(eid % 11 == 0, F.lit(""))
        if i == 17:
            c = c.when(eid % 13 == 0, driver_expr(1))
        cols.append(c.otherwise(driver_expr(i)).alias(f"Driver{i}"))
    return ev.select(
        eid,
        F.when(eid % 17 == 0, F.lit("")).otherwise(F.col("user_id").cast("string")).alias("SubjectID"),
        F.lit(None).cast("int").alias("Rank"),
        *cols,
        F.col("ts").alias("UpdateDT"),
    )


VIEWS = {
    "rankings": rankings,
    "rankings_multi": rankings_multi,
    "rankings_raw": rankings_raw,
    "rankings_bad": rankings_bad,
    "csv_lines": csv_lines,
    "rankings_dirty": rankings_dirty,
    "inputs": inputs,
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return VIEWS[name](events(spark, sf_dir))


def dealt_view(spark: SparkSession, sf_dir: str, name: str, parts: int | None = None) -> DataFrame:
    """``view`` of events dealt out over all cores (or ``parts`` tasks) while they are narrow: a file of few row
    groups is few tasks, which would make all the view's columns."""
    parts = parts or max(2, spark.sparkContext.defaultParallelism)
    return VIEWS[name](events(spark, sf_dir).repartition(parts, *EVENT_COLUMNS))


assert len(DRIVERS) == N_DRIVERS
