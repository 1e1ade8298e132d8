"""Report tables behind the dashboard (computed for all subjects at once)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankline.operators.history import HOT_ROWS, history_columns, subject_summary


def history_for_model(df: DataFrame, model: str) -> DataFrame:
    """Observed rows plus the predictions of one model."""
    return df.where((F.col("Model") == F.lit(model)) | F.col("Model").isNull())


def series_name() -> F.Column:
    return F.coalesce(F.concat(F.lit("Model: "), F.col("Model")), F.lit("Historical Data"))


def rank_series(df: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """One time-ordered series per (subject, observed | model) with a 1-based point number.

    The point number is the running row count of the history windows, so a
    very long series is split into time segments like any hot subject.
    """
    x = df.select("SubjectID", series_name().alias("series"), "UpdateDT", "Rank")
    order = [F.col("UpdateDT").asc_nulls_first(), F.col("Rank").asc_nulls_first()]
    h = history_columns(x, keys=["SubjectID", "series"], order=order,
                        hot_rows=HOT_ROWS if hot_rows is None else hot_rows)
    return h.select("SubjectID", "series", "UpdateDT", "Rank", (F.col("ObsNumber") + 1).alias("point"))


def rows_per_subject(df: DataFrame) -> DataFrame:
    """Rows with their subject's row count: partial aggregate + join (AQE splits a hot subject)."""
    n = df.groupBy("SubjectID").agg(F.count(F.lit(1)).alias("n_subject_rows")) \
          .withColumnRenamed("SubjectID", "_sid")
    # null-safe: rows without a subject form one group, as in a window
    return df.join(n, df["SubjectID"].eqNullSafe(n["_sid"]), "left").drop("_sid")


def subject_card(df: DataFrame) -> DataFrame:
    """Subject summary plus the display date of the last update."""
    s = subject_summary(df)
    return s.withColumn("last_update_date", F.date_format("last_update", "yyyy-MM-dd"))


def subject_lookup(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Summary for requested ids; unknown ids get NULLs and num_records 0."""
    s = subject_summary(df)
    return ids.join(s, "SubjectID", "left").withColumn("num_records", F.coalesce("num_records", F.lit(0)))


def model_comparison(df: DataFrame, models: list[str]) -> DataFrame:
    """Observed rank and each model's rank per (subject, time), plus the model spread.

    Conditional aggregates with a fixed model list: one aggregation, no pivot
    value discovery job.
    """
    m = F.col("Model")
    pred = F.when(m.isNotNull(), F.col("Rank"))
    return df.groupBy("SubjectID", "UpdateDT").agg(
        F.max(F.when(m.isNull(), F.col("Rank"))).alias("observed"),
        *[F.max(F.when(m == F.lit(name), F.col("Rank"))).alias(name) for name in models],
        (F.max(pred) - F.min(pred)).alias("model_range"),
    )


def model_card(board: DataFrame, model_name: str) -> DataFrame:
    """One model's leaderboard row with display fields (accuracy shares as percent).

    A model missing from the leaderboard gives one row of NULLs (the card's
    not-found case) instead of no row.
    """
    wanted = board.sparkSession.createDataFrame([(model_name,)], "model_name string")
    row = wanted.join(board, "model_name", "left")
    return row.select(
        "model_name", "mae", "rmse", "r2", "spearman", "kendall",
        *[F.round(F.col(f"accuracy_{k}") * 100, 1).alias(f"within_{k}_pct") for k in (5, 10, 20)],
        F.format_string("±%.1f ranks", F.col("mae")).alias("expected_accuracy"),
    )
