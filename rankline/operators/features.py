"""Feature sets for rank models (compositions of history + factor operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankline.functions.columns import blank_to_null, driver_array, position_first, weekday_mon0, whole_days
from rankline.operators import history as H
from rankline.operators.factors import onehot_columns, position_columns
from rankline.schema import DEFAULT_PREV_RANK, DRIVERS, NEW_SUBJECT

HISTORY_FEATURES = ["DaysSinceFirst", "DaysSincePrev", "PrevRank", "AvgPreviousRanks",
                    "AvgPreviousRankChanges"]


def calendar_columns(df: DataFrame, ts: str = "UpdateDT") -> DataFrame:
    return df.withColumns({
        "Year": F.year(ts), "Month": F.month(ts), "DayOfMonth": F.dayofmonth(ts),
        "DayOfWeek": weekday_mon0(ts),
    })


def rank_features(df: DataFrame, vocab: list[str], leak_free: bool = True, dedup: bool = True,
                  first_time: DataFrame | None = None, keep: list[str] | None = None,
                  hot_rows: int | None = H.HOT_ROWS, force_split: bool = False,
                  clustered: bool = False, segment_rows: int = H.SEGMENT_ROWS) -> DataFrame:
    """Enhanced positional feature set: 5 history features + one position per factor.

    ``leak_free`` keeps the first row's AvgPreviousRanks at 0 instead of
    back-filling it from the second row (which equals the row's own rank).
    ``first_time`` is a one-row frame with the global first time (train
    constant); by default it is computed from ``df``.
    """
    keep = keep if keep is not None else ["SubjectID", "UpdateDT", "Model", "Rank"]
    if first_time is None:
        # one aggregate tells the largest subject and the first time
        most, t0 = H.profile(df)
        if hot_rows is not None and most <= hot_rows:
            hot_rows = None
        first_time = df.sparkSession.range(1).select(F.lit(t0).cast("timestamp_ntz").alias("_t_first"))
    # the drivers travel as one array, so that the dedup hashes and the windows copy one value and not one per driver
    packed = df.select(*[c for c in df.columns if c not in DRIVERS], driver_array().alias("_drivers"))
    x = H.history_columns(packed, hot_rows=hot_rows, force_split=force_split, dedup=dedup, clustered=clustered,
                          segment_rows=segment_rows)
    x = H.with_scalar(x, first_time)
    avg_prev = "AvgPreviousRanks" if leak_free else "AvgPreviousRanksFilled"
    return x.select(
        *[F.col("_drivers")[DRIVERS.index(c)].alias(c) if c in DRIVERS else c for c in keep],
        F.coalesce(whole_days(F.col("_t_first"), F.col("UpdateDT")), F.lit(0)).cast("bigint").alias("DaysSinceFirst"),
        H.days_since_prev().alias("DaysSincePrev"),
        F.coalesce(F.col("PrevRank"), F.lit(0)).cast("int").alias("PrevRank"),
        F.coalesce(F.col(avg_prev), F.lit(0.0)).alias("AvgPreviousRanks"),
        F.coalesce(F.col("AvgPreviousRankChanges"), F.lit(0.0)).alias("AvgPreviousRankChanges"),
        *[position_first(F.col("_drivers"), f).alias(f) for f in vocab],
    )


# New-row batches with at most this many distinct subjects restrict the history
# scan by broadcasting the subject list (its size is counted first); larger
# batches use a plain join with the same result.
SERVING_BROADCAST_SUBJECTS = 1_000_000


def training_rows(df: DataFrame) -> DataFrame:
    """Observed rows (Model NULL): the only rows that learners and evaluations may use as labels."""
    return df.where(F.col("Model").isNull())


def serving_features(history: DataFrame | None, new_rows: DataFrame, vocab: list[str],
                     id_col: str = "event_id", hot_rows: int | None = H.HOT_ROWS,
                     first_time: DataFrame | None = None, history_model: str | None = None,
                     keep: list[str] | None = None, broadcast_subjects: int = SERVING_BROADCAST_SUBJECTS,
                     buckets: int | None = None) -> DataFrame:
    """Enhanced features for new rows computed against the stored history.

    History is the observed rows, and with ``history_model`` also that model's
    stored predictions; other models' predictions are never history.  New rows
    (Rank NULL) are unioned with it.  A history row at or before a new row's time
    precedes it, another new row never supplies a rank or a time: PrevRank is the
    last known rank and DaysSincePrev counts from the row it comes from.

    Only the history of subjects present in the batch is read: a left-semi
    join against the batch's subject list (broadcast when its counted size
    allows).  The global first time comes from the full history, or from
    ``first_time`` (a one-row frame saved with the model).

    Rows without a subject id have no history: their history features are 0.
    ``history=None`` treats every row so (each new row scored on its own).
    ``keep``: further columns of the new rows to carry along.  ``buckets``: the history is a
    table bucketed by SubjectID into so many buckets, and is then not shuffled.
    """
    keep = keep or []
    sid = F.col("SubjectID").cast("bigint")
    blank = [blank_to_null(d).alias(d) for d in DRIVERS]
    zeros = [F.lit(0).cast("bigint").alias("DaysSincePrev"), F.lit(0).alias("PrevRank"),
             F.lit(0.0).alias("AvgPreviousRanks"), F.lit(0.0).alias("AvgPreviousRankChanges")]
    more = [c for c in keep if c not in DRIVERS]
    new = new_rows.select(id_col, sid.alias("SubjectID"), "UpdateDT", *blank, *more)
    carried = [id_col, "SubjectID", "UpdateDT", *keep]
    if history is None:
        return new.select(*carried, F.lit(0).cast("bigint").alias("DaysSinceFirst"), *zeros, *position_columns(vocab))
    observed = F.col("Model").isNull()
    history = history.where(observed | (F.col("Model") == F.lit(history_model)) if history_model else observed)
    t0 = first_time if first_time is not None else H.global_first_time(history)
    first = F.coalesce(whole_days(F.col("_t_first"), F.col("UpdateDT")), F.lit(0)).cast("bigint").alias("DaysSinceFirst")
    known, anonymous = new.where(F.col("SubjectID").isNotNull()), new.where(F.col("SubjectID").isNull())
    subjects = known.select("SubjectID").distinct()
    if subjects.count() <= broadcast_subjects:
        subjects = F.broadcast(subjects)
    types = dict(new.dtypes)
    relevant = history.join(subjects, "SubjectID", "left_semi")
    h = relevant.select("SubjectID", "Rank", *DRIVERS, "UpdateDT", "Model", F.lit(0).alias("_side"),
                        *[F.lit(None).cast(types[c]).alias(c) for c in [id_col, *more]])
    n = known.select("SubjectID", F.lit(None).cast("int").alias("Rank"), *DRIVERS, "UpdateDT",
                     F.lit(None).cast("string").alias("Model"), F.lit(1).alias("_side"), id_col, *more)
    both, key = H.clustered_union(h, n, buckets) if buckets else (h.unionByName(n), H.SUBJECT)
    x = H.history_columns(both, prev_ignore_nulls=True, hot_rows=hot_rows, order=H.asof_order(), keys=[key])
    x = H.with_scalar(x.where(F.col("_side") == 1).withColumnRenamed(key, "SubjectID"), t0).select(
        *carried, first,
        F.coalesce(whole_days(F.col("PrevRankUpdateDT"), F.col("UpdateDT")), F.lit(0)).cast("bigint").alias("DaysSincePrev"),
        F.coalesce(F.col("PrevRank"), F.lit(0)).cast("int").alias("PrevRank"),
        F.coalesce(F.col("AvgPreviousRanks"), F.lit(0.0)).alias("AvgPreviousRanks"),
        F.coalesce(F.col("AvgPreviousRankChanges"), F.lit(0.0)).alias("AvgPreviousRankChanges"),
        *position_columns(vocab),
    )
    alone = H.with_scalar(anonymous, t0).select(*carried, first, *zeros, *position_columns(vocab))
    return x.unionByName(alone)


def input_defaults(df: DataFrame) -> DataFrame:
    """SubjectID -> NewSubjectID if that column is there and filled, else the given id, else
    'new_input'; blank factors -> NULL."""
    given = [blank_to_null(F.trim(F.col(c).cast("string"))) for c in ("NewSubjectID", "SubjectID") if c in df.columns]
    sid = F.coalesce(*given, F.lit(NEW_SUBJECT))
    return df.withColumn("SubjectID", sid).withColumns({d: blank_to_null(d) for d in DRIVERS if d in df.columns})


def reference_scalars(reference: DataFrame) -> DataFrame:
    """One row: first time and mean rank of the reference data."""
    return reference.agg(F.min("UpdateDT").alias("_ref_t0"), F.avg("Rank").alias("_ref_mean_rank"))


def base_features(inputs: DataFrame, reference: DataFrame, vocab: list[str],
                  id_cols: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Base feature sets (positional, one-hot) for input rows given reference data.

    Calendar fields, whole days since the reference's first time, PrevRank
    given or else the reference mean rank (else 50), RankChange 0, factor
    positions (highest driver wins on repeats) or driver-by-factor one-hot.
    """
    id_cols = id_cols or []
    x = input_defaults(inputs)
    x = H.with_scalar(x, reference_scalars(reference))
    prev = (F.col("PrevRank").cast("double") if "PrevRank" in inputs.columns
            else F.coalesce(F.col("_ref_mean_rank"), F.lit(DEFAULT_PREV_RANK)))
    x = calendar_columns(x).withColumns({
        "DaysSinceFirst": F.coalesce(whole_days(F.col("_ref_t0"), F.col("UpdateDT")), F.lit(0)).cast("bigint"),
        "DaysSincePrev": F.lit(0).cast("bigint"),
        "PrevRank": prev,
        "RankChange": F.lit(0).cast("int"),
    })
    common = [*id_cols, "SubjectID", "Rank", "UpdateDT", "Year", "Month", "DayOfMonth", "DayOfWeek",
              "DaysSinceFirst", "DaysSincePrev", "PrevRank", "RankChange"]
    positional = x.select(*common, *position_columns(vocab, last=True, suffix="_Position"))
    onehot = x.select(*common, *onehot_columns(vocab))
    return positional, onehot


def align_features(df: DataFrame, saved_columns: list[str]) -> DataFrame:
    """Select the saved feature columns in stored order; missing ones become 0."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(0).alias(c) for c in saved_columns])


def scale_columns(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """z-score with sample std of ``fit_on`` (default: df) when std > 0, else unchanged."""
    fit = fit_on if fit_on is not None else df
    stats = fit.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"_s_{c}") for c in cols])
    x = H.with_scalar(df, stats)
    x = x.withColumns({c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}"))
                          .otherwise(F.col(c).cast("double")) for c in cols})
    return x.drop(*[f"_m_{c}" for c in cols], *[f"_s_{c}" for c in cols])
