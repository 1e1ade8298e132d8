"""Per-subject history: lag, running means, observation number, latest row.

All windows are ``PARTITION BY SubjectID ORDER BY UpdateDT`` with a fixed
tie-break (Model NULLS FIRST, Rank), so one exchange + one sort serves every
column.  Other keys / orders (a series per subject and model, the as-of
union) reuse the same machinery.

A subject holding a large share of all rows would put that share into one
window task.  ``history_columns`` therefore checks the per-subject row counts
first (a partial aggregate of one column) and, for subjects above
``hot_rows``, splits the subject into segments of about ``segment_rows`` rows
along the window order: windows run per (subject, segment), a small per-segment summary carries counts, sums, the
boundary row and the last known rank across segments, and a join on
NULL-free internal keys puts the carry back without a second shuffle of the
rows.  Both paths give identical values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from rankline.functions.columns import whole_days
from rankline.session import cut_lineage

SUBJECT = "SubjectID"
TIME = "UpdateDT"


def order_cols() -> list[Column]:
    return [F.col(TIME).asc_nulls_first(), F.col("Model").asc_nulls_first(), F.col("Rank").asc_nulls_first()]


# Rows per subject above which a subject is split into time segments, and the
# target rows per segment.  Tunable per call; defaults sized for executor memory.
HOT_ROWS = 4_000_000
SEGMENT_ROWS = 1_000_000
# Largest hot-subject list joined by broadcast (its size is counted first).
BROADCAST_KEYS = 200_000

HISTORY_COLS = ["PrevRank", "PrevUpdateDT", "PrevRankUpdateDT", "RankChange", "ObsNumber",
                "AvgPreviousRanks", "AvgPreviousRankChanges", "AvgPreviousRanksFilled"]


def asof_order() -> list[Column]:
    """Order of a union of history (_side 0) and new rows (_side 1): a history row at the same time precedes."""
    return [F.col(TIME).asc_nulls_first(), F.col("_side"), F.col("Model").asc_nulls_first(),
            F.col("Rank").asc_nulls_first()]


def profile(df: DataFrame) -> tuple[int, object]:
    """(rows of the largest subject, first time) in one pre-aggregated pass."""
    per = df.groupBy(SUBJECT).agg(F.count(F.lit(1)).alias("n"), F.min(TIME).alias("t"))
    r = per.agg(F.max("n"), F.min("t")).first()
    return int(r[0] or 0), r[1]


def _ensure_model(df: DataFrame) -> tuple[DataFrame, bool]:
    if "Model" in df.columns:
        return df, False
    return df.withColumn("Model", F.lit(None).cast("string")), True


def history_columns(df: DataFrame, prev_ignore_nulls: bool = False,
                    hot_rows: int | None = HOT_ROWS, segment_rows: int = SEGMENT_ROWS,
                    force_split: bool = False, dedup: bool = False,
                    keys: list[str] | None = None, order: list[Column] | None = None,
                    clustered: bool = False) -> DataFrame:
    """Add HISTORY_COLS.

    PrevRank      rank of the previous row (or previous non-null rank when
                  ``prev_ignore_nulls``), NULL on the first row
    PrevUpdateDT  time of the previous row
    PrevRankUpdateDT  time of the row PrevRank comes from
    RankChange    Rank - PrevRank
    ObsNumber     0-based row number within the subject
    AvgPreviousRanks        mean of earlier non-null ranks, NULL if none
    AvgPreviousRankChanges  mean of earlier non-null RankChange, NULL if none
    AvgPreviousRanksFilled  AvgPreviousRanks back-filled within the subject
                            (the leaky variant: the first row sees row 2's mean)

    ``keys`` (default SubjectID) and ``order`` (default time, Model, Rank) set
    the window.  ``dedup`` drops whole-row duplicates first, clustered on the
    same keys as the windows (duplicates share them), so it adds no exchange.
    ``clustered`` says the input is already hash-clustered by the keys (a table
    bucketed by SubjectID): then neither the dedup nor the windows shuffle.
    """
    df, added = _ensure_model(df)
    keys = keys or [SUBJECT]
    order = order or order_cols()
    hot = None
    if force_split:
        hot = _hot_subjects(df, 0, keys)
    elif hot_rows is not None:
        candidate = _hot_subjects(df, hot_rows, keys)
        if candidate.limit(1).count() > 0:
            hot = candidate
    if hot is None:
        if dedup:
            df = (df if clustered else df.repartition(*keys)).dropDuplicates()
        out = _plain(df, prev_ignore_nulls, keys, order)
    else:
        out = _segmented(df, hot, prev_ignore_nulls, segment_rows, dedup, keys, order)
    return out.drop("Model") if added else out


def _plain(df: DataFrame, ignore_nulls: bool, keys: list[str], order: list[Column]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    after = w.rowsBetween(W.currentRow, W.unboundedFollowing)
    lag_t = F.lag(TIME).over(w)
    if ignore_nulls:
        known = F.last(F.when(F.col("Rank").isNotNull(), F.struct(F.col("Rank").alias("r"), F.col(TIME).alias("t"))),
                       True).over(before)
        prev, prev_t = known["r"], known["t"]
    else:
        prev, prev_t = F.lag("Rank").over(w), lag_t
    x = df.select(
        "*",
        prev.alias("PrevRank"),
        lag_t.alias("PrevUpdateDT"),
        prev_t.alias("PrevRankUpdateDT"),
        (F.row_number().over(w) - 1).cast("bigint").alias("ObsNumber"),
        F.avg("Rank").over(before).alias("AvgPreviousRanks"),
    )
    x = x.withColumn("RankChange", F.col("Rank") - F.col("PrevRank"))
    return x.select(
        "*",
        F.avg("RankChange").over(before).alias("AvgPreviousRankChanges"),
        F.first("AvgPreviousRanks", True).over(after).alias("_bfill"),
    ).withColumn("AvgPreviousRanksFilled", F.coalesce("AvgPreviousRanks", "_bfill")).drop("_bfill")


def _hot_subjects(df: DataFrame, hot_rows: int, keys: list[str] | None = None) -> DataFrame:
    return (df.groupBy(*(keys or [SUBJECT])).agg(F.count(F.lit(1)).alias("_n"))
              .where(F.col("_n") > F.lit(hot_rows)))


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join where NULL keys match (windows treat a NULL key as one group too)."""
    r = right.select(*[F.col(k).alias(f"_rk_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_rk_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_rk_{k}" for k in keys])


def _segmented(df: DataFrame, hot: DataFrame, ignore_nulls: bool, segment_rows: int,
               dedup: bool, keys: list[str], order: list[Column]) -> DataFrame:
    cols = df.columns
    n_hot, n_rows = hot.agg(F.count(F.lit(1)), F.sum("_n")).first()
    hot = hot.select(*keys, F.lit(True).alias("_hot"))
    if n_hot <= BROADCAST_KEYS:
        hot = F.broadcast(hot)
    x = _join_null_safe(df, hot, keys, "left")
    # Hot rows are dealt out by range over the whole window order (rows that tie by a hash of the
    # row), so a segment has about segment_rows rows however the times lie.  The rows are written
    # with their segment number: it must not change when a lost task runs again.
    tie = F.xxhash64(*cols)
    pieces = max(1, -(-int(n_rows or 0) // max(1, segment_rows)))
    cut = x.where(F.col("_hot")).drop("_hot").repartitionByRange(
        pieces, *[F.col(k).asc_nulls_first() for k in keys], *order, tie)
    cut = cut_lineage(cut.withColumn("_seg", F.spark_partition_id().cast("bigint")))
    rest = x.where(F.col("_hot").isNull()).drop("_hot").withColumn("_seg", F.lit(0).cast("bigint"))
    types = dict(df.dtypes)
    x = cut.unionByName(rest)
    # NULL-free internal keys (value, is-null flag): plain equality on them is
    # null-safe, so the carry join below reuses the windows' partitioning.
    ikeys = []
    for i, k in enumerate(keys):
        default = F.lit("") if types[k] == "string" else F.lit(0).cast(types[k])
        x = x.withColumns({f"_ik{i}": F.coalesce(F.col(k), default), f"_in{i}": F.col(k).isNull()})
        ikeys += [f"_ik{i}", f"_in{i}"]
    if dedup:
        x = x.repartition(*ikeys, "_seg").dropDuplicates(cols)

    # 1. local windows inside (keys, segment)
    wl = W.partitionBy(*ikeys, "_seg").orderBy(*order)
    before = wl.rowsBetween(W.unboundedPreceding, -1)
    after = wl.rowsBetween(W.currentRow, W.unboundedFollowing)
    known = F.when(F.col("Rank").isNotNull(), F.struct(F.col("Rank").alias("r"), F.col(TIME).alias("t")))
    x = x.select(
        "*",
        F.row_number().over(wl).alias("_rn"),
        F.lag("Rank").over(wl).alias("_lag_rank"),
        F.last(known, True).over(before).alias("_last_nn"),
        F.lag(TIME).over(wl).alias("_lag_ts"),
        F.count("Rank").over(before).alias("_cnt_b"),
        F.sum("Rank").over(before).alias("_sum_b"),
    )
    x = x.withColumn("_chg", F.col("Rank") - (F.col("_last_nn")["r"] if ignore_nulls else F.col("_lag_rank")))
    x = x.select("*", F.count("_chg").over(before).alias("_chg_cnt_b"),
                 F.sum("_chg").over(before).alias("_chg_sum_b"))

    # 2. per-segment summary (small: one row per segment)
    def at_last(c: str) -> Column:
        return F.max(F.struct(F.col("_rn"), F.col(c)))[c]

    nn = F.col("Rank").isNotNull()
    summary = x.groupBy(*ikeys, "_seg").agg(
        F.count(F.lit(1)).alias("s_rows"),
        F.count("Rank").alias("s_cnt"),
        F.sum("Rank").alias("s_sum"),
        F.max(F.when(F.col("_rn") == 1, F.col("Rank"))).alias("s_first_rank"),
        F.min(F.when(nn, F.struct(F.col("_rn"), F.col("Rank")))).alias("s_fnn"),
        F.max(F.when(nn, F.struct(F.col("_rn"), F.col("Rank").alias("r"), F.col(TIME).alias("t")))).alias("s_lnn"),
        at_last("Rank").alias("s_last_rank"),
        at_last(TIME).alias("s_last_ts"),
        F.sum("_chg").alias("s_chg_sum"),
        F.count("_chg").alias("s_chg_cnt"),
    )

    # 3. carries across segments (window over the summary, one row per segment)
    ws = W.partitionBy(*ikeys).orderBy("_seg")
    prev = ws.rowsBetween(W.unboundedPreceding, -1)
    whole = ws.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    c = summary.select(
        *ikeys, "_seg", "s_rows", "s_fnn",
        F.coalesce(F.sum("s_rows").over(prev), F.lit(0)).alias("c_rows"),
        F.coalesce(F.sum("s_cnt").over(prev), F.lit(0)).alias("c_cnt"),
        F.coalesce(F.sum("s_sum").over(prev), F.lit(0)).alias("c_sum"),
        F.lag("s_last_rank").over(ws).alias("c_prev_rank"),
        F.lag("s_last_ts").over(ws).alias("c_prev_ts"),
        F.last(F.when(F.col("s_lnn").isNotNull(),
                      F.struct(F.col("s_lnn")["r"].alias("r"), F.col("s_lnn")["t"].alias("t"))),
               True).over(prev).alias("c_prev_nn"),
        "s_first_rank", "s_chg_sum", "s_chg_cnt",
        F.sum("s_rows").over(whole).alias("subj_rows"),
    )
    # The boundary row is the first row whose change reaches into the previous
    # segment: row 1 for lag, the first non-null rank for last-non-null.
    if ignore_nulls:
        c = c.withColumns({"b_chg": F.col("s_fnn")["Rank"] - F.col("c_prev_nn")["r"], "b_rn": F.col("s_fnn")["_rn"]})
    else:
        c = c.withColumns({"b_chg": F.col("s_first_rank") - F.col("c_prev_rank"), "b_rn": F.lit(1)})
    c = c.select(
        "*",
        F.coalesce(F.sum(F.coalesce("s_chg_sum", F.lit(0)) + F.coalesce("b_chg", F.lit(0))).over(prev),
                   F.lit(0)).alias("c_chg_sum"),
        F.coalesce(F.sum(F.col("s_chg_cnt") + F.col("b_chg").isNotNull().cast("bigint")).over(prev),
                   F.lit(0)).alias("c_chg_cnt"),
        F.first(F.when(F.col("s_fnn").isNotNull(),
                       F.struct((F.col("c_rows") + F.col("s_fnn")["_rn"] - 1).alias("pos"),
                                F.col("s_fnn")["Rank"].alias("rank"))), True).over(whole).alias("subj_fnn"),
    ).drop("s_rows", "s_fnn", "s_first_rank", "s_chg_sum", "s_chg_cnt")

    # 4. join the carry back on (keys, segment); both sides are keyed the same way
    y = x.join(c, [*ikeys, "_seg"], "inner")
    first = F.col("_rn") == 1
    prev_ts = F.when(first, F.col("c_prev_ts")).otherwise(F.col("_lag_ts"))
    if ignore_nulls:
        known_prev = F.coalesce(F.col("_last_nn"), F.col("c_prev_nn"))
        prev_rank, prev_rank_ts = known_prev["r"], known_prev["t"]
    else:
        prev_rank = F.when(first, F.col("c_prev_rank")).otherwise(F.col("_lag_rank"))
        prev_rank_ts = prev_ts
    cnt = F.col("c_cnt") + F.col("_cnt_b")
    tot = F.col("c_sum") + F.coalesce("_sum_b", F.lit(0))
    past_boundary = F.coalesce(F.col("_rn") > F.col("b_rn"), F.lit(False))
    b_in = F.when(past_boundary & F.col("b_chg").isNotNull(), F.lit(1)).otherwise(F.lit(0))
    chg_cnt = F.col("c_chg_cnt") + b_in + F.col("_chg_cnt_b")
    chg_sum = (F.col("c_chg_sum") + F.when(past_boundary, F.coalesce("b_chg", F.lit(0))).otherwise(F.lit(0))
               + F.coalesce("_chg_sum_b", F.lit(0)))
    avg_prev = F.when(cnt > 0, tot.cast("double") / cnt)
    obs = (F.col("c_rows") + F.col("_rn") - 1).cast("bigint")
    later_exists = F.col("subj_fnn")["pos"] < F.col("subj_rows") - 1
    y = y.select(
        "*",
        prev_rank.alias("PrevRank"),
        prev_ts.alias("PrevUpdateDT"),
        prev_rank_ts.alias("PrevRankUpdateDT"),
        obs.alias("ObsNumber"),
        avg_prev.alias("AvgPreviousRanks"),
        F.when(chg_cnt > 0, chg_sum.cast("double") / chg_cnt).alias("AvgPreviousRankChanges"),
    )
    filled = F.coalesce(F.col("AvgPreviousRanks"),
                        F.when(later_exists, F.col("subj_fnn")["rank"].cast("double")))
    y = y.withColumn("RankChange", F.col("Rank") - F.col("PrevRank")) \
         .withColumn("AvgPreviousRanksFilled", filled)
    helper = [c for c in y.columns if c not in cols and (c.startswith(("_", "c_", "subj_")) or c in ("b_chg", "b_rn"))]
    return y.drop(*helper)


def global_first_time(df: DataFrame) -> DataFrame:
    """One-row frame with the global first UpdateDT (a scalar, broadcast on use)."""
    return df.agg(F.min(TIME).alias("_t_first"))


def with_scalar(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row (broadcast nested-loop of one row)."""
    return df.crossJoin(F.broadcast(scalars))


def days_since_prev() -> Column:
    return F.coalesce(whole_days(F.col("PrevUpdateDT"), F.col(TIME)), F.lit(0)).cast("bigint")


def latest_per_subject(df: DataFrame) -> DataFrame:
    """Latest row of every subject: the last in the order of the history windows (top-1 per group;
    planner adds WindowGroupLimit)."""
    w = W.partitionBy(SUBJECT).orderBy(F.col(TIME).desc_nulls_last(), F.col("Model").desc_nulls_last(),
                                       F.col("Rank").desc_nulls_last())
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def subject_summary(df: DataFrame) -> DataFrame:
    """previous (latest) rank, last update, count, mean / min / max rank per subject."""
    df, _ = _ensure_model(df)
    # the last row in the order of the history windows, as in latest_per_subject
    latest = F.max(F.struct(F.col(TIME), F.col("Model"), F.col("Rank")))
    return df.groupBy(SUBJECT).agg(
        latest["Rank"].alias("previous_rank"),
        F.max(TIME).alias("last_update"),
        F.count(F.lit(1)).alias("num_records"),
        F.avg("Rank").alias("avg_rank"),
        F.min("Rank").alias("min_rank"),
        F.max("Rank").alias("max_rank"),
    )


def clustered_union(history: DataFrame, new_rows: DataFrame, buckets: int, key: str = SUBJECT) -> tuple[DataFrame, str]:
    """(history and new rows as one frame, name of its key column) for a history bucketed by ``key`` into ``buckets``.

    The new rows are dealt out as the buckets are, so a window by the key needs no exchange of the history.  The key has
    another name in the result: a union keeps its sides' partitioning only by a column that both of them compute.
    """
    name = f"_{key}"
    h, n = (df.select(F.col(key).alias(name), *[c for c in df.columns if c != key]) for df in (history, new_rows))
    return h.unionByName(n.repartition(buckets, name)), name


def asof_prev_rank(history: DataFrame, new_rows: DataFrame, id_col: str = "event_id",
                   hot_rows: int | None = HOT_ROWS, force_split: bool = False, buckets: int | None = None) -> DataFrame:
    """For each new row, the latest history row with a known rank at or before its time (as-of join).

    New rows (rank unknown) are unioned with the history and ordered after
    history rows of the same time; the previous known rank is then the as-of
    match.  This reuses the history windows, including the hot-subject split,
    so each side is shuffled once by SubjectID and no pairs are formed.  A history
    that is a table bucketed by SubjectID into ``buckets`` is not shuffled at all.
    """
    id_type = dict(new_rows.dtypes)[id_col]
    history, _ = _ensure_model(history)
    h = history.select(SUBJECT, TIME, "Model", "Rank", F.lit(None).cast(id_type).alias(id_col),
                       F.lit(0).alias("_side"))
    n = new_rows.select(SUBJECT, TIME, F.lit(None).cast("string").alias("Model"),
                        F.lit(None).cast("int").alias("Rank"), F.col(id_col), F.lit(1).alias("_side"))
    # rows without a subject match nothing and stay out of the windows
    n, alone = n.where(F.col(SUBJECT).isNotNull()), n.where(F.col(SUBJECT).isNull())
    h = h.where(F.col(SUBJECT).isNotNull())
    both, key = clustered_union(h, n, buckets) if buckets else (h.unionByName(n), SUBJECT)
    x = history_columns(both, prev_ignore_nulls=True, hot_rows=hot_rows, force_split=force_split, order=asof_order(), keys=[key])
    x = x.where(F.col("_side") == 1).select(id_col, F.col(key).alias(SUBJECT), TIME, F.col("PrevRank").alias("prev_rank"),
                                            F.col("PrevRankUpdateDT").alias("prev_update"))
    none = alone.select(id_col, SUBJECT, TIME, F.lit(None).cast("int").alias("prev_rank"),
                        F.lit(None).cast(dict(x.dtypes)["prev_update"]).alias("prev_update"))
    return x.unionByName(none)
