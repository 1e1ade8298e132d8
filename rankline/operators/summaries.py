"""Serving features from per-slice summaries of the stored history.

The history of a table with a commit log (``sources.store``) is condensed to one row per subject and
slice: number and sum of the known ranks, number and sum of the rank changes inside the slice, the
first and the last known rank, and the last one's time.  Summaries of consecutive slices merge: counts and
sums add up, and the step from one slice's last rank to the next one's first is one more change.  So
the history of a subject before any moment is the merger of its earlier slices' summaries and of
its rows in the moment's own slice.

Summaries are files of the table's log, one or more per (slice, bucket), each made from the commits up to one
number.  An observation that arrives late makes the summary of its slice out of date and no
other; ``refresh`` makes those anew and reads only their slices.  A summary that is out of date is never
used: the rows of its (slice, bucket) are read instead, so features do not depend on when ``refresh`` ran.
Only observed rows count; stored predictions make nothing out of date.

What a batch reads: summaries of its subjects' buckets up to its last slice, and rows of its own
(slice, bucket) pairs and of pairs without an up-to-date summary.  One window per subject over these
rows, most of them one per slice, makes all features.  A subject's rows in one slice are one window's: choose
the table's period so that they fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from rankline.functions.columns import blank_to_null, whole_days
from rankline.operators import history as H
from rankline.operators.factors import position_columns
from rankline.operators.features import SERVING_BROADCAST_SUBJECTS
from rankline.schema import DRIVERS
from rankline.session import cut_lineage
from rankline.sources import store as S

SUMMARY = ("SubjectID bigint, n bigint, total bigint, first_rank int, last_rank int, last_time timestamp_ntz, "
           "changes bigint, change_total bigint")


def summarise(observed: DataFrame, hot_rows: int | None = H.HOT_ROWS) -> DataFrame:
    """(SubjectID, _slice, _bucket and the columns of ``SUMMARY``) of placed rows; rows without a rank add nothing."""
    known = observed.select("SubjectID", "_slice", "_bucket", "UpdateDT", "Model", "Rank").where(F.col("Rank").isNotNull())
    x = H.history_columns(known, keys=["SubjectID", "_slice"], hot_rows=hot_rows)
    at = F.struct("ObsNumber", "Rank", "UpdateDT")
    return x.groupBy("SubjectID", "_slice", "_bucket").agg(
        F.count("Rank").alias("n"), F.sum("Rank").cast("bigint").alias("total"),
        F.min(at)["Rank"].alias("first_rank"), F.max(at)["Rank"].alias("last_rank"), F.max(at)["UpdateDT"].alias("last_time"),
        F.count("RankChange").alias("changes"),
        F.coalesce(F.sum("RankChange"), F.lit(0)).cast("bigint").alias("change_total"))


def _standing(spark: SparkSession, path: str) -> DataFrame:
    """(slice, bucket, data, upto, made): the last commit with observed rows; the last commit that a summary
    covers and the commit of that summary (NULL: none)."""
    entries = S.log(spark, path)
    data = F.max(F.when((F.col("kind") == "rows") & (F.col("observed") > 0), S.data_commit()))
    best = F.max(F.when(F.col("kind") == "summary", F.struct("upto", "commit")))
    return (entries.where(F.col("kind").isin("rows", "summary")).groupBy("slice", "bucket")
            .agg(data.alias("data"), best.alias("best")).where(F.col("data").isNotNull())
            .select("slice", "bucket", "data", F.col("best.upto").alias("upto"), F.col("best.commit").alias("made")))


def _out_of_date() -> Column:
    return F.coalesce(F.col("upto") < F.col("data"), F.lit(True))


def observed_rows(files: DataFrame) -> DataFrame:
    return files.where(F.col("observed") > 0)


def refresh(spark: SparkSession, path: str, attempts: int = 50) -> int:
    """Summarise anew what is out of date; returns the number of (slice, bucket) pairs."""
    upto = S.head(spark, path)
    pairs = cut_lineage(_standing(spark, path).where(_out_of_date()).select("slice", "bucket"))
    n = pairs.count()
    if not n:
        return 0
    files = observed_rows(S.files_of(spark, path, version=upto)).join(pairs, ["slice", "bucket"], "left_semi")
    rows = S.read_files(spark, path, files).where(F.col("Model").isNull())
    rows = summarise(S.placed(rows, S.layout(spark, path)))
    found = cut_lineage(S.logged(S.write_files(spark, path, rows), "summary", upto=upto))
    # a pair without a known rank has no file; its entry says that it is up to date all the same
    none = pairs.join(found.select("slice", "bucket"), ["slice", "bucket"], "left_anti")
    entries = found.unionByName(S.logged(none, "summary", upto=upto))
    for _ in range(attempts):
        # summaries say up to where they reach, so commits made meanwhile do no harm
        if S.commit(spark, path, S.head(spark, path) + 1, entries):
            return n
    raise S.Conflict(f"no commit after {attempts} attempts")


def history_items(spark: SparkSession, path: str, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, summaries) of the table that a placed batch needs."""
    mine = cut_lineage(batch.select(F.col("_slice").alias("slice"), F.col("_bucket").alias("bucket")).distinct())
    until = mine.groupBy("bucket").agg(F.max("slice").alias("until"))
    standing = _standing(spark, path).join(until, "bucket").where(F.col("slice") <= F.col("until"))
    own = mine.withColumn("own", F.lit(True))
    pairs = cut_lineage(standing.join(own, ["slice", "bucket"], "left")
                        .select("slice", "bucket", F.col("made").alias("commit"),
                                (F.col("own").isNotNull() | _out_of_date()).alias("as_rows")))
    as_rows = pairs.where("as_rows")
    files = observed_rows(S.files_of(spark, path)).join(as_rows, ["slice", "bucket"], "left_semi")
    rows = S.read_files(spark, path, files).where(F.col("Model").isNull())
    used = S.files_of(spark, path, "summary").where(F.col("file").isNotNull()).join(
        pairs.where(~F.col("as_rows")), ["slice", "bucket", "commit"], "left_semi")
    kept = S.read_files(spark, path, used, SUMMARY + ", _slice string").withColumn("_slice", S.slice_in_path())
    return rows, kept


def first_time(spark: SparkSession, path: str) -> DataFrame:
    """The first time of an observed row, from the log alone."""
    return S.files_of(spark, path).agg(F.min("first_time").alias("_t_first"))


def serving_features(spark: SparkSession, path: str, new_rows: DataFrame, vocab: list[str], id_col: str = "event_id",
                     first: DataFrame | None = None, keep: list[str] | None = None,
                     broadcast_subjects: int = SERVING_BROADCAST_SUBJECTS) -> DataFrame:
    """What ``operators.features.serving_features`` gives for the table's observed rows."""
    keep = keep or []
    more = [c for c in keep if c not in DRIVERS]
    where = S.layout(spark, path)
    new = new_rows.select(id_col, F.col("SubjectID").cast("bigint").alias("SubjectID"), "UpdateDT",
                          *[blank_to_null(d).alias(d) for d in DRIVERS], *more)
    known = S.placed(new.where(F.col("SubjectID").isNotNull()), where)
    rows, kept = history_items(spark, path, known)
    subjects = known.select("SubjectID").distinct()
    if subjects.count() <= broadcast_subjects:
        subjects = F.broadcast(subjects)
    rows = S.placed(rows.join(subjects, "SubjectID", "left_semi"), where).where(F.col("Rank").isNotNull())
    kept = kept.join(subjects, "SubjectID", "left_semi")
    types = dict(new.dtypes)
    others = [c for c in new.columns if c not in ("SubjectID", "UpdateDT")]
    blank = [F.lit(None).cast(types[c]).alias(c) for c in others]
    item = ["n", "total", "first_rank", "last_rank", "last_time", "changes", "change_total"]
    side = lambda k: F.lit(k).alias("_side")
    of_row = rows.select("SubjectID", "_slice", "UpdateDT", side(0), F.lit(1).cast("bigint").alias("n"),
                         F.col("Rank").cast("bigint").alias("total"), F.col("Rank").alias("first_rank"),
                         F.col("Rank").alias("last_rank"), F.col("UpdateDT").alias("last_time"),
                         F.lit(0).cast("bigint").alias("changes"), F.lit(0).cast("bigint").alias("change_total"), *blank)
    of_slice = kept.select("SubjectID", "_slice", F.col("last_time").alias("UpdateDT"), side(0), *item, *blank)
    kinds = dict(of_row.dtypes)
    of_new = known.select("SubjectID", "_slice", "UpdateDT", side(1),
                          *[F.lit(None).cast(kinds[c]).alias(c) for c in item], *others)
    # a slice's summary stands alone in its slice, so slices order it; rows of one slice go by time
    w = W.partitionBy("SubjectID").orderBy("_slice", F.col("UpdateDT").asc_nulls_first(), "_side", F.col("last_rank").asc_nulls_first())
    before = w.rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("_side") == 0, F.struct(F.col("last_rank").alias("r"), F.col("last_time").alias("t"))), True)
    x = of_row.unionByName(of_slice).unionByName(of_new).withColumn("_prev", last.over(before))
    x = x.withColumns({"_n": F.sum("n").over(before), "_total": F.sum("total").over(before),
                       "_step": F.col("first_rank") - F.col("_prev.r")})
    x = x.withColumns({"_changes": F.sum(F.col("changes") + F.col("_step").isNotNull().cast("bigint")).over(before),
                       "_change_total": F.sum(F.col("change_total") + F.coalesce("_step", F.lit(0))).over(before)})
    t0 = first if first is not None else first_time(spark, path)
    since = F.coalesce(whole_days(F.col("_t_first"), F.col("UpdateDT")), F.lit(0)).cast("bigint").alias("DaysSinceFirst")
    carried = [id_col, "SubjectID", "UpdateDT", *keep]
    out = H.with_scalar(x.where(F.col("_side") == 1), t0).select(
        *carried, since,
        F.coalesce(whole_days(F.col("_prev.t"), F.col("UpdateDT")), F.lit(0)).cast("bigint").alias("DaysSincePrev"),
        F.coalesce(F.col("_prev.r"), F.lit(0)).cast("int").alias("PrevRank"),
        F.coalesce(F.when(F.col("_n") > 0, F.col("_total") / F.col("_n")), F.lit(0.0)).alias("AvgPreviousRanks"),
        F.coalesce(F.when(F.col("_changes") > 0, F.col("_change_total") / F.col("_changes")), F.lit(0.0)).alias("AvgPreviousRankChanges"),
        *position_columns(vocab))
    zeros = [F.lit(0).cast("bigint").alias("DaysSincePrev"), F.lit(0).alias("PrevRank"),
             F.lit(0.0).alias("AvgPreviousRanks"), F.lit(0.0).alias("AvgPreviousRankChanges")]
    alone = H.with_scalar(new.where(F.col("SubjectID").isNull()), t0).select(*carried, since, *zeros, *position_columns(vocab))
    return out.unionByName(alone)
