import datetime as dt

from pyspark.sql import functions as F

from rankline.operators import history as H
from rankline.operators.reports import subject_lookup
from rankline.sources.fixtures import view
from testdata import SF_MID, SF_SMALL


def _hist(spark):
    rows = [(1, 10, dt.datetime(2023, 1, 1)), (1, 15, dt.datetime(2023, 1, 15)), (2, 20, dt.datetime(2023, 1, 10))]
    return spark.createDataFrame(rows, "SubjectID long, Rank int, UpdateDT timestamp_ntz")


def test_subject_summary_found(spark):
    s = {r.SubjectID: r for r in H.subject_summary(_hist(spark)).collect()}[1]
    assert (s.previous_rank, s.num_records, s.avg_rank, s.min_rank, s.max_rank) == (15, 2, 12.5, 10, 15)
    assert s.last_update == dt.datetime(2023, 1, 15)


def test_subject_unknown_gets_nulls_and_zero(spark):
    ids = spark.createDataFrame([(999,)], "SubjectID long")
    r = subject_lookup(_hist(spark), ids).first()
    assert r.num_records == 0 and r.previous_rank is None and r.avg_rank is None


def test_history_columns_basic(spark):
    rows = H.history_columns(_hist(spark)).where("SubjectID = 1").orderBy("UpdateDT").collect()
    assert [r.PrevRank for r in rows] == [None, 10]
    assert [r.RankChange for r in rows] == [None, 5]
    assert [r.ObsNumber for r in rows] == [0, 1]
    assert [r.AvgPreviousRanks for r in rows] == [None, 10.0]
    # leaky back-fill: the first row sees the second row's mean (its own rank)
    assert [r.AvgPreviousRanksFilled for r in rows] == [10.0, 10.0]


def _norm(df):
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def test_split_path_equals_plain_path(spark):
    r = view(spark, SF_MID, "rankings")
    r = r.withColumn("Rank", F.when(F.hash("UpdateDT") % 5 == 0, F.lit(None)).otherwise(F.col("Rank")))
    cols = ["SubjectID", "UpdateDT", "Model", "Rank", *H.HISTORY_COLS]
    for ign in (False, True):
        a = _norm(H.history_columns(r, prev_ignore_nulls=ign, hot_rows=None).select(*cols))
        b = _norm(H.history_columns(r, prev_ignore_nulls=ign, force_split=True, segment_rows=5).select(*cols))
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_hot_subject_detection_routes_to_split(spark):
    r = view(spark, SF_SMALL, "rankings")
    # every subject above the threshold -> split path; result identical
    a = _norm(H.history_columns(r, hot_rows=None))
    b = _norm(H.history_columns(r, hot_rows=10, segment_rows=7))
    assert a.exceptAll(b.select(*a.columns)).count() == 0


def test_leak_free_features_ignore_future_rows(spark):
    r = view(spark, SF_SMALL, "rankings")
    cut = r.agg(F.percentile_approx(F.unix_micros(F.col("UpdateDT").cast("timestamp")), 0.5)).first()[0]
    early = r.where(F.unix_micros(F.col("UpdateDT").cast("timestamp")) <= cut)
    cols = ["SubjectID", "UpdateDT", "PrevRank", "AvgPreviousRanks", "AvgPreviousRankChanges", "ObsNumber"]
    a = _norm(H.history_columns(early).select(*cols))
    b = _norm(H.history_columns(r).select(*cols)).join(early.select("SubjectID", "UpdateDT"), ["SubjectID", "UpdateDT"])
    assert a.exceptAll(b.select(*cols)).count() == 0


def test_result_independent_of_partitioning(spark):
    r = view(spark, SF_SMALL, "rankings")
    a = _norm(H.history_columns(r.repartition(1)))
    b = _norm(H.history_columns(r.repartition(7, "Rank")))
    assert a.exceptAll(b).count() == 0


def test_asof_inclusive_and_strict_subject(spark):
    hist = _hist(spark)
    new = spark.createDataFrame([(1, 1, dt.datetime(2023, 1, 14)), (2, 1, dt.datetime(2023, 1, 15)),
                                 (3, 2, dt.datetime(2023, 1, 10)), (4, 3, dt.datetime(2023, 1, 10))],
                                "event_id long, SubjectID long, UpdateDT timestamp_ntz")
    got = {r.event_id: r.prev_rank for r in H.asof_prev_rank(hist, new).collect()}
    assert got == {1: 10, 2: 15, 3: 20, 4: None}


def test_asof_split_path_equals_plain(spark):
    r = view(spark, SF_SMALL, "rankings")
    new = view(spark, SF_SMALL, "inputs").select("event_id", F.expr("try_cast(SubjectID AS BIGINT)").alias("SubjectID"),
                                                  (F.col("UpdateDT") + F.expr("INTERVAL 1 HOUR")).alias("UpdateDT"))
    a = H.asof_prev_rank(r, new, hot_rows=None)
    b = H.asof_prev_rank(r, new, force_split=True)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_rank_series_split_path_equals_plain(spark):
    from rankline.operators.reports import rank_series
    m = view(spark, SF_SMALL, "rankings_multi")
    a = rank_series(m, hot_rows=10 ** 9)
    b = rank_series(m, hot_rows=5)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_one_subject_with_a_third_of_rows(spark):
    """A realistic skew: subject 0 holds a third of all rows; only it is split."""
    from rankline.operators import features as FE
    from rankline.plans.q_history import FIXTURE_VOCAB
    r = view(spark, SF_MID, "rankings")
    skewed = r.withColumn("SubjectID", F.when(F.hash("UpdateDT") % 3 == 0, F.lit(0).cast("bigint"))
                          .otherwise(F.col("SubjectID")))
    hot = H._hot_subjects(skewed, 1000).collect()
    assert [row.SubjectID for row in hot] == [0]
    a = _norm(FE.rank_features(skewed, FIXTURE_VOCAB, hot_rows=None))
    b = _norm(FE.rank_features(skewed, FIXTURE_VOCAB, hot_rows=1000, segment_rows=300))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
