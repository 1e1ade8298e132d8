"""Serving features by hand: observed history only, anonymous rows apart, row-bounded hot segments."""

import datetime as dt

from pyspark.sql import functions as F

from rankline.operators import features as FE
from rankline.operators import history as H
from rankline.plans import models as ML
from rankline.schema import DRIVERS, RANKINGS
from rankline.sources import store
from rankline.streaming.jobs import score_rows, stream_score, unkeyed_predictions
from rankline.plans.q_history import FIXTURE_VOCAB
from rankline.sources.fixtures import view
from testdata import SF_SMALL

DAY = dt.datetime(2022, 5, 1)


def at(days):
    return DAY + dt.timedelta(days=days)


def history(spark, rows):
    full = [(s, r, *(["Factor1"] + [None] * 16), t, m is None, m) for s, r, t, m in rows]
    return spark.createDataFrame(full, RANKINGS)


def inputs(spark, rows):
    schema = "event_id long, SubjectID string, " + ", ".join(f"{d} string" for d in DRIVERS) + ", UpdateDT timestamp_ntz"
    return spark.createDataFrame([(i, s, *(["Factor1"] + [""] * 16), t) for i, s, t in rows], schema)


def served(spark, hist, new, **kw):
    n = new.withColumn("SubjectID", F.expr("try_cast(nullif(SubjectID, '') AS BIGINT)"))
    return {r.event_id: r for r in FE.serving_features(hist, n, ["Factor1"], **kw).collect()}


def test_predictions_are_no_history(spark):
    hist = history(spark, [(1, 10, at(0), None), (1, 200, at(1), "XGBoost"), (1, 90, at(1), "Random Forest")])
    new = inputs(spark, [(1, "1", at(3))])
    r = served(spark, hist, new)[1]
    assert (r.PrevRank, r.AvgPreviousRanks, r.DaysSincePrev, r.DaysSinceFirst) == (10, 10.0, 3, 3)
    r = served(spark, hist, new, history_model="XGBoost")[1]
    assert (r.PrevRank, r.AvgPreviousRanks, r.DaysSincePrev) == (200, 105.0, 2)


def test_new_rows_do_not_precede_each_other(spark):
    hist = history(spark, [(1, 10, at(0), None)])
    got = served(spark, hist, inputs(spark, [(1, "1", at(12)), (2, "1", at(22)), (3, "1", at(0))]))
    assert [got[i].DaysSincePrev for i in (1, 2, 3)] == [12, 22, 0]
    assert [got[i].PrevRank for i in (1, 2, 3)] == [10, 10, 10]  # a history row at the same time precedes


def test_rows_without_a_subject_have_no_history(spark):
    hist = history(spark, [(1, 10, at(0), None), (None, 50, at(1), None)])
    got = served(spark, hist, inputs(spark, [(1, "", at(5)), (2, None, at(15))]))
    assert [(got[i].PrevRank, got[i].DaysSincePrev, got[i].AvgPreviousRanks) for i in (1, 2)] == [(0, 0, 0.0)] * 2
    n = inputs(spark, [(1, "", at(5)), (2, "1", at(15))]).withColumn("SubjectID", F.expr("try_cast(nullif(SubjectID, '') AS BIGINT)"))
    asof = {r.event_id: r.prev_rank for r in H.asof_prev_rank(hist, n).collect()}
    assert asof == {1: None, 2: 10}


def test_both_sides_of_the_broadcast_switch(spark):
    hist, new = view(spark, SF_SMALL, "rankings"), view(spark, SF_SMALL, "inputs").withColumn(
        "SubjectID", F.expr("try_cast(SubjectID AS BIGINT)"))
    a = FE.serving_features(hist, new, FIXTURE_VOCAB)
    b = FE.serving_features(hist, new, FIXTURE_VOCAB, broadcast_subjects=0)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_inputs_without_a_factor_are_not_scored(spark):
    hist = history(spark, [(1, 10, at(0), None)])
    new = inputs(spark, [(1, "1", at(1)), (2, "1", at(2))]).withColumn("Driver1", F.when(F.col("event_id") == 1, "Factor1").otherwise(""))
    got = score_rows(hist, new, ML.LinearScorer({"PrevRank": 2.0}), ["Factor1"], "Linear").collect()
    assert [(r.event_id, r.Rank, r.Driver1) for r in got] == [(1, 20, "Factor1")]


def test_order_of_stream_files_does_not_matter(spark, tmp_path):
    hist = view(spark, SF_SMALL, "rankings")
    new = view(spark, SF_SMALL, "inputs")
    out = []
    for k, parts in enumerate((["event_id % 2 = 0", "event_id % 2 = 1"], ["event_id % 2 = 1", "event_id % 2 = 0"])):
        base = f"{tmp_path}/{k}"
        store.create_if_absent(spark, f"{base}/table", buckets=2)
        store.insert(spark, f"{base}/table", hist)
        for i, p in enumerate(parts):
            new.where(p).coalesce(1).write.mode("append").parquet(f"{base}/source")
            q = stream_score(spark, f"{base}/source", new.schema, f"{base}/table", f"{base}/ckpt",
                             ML.LinearScorer({"PrevRank": 0.5, "AvgPreviousRanks": 0.25}), FIXTURE_VOCAB, "Linear",
                             unkeyed_path=f"{base}/unkeyed")
            q.awaitTermination()
        out.append(store.read(spark, f"{base}/table").where("Model = 'Linear'"))
        blank = new.where("nullif(SubjectID, '') IS NULL AND nullif(Driver1, '') IS NOT NULL").count()
        assert unkeyed_predictions(spark, f"{base}/unkeyed").count() == blank
    assert out[0].count() > 0 and out[0].exceptAll(out[1]).count() == 0 and out[1].exceptAll(out[0]).count() == 0


def test_segments_are_bounded_by_rows(spark):
    rows = [(1, (i * 7) % 265 + 1, at(0) if i == 0 else at(1000) + dt.timedelta(seconds=i), None) for i in range(2000)]
    rows += [(2, i % 265 + 1, at(5), None) for i in range(2000)] + [(3, 9, at(i), None) for i in range(5)]
    df = history(spark, rows).select("SubjectID", "Rank", "UpdateDT", "Model").withColumn("x", F.monotonically_increasing_id())
    plain = H.history_columns(df, hot_rows=None)
    split = H.history_columns(df, hot_rows=100, segment_rows=100)
    cols = ["SubjectID", "UpdateDT", "Rank", "ObsNumber", "PrevRank", "AvgPreviousRanks", "AvgPreviousRankChanges"]
    a, b = plain.where("SubjectID <> 2").select(*cols), split.where("SubjectID <> 2").select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    # rows that tie in time and rank may swap places; ranks and counts agree all the same
    two = ["Rank", "ObsNumber", "PrevRank"]
    a, b = plain.where("SubjectID = 2").select(*two), split.where("SubjectID = 2").select(*two)
    assert a.exceptAll(b).count() == 0
    hot = H._hot_subjects(df, 100)
    seen = []
    real = H.cut_lineage
    H.cut_lineage = lambda d: seen.append(real(d)) or seen[-1]
    try:
        H.history_columns(df, hot_rows=100, segment_rows=100)
    finally:
        H.cut_lineage = real
    sizes = [r["count"] for r in seen[0].groupBy("_seg").count().collect()]
    assert hot.count() == 2 and max(sizes) <= 400 and len(sizes) >= 20
