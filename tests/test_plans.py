"""Plan shape: one exchange for the flagship windows, pushed filters, no single-partition step."""

from pyspark.sql import functions as F

from rankline.operators import features as FE
from rankline.plans.q_history import FIXTURE_VOCAB
from rankline.sources.fixtures import view
from testdata import SF_MID


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_single_shuffle_by_subject(spark):
    df = FE.rank_features(view(spark, SF_MID, "rankings"), FIXTURE_VOCAB, hot_rows=None)
    p = _plan(df)
    assert p.count("Exchange hashpartitioning") == 1   # dedup + both window nodes share it
    # the only single-partition step is the final merge of per-task partial min()s (one row each)
    lines = p.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert "partial_min" in lines[i + 1]


def test_subject_filter_reaches_scan(spark):
    df = FE.rank_features(view(spark, SF_MID, "rankings"), FIXTURE_VOCAB, hot_rows=None)
    p = _plan(df.where(F.col("SubjectID") == 7))
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,7)]" in p


def test_column_pruning(spark):
    df = view(spark, SF_MID, "rankings").select("SubjectID", "Rank").groupBy("SubjectID").count()
    assert "ReadSchema: struct<user_id:bigint>" in _plan(df)


def test_bucketed_table_needs_no_shuffle(spark):
    from rankline.sources.ingest import save_bucketed
    save_bucketed(view(spark, SF_MID, "rankings"), "rankings_bucketed", 8)
    t = spark.table("rankings_bucketed")
    df = FE.rank_features(t, FIXTURE_VOCAB, hot_rows=None, clustered=True)
    p = _plan(df)
    assert "Exchange hashpartitioning" not in p
    plain = FE.rank_features(view(spark, SF_MID, "rankings"), FIXTURE_VOCAB, hot_rows=None)
    assert df.exceptAll(plain).count() == 0 and plain.exceptAll(df).count() == 0


def _exchanges_over_history(plan):
    """Hash exchanges that lie above a scan of the bucketed table."""
    lines, found = plan.splitlines(), []
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            depth = len(line) - len(line.lstrip(" :|*+-"))
            below = []
            for other in lines[i + 1:]:
                if len(other) - len(other.lstrip(" :|*+-")) <= depth:
                    break
                below.append(other)
            found.append(any("rankings_by_subject" in x for x in below))
    return found


def test_asof_and_serving_do_not_shuffle_a_bucketed_history(spark):
    from rankline.operators import history as H
    from rankline.sources.ingest import save_bucketed
    hist = view(spark, SF_MID, "rankings")
    save_bucketed(hist, "rankings_by_subject", 8)
    t = spark.table("rankings_by_subject")
    new = view(spark, SF_MID, "inputs").withColumn("SubjectID", F.expr("try_cast(SubjectID AS BIGINT)"))
    for stored, plain in ((H.asof_prev_rank(t, new, hot_rows=None, buckets=8), H.asof_prev_rank(hist, new, hot_rows=None)),
                          (FE.serving_features(t, new, FIXTURE_VOCAB, hot_rows=None, buckets=8),
                           FE.serving_features(hist, new, FIXTURE_VOCAB, hot_rows=None))):
        p = _plan(stored)
        assert "Bucketed: true" in p
        assert not any(_exchanges_over_history(p)) and _exchanges_over_history(p)
        assert stored.exceptAll(plain).count() == 0 and plain.exceptAll(stored).count() == 0
    # the hot-subject split gives the same values on a bucketed table
    split, plain = H.asof_prev_rank(t, new, force_split=True, buckets=8), H.asof_prev_rank(hist, new)
    assert split.exceptAll(plain).count() == 0 and plain.exceptAll(split).count() == 0
