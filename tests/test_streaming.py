import os
import tempfile

from rankline.schema import RANKINGS
from rankline.sources import store
from rankline.sources.fixtures import view
from rankline.sources.ingest import rows_to_insert
from rankline.streaming.jobs import stream_insert, stream_score
from testdata import SF_SMALL


def test_stream_insert_equals_batch_and_is_idempotent(spark):
    base = tempfile.mkdtemp()
    table, src, ckpt = (os.path.join(base, x) for x in ("t", "s", "c"))
    existing = view(spark, SF_SMALL, "rankings")
    store.create_if_absent(spark, table, buckets=2)
    store.insert(spark, table, existing)
    multi = view(spark, SF_SMALL, "rankings_multi").select(*RANKINGS.fieldNames())
    multi.repartition(3).write.parquet(src)
    multi.repartition(3).write.mode("append").parquet(src)
    stream_insert(spark, src, table, ckpt, files_per_batch=2).awaitTermination()
    got = store.read(spark, table)
    want = existing.unionByName(rows_to_insert(existing, multi))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    # restarting with the same checkpoint processes nothing new
    stream_insert(spark, src, table, ckpt, files_per_batch=2).awaitTermination()
    assert store.read(spark, table).count() == want.count()


def test_stream_insert_with_watermark_dedup(spark):
    base = tempfile.mkdtemp()
    table, src, ckpt = (os.path.join(base, x) for x in ("t", "s", "c"))
    existing = view(spark, SF_SMALL, "rankings")
    store.create_if_absent(spark, table, buckets=2)
    store.insert(spark, table, existing)
    multi = view(spark, SF_SMALL, "rankings_multi").select(*RANKINGS.fieldNames())
    multi.repartition(2).write.parquet(src)
    multi.repartition(2).write.mode("append").parquet(src)
    stream_insert(spark, src, table, ckpt, files_per_batch=2, dedup_delay="1 hour").awaitTermination()
    got = store.read(spark, table)
    want = existing.unionByName(rows_to_insert(existing, multi))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_a_micro_batch_replayed_after_a_failure_adds_nothing(spark, monkeypatch):
    base = tempfile.mkdtemp()
    table, src, ckpt = (os.path.join(base, x) for x in ("t", "s", "c"))
    multi = view(spark, SF_SMALL, "rankings_multi").select(*RANKINGS.fieldNames())
    multi.repartition(1).write.parquet(src)
    real = store.insert

    def dies_after_commit(*a, **k):
        real(*a, **k)
        raise RuntimeError("killed")

    monkeypatch.setattr(store, "insert", dies_after_commit)
    try:  # the batch is committed to the table, but not to the stream's checkpoint
        stream_insert(spark, src, table, ckpt, null_safe=False).awaitTermination()
        raise AssertionError("the stream should have failed")
    except Exception as e:
        assert "killed" in str(e)
    monkeypatch.setattr(store, "insert", real)
    n = store.read(spark, table).count()
    assert n == multi.count()
    stream_insert(spark, src, table, ckpt, null_safe=False).awaitTermination()
    assert store.read(spark, table).count() == n  # the NULL keys of observed rows could not tell the replay


def test_arriving_files_are_written_by_all_cores(spark):
    from rankline.plans.q_stream import source_files
    from rankline.sources.fixtures import dealt_view
    n = source_files(spark)
    assert n >= spark.sparkContext.defaultParallelism and n % 2 == 0
    got = dealt_view(spark, SF_SMALL, "rankings_multi", n)
    assert got.rdd.getNumPartitions() == n
    want = view(spark, SF_SMALL, "rankings_multi")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_a_batch_of_files_is_not_written_before_it_is_scored(spark, monkeypatch):
    from rankline.plans.models import LinearScorer
    from rankline.plans.q_history import FIXTURE_VOCAB
    from rankline.streaming import jobs
    base = tempfile.mkdtemp()
    view(spark, SF_SMALL, "inputs").repartition(1).write.parquet(f"{base}/source")
    inputs = spark.read.parquet(f"{base}/source")
    want = jobs.scorable(inputs)
    got = jobs.scorable(inputs, settled=True)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and got.count() > 0
    store.create_if_absent(spark, f"{base}/table", buckets=2)
    store.insert(spark, f"{base}/table", view(spark, SF_SMALL, "rankings"))
    written, real = [], jobs.cut_lineage
    monkeypatch.setattr(jobs, "cut_lineage", lambda df: written.append(df.columns) or real(df))
    stream_score(spark, f"{base}/source", inputs.schema, f"{base}/table", f"{base}/ckpt", LinearScorer({"PrevRank": 1.0}), FIXTURE_VOCAB,
                 "Linear", f"{base}/unkeyed").awaitTermination()
    assert len(written) == 1 and "prediction" in written[0]  # only the scored rows, once
    stored = store.read(spark, f"{base}/table").where("Model = 'Linear'").count()
    assert stored == want.where("SubjectID IS NOT NULL").count()
