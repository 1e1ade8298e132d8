"""Registered queries: streaming insert and streaming scoring (file source, availableNow).

The stream inputs are written from the fixture views into a fresh folder under
``spark.checkpoint.dir`` (the shared folder), then replayed through the
stream; the result is the stored table read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rankline.operators import summaries
from rankline.operators.features import rank_features, training_rows
from rankline.plans import models as ML
from rankline.plans.catalog import register
from rankline.plans.q_history import FIXTURE_VOCAB, rankings, serve_sql
from rankline.plans.q_ingest import _insert_sql
from rankline.plans.q_models import CHOSEN_SQL, INTERCEPT, KEEP_SQL, LINEAR, LINEAR_SQL
from rankline.plans.q_store import new_folder, stored
from rankline.plans.sql_twins import with_views
from rankline.schema import DRIVERS, RANKINGS
from rankline.sources import store
from rankline.sources.fixtures import dealt_view
from rankline.streaming.jobs import (stream_insert as _stream_insert, stream_score as _stream_score,
                                     unkeyed_predictions)

# Files that a view arrives in, at least: one for every core, so that all write them.  Half of them are a batch.
SOURCE_FILES = 4
SCORE_MODEL = "Gradient Boosting"


def source_files(spark) -> int:
    """An even number of files, at least SOURCE_FILES and one for every core."""
    n = max(SOURCE_FILES, spark.sparkContext.defaultParallelism)
    return n + n % 2


@register("stream_insert", "SELECT * EXCLUDE (inserted) FROM (" + _insert_sql(True) + ")")
def stream_insert(spark, sf):
    """rankings as the table; rankings_multi arrives twice (a replay) in several files."""
    base = new_folder(spark)
    table, src, ckpt = stored(spark, dealt_view(spark, sf, "rankings"), base), f"{base}/source", f"{base}/ckpt"
    files = source_files(spark)
    multi = dealt_view(spark, sf, "rankings_multi", files).select(*RANKINGS.fieldNames())
    multi.write.parquet(src)
    multi.write.mode("append").parquet(src)   # the same rows again
    q = _stream_insert(spark, src, table, ckpt, files_per_batch=files // 2)
    q.awaitTermination()
    return store.read(spark, table)


@register("stream_score")
def stream_score(spark, sf):
    """Train on stored history, then score arriving input rows in micro-batches and store them."""
    base = new_folder(spark)
    hist = rankings(spark, sf)
    model = ML.fit(rank_features(training_rows(hist), FIXTURE_VOCAB), ML.feature_columns(FIXTURE_VOCAB), SCORE_MODEL)
    return _replay(spark, sf, base, model, SCORE_MODEL)[0]


def _replay(spark, sf, base, model, name):
    """The inputs as a stream of files into a table with summaries; (stored predictions, those without a key)."""
    files = source_files(spark)
    inputs = dealt_view(spark, sf, "inputs", files)
    table = stored(spark, dealt_view(spark, sf, "rankings"), base)
    summaries.refresh(spark, table)
    inputs.write.parquet(f"{base}/source")
    q = _stream_score(spark, f"{base}/source", inputs.schema, table, f"{base}/ckpt", model, FIXTURE_VOCAB, name,
                      f"{base}/unkeyed", files_per_batch=files // 2)
    q.awaitTermination()
    return store.read(spark, table).where(F.col("Model") == name), unkeyed_predictions(spark, f"{base}/unkeyed")


@register("stream_score_linear", with_views("rankings", "inputs") + serve_sql(keep=KEEP_SQL) + f"""
, l AS (SELECT *, {LINEAR_SQL} AS prediction FROM served)
SELECT SubjectID, CAST(round_even(prediction, 0) AS INTEGER) AS Rank, {", ".join(DRIVERS)}, UpdateDT,
       false AS OriginalDataFlag, 'Linear' AS Model FROM l WHERE SubjectID IS NOT NULL AND {CHOSEN_SQL} > 0""")
def stream_score_linear(spark, sf):
    """A given linear model scores the stream, so the stored table is known exactly."""
    return _replay(spark, sf, new_folder(spark), ML.LinearScorer(LINEAR, INTERCEPT), "Linear")[0]


@register("stream_score_unkeyed", with_views("rankings", "inputs") + serve_sql(keep=KEEP_SQL) + f"""
, l AS (SELECT *, {LINEAR_SQL} AS prediction FROM served)
SELECT event_id, CAST(round_even(prediction, 0) AS INTEGER) AS Rank, {", ".join(DRIVERS)}, UpdateDT, 'Linear' AS Model
FROM l WHERE SubjectID IS NULL AND {CHOSEN_SQL} > 0""")
def stream_score_unkeyed(spark, sf):
    """The rest of the stream's predictions: inputs without a subject id, by their own id."""
    rest = _replay(spark, sf, new_folder(spark), ML.LinearScorer(LINEAR, INTERCEPT), "Linear")[1]
    return rest.select("event_id", "Rank", *DRIVERS, "UpdateDT", "Model")
