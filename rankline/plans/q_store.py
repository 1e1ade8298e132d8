"""Registered queries: the table with a commit log, and serving features from its summaries."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from rankline.operators import summaries
from rankline.plans.catalog import register, rounded
from rankline.plans.q_history import FIXTURE_VOCAB, _SERVED, input_rows, rankings, serve_sql
from rankline.plans.q_ingest import _insert_sql
from rankline.plans.sql_twins import with_views
from rankline.schema import RANKINGS
from rankline.session import ensure_checkpoint_dir
from rankline.sources import store
from rankline.sources.fixtures import dealt_view

# Buckets of the fixture's tables, whose slices are days.
BUCKETS = 2


def new_folder(spark) -> str:
    """A fresh folder in the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), f"rankline-store-{uuid.uuid4().hex}")


def stored(spark, rows, base) -> str:
    """``rows`` (a view's) as a table with a commit log under ``base``."""
    table = f"{base}/table"
    store.create_if_absent(spark, table, buckets=BUCKETS)
    store.insert(spark, table, rows, settled=True)
    return table


def _insert(spark, sf, null_safe):
    """rankings stored, rankings_multi inserted; then the same batch arrives again under its name."""
    table = stored(spark, dealt_view(spark, sf, "rankings"), new_folder(spark))
    before = store.head(spark, table)
    batch = dealt_view(spark, sf, "rankings_multi").select(*RANKINGS.fieldNames())
    for _ in range(2):
        store.insert(spark, table, batch, null_safe=null_safe, batch_id="multi", settled=True)
    old, new = (store.files_of(spark, table).where(c) for c in (F.col("commit") <= before, F.col("commit") > before))
    parts = [store.read_files(spark, table, f).withColumn("inserted", F.lit(k)) for f, k in ((old, False), (new, True))]
    return parts[0].unionByName(parts[1])


@register("store_insert", _insert_sql(True))
def store_insert(spark, sf):
    """Insert-if-absent into the stored table; the replayed batch adds nothing."""
    return _insert(spark, sf, True)


@register("store_insert_sqlite", _insert_sql(False))
def store_insert_sqlite(spark, sf):
    """Same with SQLite key semantics: the replay is told by its batch id, as its NULL keys never collide."""
    return _insert(spark, sf, False)


@register("serving_from_summaries", with_views("rankings", "inputs") + serve_sql() + _SERVED)
def serving_from_summaries(spark, sf):
    """serving_features from summaries: two thirds of the rows are summarised, the rest arrives late; of the slices
    that it makes out of date, those with an even day are refreshed, the others are read as rows."""
    rows = rankings(spark, sf)
    late = F.xxhash64("SubjectID", "UpdateDT") % 3 == 0
    table = stored(spark, rows.where(~late), new_folder(spark))
    summaries.refresh(spark, table)
    even = F.dayofmonth("UpdateDT") % 2 == 0
    store.insert(spark, table, rows.where(late & even))
    summaries.refresh(spark, table)
    store.insert(spark, table, rows.where(late & ~even))
    return rounded(summaries.serving_features(spark, table, input_rows(spark, sf), FIXTURE_VOCAB))
