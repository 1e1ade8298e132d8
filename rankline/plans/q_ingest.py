"""Registered queries: raw ingest and insert-if-absent."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from rankline.plans.catalog import register
from rankline.plans.q_history import rankings
from rankline.plans.sql_twins import with_views
from rankline.schema import DRIVERS
from rankline.session import ensure_checkpoint_dir
from rankline.sources import ingest as I
from rankline.sources.fixtures import view

DL = ", ".join(DRIVERS)
PARSE = "try_strptime(UpdateDT, '%m/%d/%Y %H:%M')"


def csv_of(spark, sf, name):
    """The view written as a header CSV into the shared folder and read back as text."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"rankline-csv-{uuid.uuid4().hex}")
    view(spark, sf, name).write.option("header", True).csv(path)
    return I.read_raw_csv(spark, path)


@register("ingest_rankings", with_views("rankings_raw") + f"""
SELECT DISTINCT TRY_CAST(SubjectID AS BIGINT) AS SubjectID, TRY_CAST(Rank AS INTEGER) AS Rank, {DL},
       {PARSE} AS UpdateDT, true AS OriginalDataFlag, CAST(NULL AS VARCHAR) AS Model
FROM rankings_raw WHERE {PARSE} IS NOT NULL""")
def ingest_rankings(spark, sf):
    rows, _rejects = I.ingest(csv_of(spark, sf, "rankings_raw"))
    return rows


_TYPED_SQL = with_views("rankings_bad") + f"""
, t AS (SELECT * REPLACE (nullif(Rank, 'N/A') AS Rank), {PARSE} AS ts FROM rankings_bad)
, u AS (SELECT *, TRY_CAST(SubjectID AS BIGINT) AS sid, coalesce(TRY_CAST(Rank AS INTEGER), CASE WHEN Rank = '12.0' THEN 12 END) AS rk FROM t)
, v AS (SELECT *, CASE WHEN ts IS NULL THEN 'bad UpdateDT' WHEN SubjectID IS NOT NULL AND sid IS NULL THEN 'bad SubjectID'
                       WHEN Rank IS NOT NULL AND rk IS NULL THEN 'bad Rank' END AS reason FROM u)
"""


@register("ingest_rejects", _TYPED_SQL + """
SELECT reason, count(*) AS n_rows, count(DISTINCT Rank) AS n_rank_texts, min(SubjectID) AS first_subject
FROM v WHERE reason IS NOT NULL GROUP BY reason""")
def ingest_rejects(spark, sf):
    """Rows of a CSV that cannot be typed (numbers out of range included), by reason."""
    _, rejects = I.ingest(csv_of(spark, sf, "rankings_bad"))
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("Rank").alias("n_rank_texts"),
                                         F.min("SubjectID").alias("first_subject"))


@register("ingest_accepted", _TYPED_SQL + f"""
SELECT DISTINCT sid AS SubjectID, CAST(rk AS INTEGER) AS Rank, {DL}, ts AS UpdateDT, true AS OriginalDataFlag,
       CAST(NULL AS VARCHAR) AS Model FROM v WHERE reason IS NULL""")
def ingest_accepted(spark, sf):
    """The other rows of the same CSV: a missing-value token is NULL, '12.0' is 12."""
    return I.ingest(csv_of(spark, sf, "rankings_bad"))[0]


# The CSV's lines by outcome, from the definition of the view csv_lines.
_LINES_SQL = """
WITH k AS (SELECT *, CASE WHEN event_id % 41 = 0 THEN 'short' WHEN event_id % 43 = 0 THEN 'long' WHEN event_id % 47 = 0 THEN 'open'
                          WHEN event_id % 53 = 0 THEN 'two' ELSE 'good' END AS kind FROM events)
, m AS (SELECT CASE kind WHEN 'good' THEN 'accepted' WHEN 'short' THEN 'number of fields' WHEN 'long' THEN 'number of fields'
                    ELSE 'open quote' END AS outcome, CASE kind WHEN 'two' THEN 2 ELSE 1 END AS n, user_id, event_id, kind FROM k)
SELECT outcome, CAST(sum(n) AS BIGINT) AS n_records, CAST(sum(user_id) AS BIGINT) AS subject_sum,
       CAST(count(*) FILTER (kind = 'good' AND event_id % 31 = 0) AS BIGINT) AS quoted_commas
FROM m GROUP BY outcome"""


@register("ingest_malformed", _LINES_SQL)
def ingest_malformed(spark, sf):
    """Records of a CSV by outcome: accepted rows, and malformed lines by reason with their text kept."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"rankline-lines-{uuid.uuid4().hex}")
    view(spark, sf, "csv_lines").write.text(path)
    rows, malformed = I.read_csv_lines(spark, path, I.RAW_COLUMNS)
    good = rows.select(F.lit("accepted").alias("outcome"), F.col("SubjectID").alias("subject"), F.col("Driver17").alias("last"))
    bad = malformed.select(F.col("reason").alias("outcome"), F.expr("try_cast(regexp_extract(raw, '^([0-9]+),', 1) AS bigint)")
                           .cast("string").alias("subject"), F.lit(None).cast("string").alias("last"))
    return good.unionByName(bad).groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n_records"), F.sum(F.col("subject").cast("bigint")).alias("subject_sum"),
        F.count_if(F.col("last") == "Factor, 1").alias("quoted_commas"))


def _insert_sql(null_safe: bool) -> str:
    eq = "IS NOT DISTINCT FROM" if null_safe else "="
    return with_views("rankings", "rankings_multi") + f"""
SELECT *, false AS inserted FROM rankings
UNION ALL
SELECT n.*, true FROM rankings_multi n WHERE NOT EXISTS (
  SELECT 1 FROM rankings r WHERE r.SubjectID {eq} n.SubjectID AND r.UpdateDT {eq} n.UpdateDT AND r.Model {eq} n.Model)"""


def _insert(spark, sf, null_safe):
    existing = rankings(spark, sf)
    new = view(spark, sf, "rankings_multi")
    add = I.rows_to_insert(existing, new, null_safe=null_safe)
    return existing.withColumn("inserted", F.lit(False)).unionByName(add.withColumn("inserted", F.lit(True)))


@register("insert_if_absent", _insert_sql(True))
def insert_if_absent(spark, sf):
    """Table after inserting a batch of observations + predictions; existing keys skipped."""
    return _insert(spark, sf, True)


@register("insert_if_absent_sqlite", _insert_sql(False))
def insert_if_absent_sqlite(spark, sf):
    """Same with SQLite key semantics: a NULL Model never collides."""
    return _insert(spark, sf, False)
