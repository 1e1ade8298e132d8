"""Registered queries: data-quality checks and the validation report."""

from __future__ import annotations


import os
import uuid

from pyspark.sql import functions as F

from rankline.operators import quality as Q
from rankline.plans.catalog import register
from rankline.plans.q_history import rankings
from rankline.plans.sql_twins import with_views
from rankline.schema import DRIVERS
from rankline.session import ensure_checkpoint_dir
from rankline.sources.fixtures import view

STRICT = "try_strptime(UpdateDT, '%Y-%m-%d %H:%M:%S')"


def dirty(spark, sf):
    return view(spark, sf, "rankings_dirty")


@register("dq_nulls", with_views("rankings_dirty") + """
SELECT count(*) FILTER (WHERE SubjectID IS NULL) AS SubjectID_nulls, count(*) FILTER (WHERE Rank IS NULL) AS Rank_nulls,
       count(*) FILTER (WHERE UpdateDT IS NULL) AS UpdateDT_nulls, count(*) AS n_rows FROM rankings_dirty""")
def dq_nulls(spark, sf):
    return Q.row_checks(dirty(spark, sf)).select("SubjectID_nulls", "Rank_nulls", "UpdateDT_nulls", "n_rows")


@register("dq_duplicate_keys", with_views("rankings_dirty") + """
SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT SubjectID, UpdateDT, Model FROM rankings_dirty)) AS n_keys,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT SubjectID, UpdateDT, Model FROM rankings_dirty)) AS duplicates
FROM rankings_dirty""")
def dq_duplicate_keys(spark, sf):
    return Q.duplicate_keys(dirty(spark, sf))


_BAD = f"UpdateDT IS NOT NULL AND {STRICT} IS NULL"


@register("dq_bad_timestamps", with_views("rankings_dirty") + f"""
SELECT (SELECT count(*) FROM rankings_dirty WHERE {_BAD}) AS bad_timestamps,
       coalesce((SELECT string_agg(u, ',' ORDER BY u) FROM
                 (SELECT DISTINCT UpdateDT AS u FROM rankings_dirty WHERE {_BAD} ORDER BY u LIMIT 5)), '') AS examples""")
def dq_bad_timestamps(spark, sf):
    return Q.bad_timestamps(dirty(spark, sf))


@register("dq_flags", with_views("rankings") + """
SELECT coalesce(bool_and(coalesce(OriginalDataFlag, false)), true) AS flags_all_true,
       coalesce(bool_and(Model IS NULL), true) AS models_all_null,
       coalesce(bool_and(coalesce(OriginalDataFlag, false) = (Model IS NULL)), true) AS live_consistent,
       count(*) AS n_rows FROM rankings""")
def dq_flags(spark, sf):
    return Q.row_checks(rankings(spark, sf)).select("flags_all_true", "models_all_null", "live_consistent", "n_rows")


@register("dq_reconcile", with_views("rankings_raw", "rankings") + """
SELECT s.source_unique, t.table_rows,
       CASE WHEN t.table_rows < s.source_unique THEN 'error' WHEN t.table_rows > s.source_unique THEN 'warning'
            ELSE 'ok' END AS status
FROM (SELECT count(*) AS source_unique FROM (SELECT DISTINCT * FROM rankings_raw)) s,
     (SELECT count(*) AS table_rows FROM rankings) t""")
def dq_reconcile(spark, sf):
    return Q.reconcile(view(spark, sf, "rankings_raw"), rankings(spark, sf))


@register("dq_reconcile_digest", with_views("rankings_raw", "rankings_dirty") + f"""
, l AS (SELECT CAST(SubjectID AS VARCHAR) AS s, CAST(Rank AS VARCHAR) AS r, {", ".join(DRIVERS)}, count(*) AS nl FROM rankings_raw GROUP BY ALL)
, d AS (SELECT CAST(SubjectID AS VARCHAR) AS s, CAST(Rank AS VARCHAR) AS r, {", ".join(DRIVERS)}, count(*) AS nr FROM rankings_dirty GROUP BY ALL)
, j AS (SELECT coalesce(nl, 0) AS nl, coalesce(nr, 0) AS nr FROM l FULL JOIN d ON
        {" AND ".join(f"l.{c} IS NOT DISTINCT FROM d.{c}" for c in ["s", "r", *DRIVERS])})
SELECT CAST(sum(greatest(nl - nr, 0)) AS BIGINT) AS missing, CAST(sum(greatest(nr - nl, 0)) AS BIGINT) AS extra,
       (SELECT count(*) FROM rankings_raw) AS left_rows, (SELECT count(*) FROM rankings_dirty) AS right_rows,
       CASE WHEN sum(greatest(nl - nr, 0)) > 0 THEN 'error' WHEN sum(greatest(nr - nl, 0)) > 0 THEN 'warning' ELSE 'ok' END AS status
FROM j""")
def dq_reconcile_digest(spark, sf):
    """Rows of the raw source that the dirty table lacks or has too often, times left aside."""
    return Q.reconcile_digest(view(spark, sf, "rankings_raw"), dirty(spark, sf), ["SubjectID", "Rank", *DRIVERS])


@register("missing_subjects", with_views("inputs", "rankings") + """
, s AS (SELECT DISTINCT SubjectID FROM inputs)
, m AS (SELECT SubjectID FROM s WHERE SubjectID NOT IN (SELECT CAST(SubjectID AS VARCHAR) FROM rankings))
SELECT (SELECT count(*) FROM s) AS n_source_subjects, (SELECT count(*) FROM m) AS n_missing,
       coalesce((SELECT string_agg(SubjectID, ',' ORDER BY SubjectID)
                 FROM (SELECT SubjectID FROM m ORDER BY SubjectID LIMIT 5)), '') AS examples""")
def missing_subjects(spark, sf):
    return Q.missing_subjects(view(spark, sf, "inputs"), rankings(spark, sf))


_DRIVERS = ", ".join(DRIVERS)
_REPORT_SQL = with_views("rankings_dirty", "rankings_raw") + f"""
, c AS (SELECT count(*) AS n_rows, count(*) FILTER (WHERE SubjectID IS NULL) AS sn,
               count(*) FILTER (WHERE Rank IS NULL) AS rn, count(*) FILTER (WHERE UpdateDT IS NULL) AS un,
               count(*) FILTER (WHERE {_BAD}) AS bad,
               count(*) FILTER (WHERE len(list_distinct(list_filter([{_DRIVERS}], lambda x: x <> '')))
                                      < len(list_filter([{_DRIVERS}], lambda x: x <> ''))) AS rep,
               bool_and(coalesce(OriginalDataFlag, false)) AS fa, bool_and(Model IS NULL) AS mn,
               bool_and(coalesce(OriginalDataFlag, false) = (Model IS NULL)) AS lc
        FROM rankings_dirty)
, d AS (SELECT count(*) AS nk FROM (SELECT DISTINCT SubjectID, UpdateDT, Model FROM rankings_dirty))
, ex AS (SELECT coalesce(string_agg(u, ',' ORDER BY u), '') AS e FROM
         (SELECT DISTINCT UpdateDT AS u FROM rankings_dirty WHERE {_BAD} ORDER BY u LIMIT 5))
, su AS (SELECT count(*) AS s FROM (SELECT DISTINCT * FROM rankings_raw))
, ss AS (SELECT DISTINCT SubjectID FROM rankings_raw)
, ms AS (SELECT SubjectID FROM ss WHERE SubjectID NOT IN
           (SELECT CAST(SubjectID AS VARCHAR) FROM rankings_dirty WHERE SubjectID IS NOT NULL))
, mse AS (SELECT count(*) AS n, coalesce((SELECT string_agg(SubjectID, ',' ORDER BY SubjectID)
                 FROM (SELECT SubjectID FROM ms ORDER BY SubjectID LIMIT 5)), '') AS e FROM ms)
, r AS (
  SELECT 'schema' AS "check", 'PASSED' AS status, true AS passed, CAST(0 AS BIGINT) AS count, '' AS examples
  UNION ALL SELECT 'required_not_null', CASE WHEN sn + rn + un = 0 THEN 'PASSED' ELSE 'FAILED' END, sn + rn + un = 0,
         sn + rn + un, 'SubjectID=' || sn || ',Rank=' || rn || ',UpdateDT=' || un FROM c
  UNION ALL SELECT 'unique_keys', CASE WHEN n_rows = nk THEN 'PASSED' ELSE 'FAILED' END, n_rows = nk, n_rows - nk, ''
         FROM c, d
  UNION ALL SELECT 'timestamp_format', CASE WHEN bad = 0 THEN 'PASSED' ELSE 'FAILED' END, bad = 0, bad, e FROM c, ex
  UNION ALL SELECT 'seed_flags_true', CASE WHEN fa THEN 'PASSED' ELSE 'FAILED' END, fa, n_rows, '' FROM c
  UNION ALL SELECT 'seed_models_null', CASE WHEN mn THEN 'PASSED' ELSE 'FAILED' END, mn, n_rows, '' FROM c
  UNION ALL SELECT 'live_flag_matches_model', CASE WHEN lc THEN 'PASSED' ELSE 'FAILED' END, lc, n_rows, '' FROM c
  UNION ALL SELECT 'unique_factors', CASE WHEN rep = 0 THEN 'PASSED' ELSE 'FAILED' END, rep = 0, rep, '' FROM c
  UNION ALL SELECT 'source_reconcile', CASE WHEN n_rows < s THEN 'FAILED' WHEN n_rows > s THEN 'WARNING' ELSE 'PASSED' END,
         n_rows >= s, n_rows - s, '' FROM c, su
  UNION ALL SELECT 'source_subjects', CASE WHEN n = 0 THEN 'PASSED' ELSE 'FAILED' END, n = 0, n, e FROM mse)
SELECT * FROM r
UNION ALL SELECT 'overall', CASE WHEN bool_and(passed) THEN 'PASSED' ELSE 'FAILED' END, bool_and(passed),
       count(*) FILTER (WHERE NOT passed), '' FROM r"""


@register("dq_report", _REPORT_SQL)
def dq_report(spark, sf):
    return Q.report(spark, dirty(spark, sf), view(spark, sf, "rankings_raw"))


@register("dq_report_missing_table", with_views("rankings_raw") + """
SELECT 'source_exists' AS "check", 'PASSED' AS status, true AS passed, count(*) AS count, '' AS examples FROM rankings_raw
UNION ALL SELECT 'table_exists', 'FAILED', false, CAST(0 AS BIGINT), ''""")
def dq_report_missing_table(spark, sf):
    """Report on a source whose table has not been made."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"rankline-csv-{uuid.uuid4().hex}")
    view(spark, sf, "rankings_raw").write.option("header", True).csv(path)
    return Q.validate(spark, f"{path}-no-table", path)


@register("dq_report_missing_source", _REPORT_SQL.replace("SELECT * FROM r\n", "SELECT * FROM r WHERE \"check\" NOT LIKE 'source%'\n")
          .replace("'' FROM r", "'' FROM r WHERE \"check\" NOT LIKE 'source%'")
          + """
UNION ALL SELECT 'source_exists', 'WARNING', true, CAST(0 AS BIGINT), 'no-such-source.csv'""")
def dq_report_missing_source(spark, sf):
    """Report on a stored table whose source CSV is not there."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"rankline-dirty-{uuid.uuid4().hex}")
    dirty(spark, sf).write.parquet(path)
    gone = os.path.join(path, "no-such-source.csv")
    return Q.validate(spark, path, gone).withColumn("examples", F.regexp_replace("examples", "^.*/(no-such-source)", "$1"))
