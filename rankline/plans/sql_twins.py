"""DuckDB text of the fixture views, used by ``oracle_sql()``.

The oracle registers only the raw tables, so every oracle query starts with
the CTEs it needs.  The text mirrors ``rankline.sources.fixtures``.
"""

from __future__ import annotations

from rankline.schema import N_DRIVERS


def d_sql(i: int) -> str:
    return (f"concat('Factor', CAST((CAST(floor(value) AS BIGINT) + {i}*(1+user_id%16))%17 + 1 "
            f"AS VARCHAR))")


DRIVERS_SQL = ", ".join(f"{d_sql(i)} AS Driver{i}" for i in range(1, N_DRIVERS + 1))
DRIVER_LIST = ", ".join(f"Driver{i}" for i in range(1, N_DRIVERS + 1))
BASE_RANK = "CAST(least(265, 1+floor(value)) AS INTEGER)"

RANKINGS = f"""rankings AS (
  SELECT user_id AS SubjectID, {BASE_RANK} AS Rank, {DRIVERS_SQL}, ts AS UpdateDT,
         event_type NOT IN ('purchase','error') AS OriginalDataFlag,
         CASE event_type WHEN 'purchase' THEN 'Random Forest' WHEN 'error' THEN 'XGBoost' END AS Model
  FROM events)"""

RANKINGS_MULTI = f"""rankings_multi AS (
  SELECT user_id AS SubjectID,
         CAST((least(265, 1+floor(value)) - 1 + k*(1+event_id%7)) % 265 + 1 AS INTEGER) AS Rank,
         {DRIVERS_SQL}, ts AS UpdateDT, k=0 AS OriginalDataFlag,
         CASE k WHEN 1 THEN 'Random Forest' WHEN 2 THEN 'XGBoost' END AS Model
  FROM events CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) m)"""

_RAW_FROM = ("FROM events CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1) d "
             "WHERE c=0 OR event_id%97=0")

RANKINGS_RAW = f"""rankings_raw AS (
  SELECT CAST(user_id AS VARCHAR) AS SubjectID,
         CAST({BASE_RANK} AS VARCHAR) AS Rank, {DRIVERS_SQL},
         strftime(ts, '%-m/%-d/%Y %-H:%M') AS UpdateDT
  {_RAW_FROM})"""

RANKINGS_BAD = f"""rankings_bad AS (
  SELECT CASE WHEN event_id%79=0 THEN 'abc' WHEN event_id%61=0 THEN '99999999999999999999'
              ELSE CAST(user_id AS VARCHAR) END AS SubjectID,
         CASE WHEN event_id%89=0 THEN '3000000000' WHEN event_id%83=0 THEN 'x' WHEN event_id%71=0 THEN 'N/A'
              WHEN event_id%67=0 THEN '12.0' ELSE CAST({BASE_RANK} AS VARCHAR) END AS Rank, {DRIVERS_SQL},
         CASE WHEN event_id%73=0 THEN '13/45/2025 10:00' ELSE strftime(ts, '%-m/%-d/%Y %-H:%M') END AS UpdateDT
  {_RAW_FROM})"""

RANKINGS_DIRTY = f"""rankings_dirty AS (
  SELECT CASE WHEN event_id%211=0 THEN NULL ELSE user_id END AS SubjectID,
         CASE WHEN event_id%101=0 THEN NULL ELSE {BASE_RANK} END AS Rank, {DRIVERS_SQL},
         CASE WHEN event_id%103=0 THEN '2021-02-30 00:00:00' WHEN event_id%107=0 THEN 'n/a'
              ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS UpdateDT,
         event_type NOT IN ('purchase','error') AS OriginalDataFlag,
         CASE event_type WHEN 'purchase' THEN 'Random Forest' WHEN 'error' THEN 'XGBoost' END AS Model
  {_RAW_FROM})"""


def _input_driver(i: int) -> str:
    arms = ["WHEN event_id%29=0 THEN ''"]
    if i in (15, 16):
        arms.append("WHEN event_id%11=0 THEN ''")
    if i == 17:
        arms.append(f"WHEN event_id%13=0 THEN {d_sql(1)}")
    return f"CASE {' '.join(arms)} ELSE {d_sql(i)} END AS Driver{i}"


INPUTS = f"""inputs AS (
  SELECT event_id, CASE WHEN event_id%17=0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS SubjectID,
         CAST(NULL AS INTEGER) AS Rank,
         {", ".join(_input_driver(i) for i in range(1, N_DRIVERS + 1))},
         ts AS UpdateDT
  FROM events)"""

CTES = {"rankings": RANKINGS, "rankings_multi": RANKINGS_MULTI, "rankings_raw": RANKINGS_RAW,
        "rankings_bad": RANKINGS_BAD, "rankings_dirty": RANKINGS_DIRTY, "inputs": INPUTS}


def with_views(*names: str, extra: list[str] | None = None) -> str:
    parts = [CTES[n] for n in names] + list(extra or [])
    return "WITH " + ",\n".join(parts) + "\n"
