"""Registered queries: scans, subject history, features, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rankline.operators import features as FE
from rankline.operators import history as H
from rankline.operators import reports as R
from rankline.operators.factors import resolve_vocabulary
from rankline.plans.catalog import register, rounded
from rankline.plans.sql_twins import with_views
from rankline.schema import DRIVERS
from rankline.sources.fixtures import view
from rankline.sources.ingest import save_bucketed

# Fixed vocabulary of the fixture views (17 factors, lexicographic order).
FIXTURE_VOCAB = sorted(f"Factor{i}" for i in range(1, 18))

WORD = "PARTITION BY SubjectID ORDER BY UpdateDT ASC NULLS FIRST, Model ASC NULLS FIRST, Rank ASC NULLS FIRST"
PRIOR = f"({WORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
RANK_COLS = ["SubjectID", "Rank", *DRIVERS, "UpdateDT", "OriginalDataFlag", "Model"]


def pos_sql(factor: str, last: bool = False, alias: str | None = None, drivers=DRIVERS) -> str:
    idx = list(range(1, len(drivers) + 1))
    if last:
        idx = idx[::-1]
    arms = " ".join(f"WHEN {drivers[i - 1]} = '{factor}' THEN {i}" for i in idx)
    return f"CASE {arms} ELSE 0 END AS \"{alias or factor}\""


def positions_sql(vocab, last=False, suffix="") -> str:
    return ", ".join(pos_sql(f, last, f + suffix) for f in vocab)


def rankings(spark, sf):
    return view(spark, sf, "rankings")


# ---- A3 / D5 / B1 / B2 -------------------------------------------------------------------

@register("scan_rankings", with_views("rankings") + "SELECT * FROM rankings")
def scan_rankings(spark, sf):
    return rankings(spark, sf)


@register("subjects", with_views("rankings") + "SELECT DISTINCT SubjectID FROM rankings")
def subjects(spark, sf):
    return rankings(spark, sf).select("SubjectID").distinct()


@register("subject_rows", with_views("rankings") + f"""
SELECT SubjectID, UpdateDT, Model, Rank, count(*) OVER (PARTITION BY SubjectID) AS n_subject_rows
FROM rankings""")
def subject_rows(spark, sf):
    """All rows grouped by subject (a point lookup is this plus a pushed-down filter)."""
    r = rankings(spark, sf).select("SubjectID", "UpdateDT", "Model", "Rank")
    return R.rows_per_subject(r)


@register("history_for_model", with_views("rankings") + """
SELECT SubjectID, UpdateDT, Model, Rank FROM rankings WHERE Model = 'Random Forest' OR Model IS NULL""")
def history_for_model(spark, sf):
    return R.history_for_model(rankings(spark, sf), "Random Forest").select("SubjectID", "UpdateDT", "Model", "Rank")


# ---- D1 / E8 / L1 / L3 ---------------------------------------------------------------------

@register("subject_summary", with_views("rankings") + """
SELECT SubjectID, last(Rank ORDER BY UpdateDT NULLS FIRST, Model NULLS FIRST, Rank NULLS FIRST) AS previous_rank, max(UpdateDT) AS last_update,
       strftime(max(UpdateDT), '%Y-%m-%d') AS last_update_date,
       count(*) AS num_records, round(avg(Rank), 6) AS avg_rank, min(Rank) AS min_rank, max(Rank) AS max_rank
FROM rankings GROUP BY SubjectID""")
def subject_summary(spark, sf):
    return rounded(R.subject_card(rankings(spark, sf)))


@register("subject_lookup", with_views("rankings") + """
, ids AS (SELECT DISTINCT SubjectID + k * 1000000 AS SubjectID FROM rankings CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) t)
SELECT ids.SubjectID, last(Rank ORDER BY UpdateDT NULLS FIRST, Model NULLS FIRST, Rank NULLS FIRST) AS previous_rank,
       max(UpdateDT) AS last_update, count(r.UpdateDT) AS num_records, round(avg(Rank), 6) AS avg_rank,
       min(Rank) AS min_rank, max(Rank) AS max_rank
FROM ids LEFT JOIN rankings r ON ids.SubjectID = r.SubjectID GROUP BY ids.SubjectID""")
def subject_lookup(spark, sf):
    """Summaries of asked ids, half of which no row has: NULLs and a count of 0."""
    r = rankings(spark, sf)
    ids = r.select(F.explode(F.array("SubjectID", F.col("SubjectID") + 1000000)).alias("SubjectID")).distinct()
    return rounded(R.subject_lookup(r, ids))


@register("latest_per_subject", with_views("rankings") + f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY SubjectID ORDER BY UpdateDT DESC NULLS LAST,
                                Model DESC NULLS LAST, Rank DESC NULLS LAST) AS rn FROM rankings)
WHERE rn = 1""")
def latest_per_subject(spark, sf):
    return H.latest_per_subject(rankings(spark, sf))


@register("rank_series", with_views("rankings_multi") + """
SELECT SubjectID, coalesce('Model: ' || Model, 'Historical Data') AS series, UpdateDT, Rank,
       row_number() OVER (PARTITION BY SubjectID, coalesce('Model: ' || Model, 'Historical Data')
                          ORDER BY UpdateDT, Rank) AS point
FROM rankings_multi""")
def rank_series(spark, sf):
    return R.rank_series(view(spark, sf, "rankings_multi"))


@register("model_comparison", with_views("rankings_multi") + """
SELECT SubjectID, UpdateDT,
       max(CASE WHEN Model IS NULL THEN Rank END) AS observed,
       max(CASE WHEN Model = 'Random Forest' THEN Rank END) AS "Random Forest",
       max(CASE WHEN Model = 'XGBoost' THEN Rank END) AS "XGBoost",
       max(Rank) FILTER (WHERE Model IS NOT NULL) - min(Rank) FILTER (WHERE Model IS NOT NULL) AS model_range
FROM rankings_multi GROUP BY SubjectID, UpdateDT""")
def model_comparison(spark, sf):
    return R.model_comparison(view(spark, sf, "rankings_multi"), ["Random Forest", "XGBoost"])


# ---- E1..E7 ----------------------------------------------------------------------------

_HIST_SQL = with_views("rankings") + f"""
, h AS (SELECT *, lag(Rank) OVER ({WORD}) AS PrevRank, lag(UpdateDT) OVER ({WORD}) AS PrevT,
               avg(Rank) OVER {PRIOR} AS apr,
               row_number() OVER ({WORD}) - 1 AS ObsNumber FROM rankings)
, h2 AS (SELECT *, Rank - PrevRank AS RankChange FROM h)
, h3 AS (SELECT *, avg(RankChange) OVER {PRIOR} AS aprc,
                first(apr IGNORE NULLS) OVER ({WORD} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bf
         FROM h2)
"""


@register("prev_rank", _HIST_SQL + "SELECT SubjectID, UpdateDT, Rank, PrevRank FROM h3")
def prev_rank(spark, sf):
    return H.history_columns(rankings(spark, sf)).select("SubjectID", "UpdateDT", "Rank", "PrevRank")


@register("rank_change", _HIST_SQL + "SELECT SubjectID, UpdateDT, Rank, RankChange FROM h3")
def rank_change(spark, sf):
    return H.history_columns(rankings(spark, sf)).select("SubjectID", "UpdateDT", "Rank", "RankChange")


@register("obs_number", _HIST_SQL + "SELECT SubjectID, UpdateDT, CAST(ObsNumber AS BIGINT) AS ObsNumber FROM h3")
def obs_number(spark, sf):
    return H.history_columns(rankings(spark, sf)).select("SubjectID", "UpdateDT", "ObsNumber")


@register("fill_gaps", _HIST_SQL + """
SELECT SubjectID, UpdateDT, round(apr, 6) AS AvgPreviousRanks, round(coalesce(apr, bf), 6) AS AvgPreviousRanksFilled
FROM h3""")
def fill_gaps(spark, sf):
    x = H.history_columns(rankings(spark, sf))
    return rounded(x.select("SubjectID", "UpdateDT", "AvgPreviousRanks", "AvgPreviousRanksFilled"))


def _features_sql(avg_col: str) -> str:
    return _HIST_SQL + f"""
, t0 AS (SELECT min(UpdateDT) AS t_first FROM rankings)
SELECT SubjectID, UpdateDT, Model, Rank,
       CAST(coalesce(datesub('day', t_first, UpdateDT), 0) AS BIGINT) AS DaysSinceFirst,
       CAST(coalesce(datesub('day', PrevT, UpdateDT), 0) AS BIGINT) AS DaysSincePrev,
       CAST(coalesce(PrevRank, 0) AS INTEGER) AS PrevRank,
       round(coalesce({avg_col}, 0), 6) AS AvgPreviousRanks,
       round(coalesce(aprc, 0), 6) AS AvgPreviousRankChanges,
       {positions_sql(FIXTURE_VOCAB)}
FROM h3 CROSS JOIN t0"""


def flagship(spark, sf, leak_free=True, force_split=False):
    r = rankings(spark, sf)
    vocab = resolve_vocabulary(r)
    return rounded(FE.rank_features(r, vocab, leak_free=leak_free, force_split=force_split))


@register("rank_features", _features_sql("apr"))
def rank_features(spark, sf):
    return flagship(spark, sf)


@register("rank_features_leaky", _features_sql("coalesce(apr, bf)"))
def rank_features_leaky(spark, sf):
    """Reference-parity variant: first row's mean back-filled from the second row."""
    return flagship(spark, sf, leak_free=False)


@register("asof_prev_rank", with_views("rankings", "inputs") + """
, n AS (SELECT event_id, TRY_CAST(nullif(SubjectID, '') AS BIGINT) AS SubjectID, UpdateDT FROM inputs)
SELECT n.event_id, n.SubjectID, n.UpdateDT, r.Rank AS prev_rank, r.UpdateDT AS prev_update
FROM n ASOF LEFT JOIN rankings r ON n.SubjectID = r.SubjectID AND n.UpdateDT >= r.UpdateDT""")
def asof_prev_rank(spark, sf):
    new = view(spark, sf, "inputs").select(
        "event_id", F.expr("try_cast(nullif(SubjectID, '') AS BIGINT)").alias("SubjectID"), "UpdateDT")
    return H.asof_prev_rank(rankings(spark, sf), new)


SERVE_ORDER = ("PARTITION BY SubjectID ORDER BY UpdateDT ASC NULLS FIRST, side, Model ASC NULLS FIRST, "
               "Rank ASC NULLS FIRST")


def serve_sql(history: str = "Model IS NULL", inputs: str = "inputs", keep: str = "") -> str:
    """Serving features of ``inputs`` against the rows of ``rankings`` that ``history`` selects."""
    prior = f"({SERVE_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    blank = ", ".join(f"nullif({d}, '') AS {d}" for d in DRIVERS)
    return f"""
, hist AS (SELECT * FROM rankings WHERE {history})
, u AS (
  SELECT SubjectID, Rank, {", ".join(DRIVERS)}, UpdateDT, Model, 0 AS side, CAST(NULL AS BIGINT) AS event_id FROM hist
  UNION ALL
  SELECT TRY_CAST(SubjectID AS BIGINT), CAST(NULL AS INTEGER), {blank}, UpdateDT, CAST(NULL AS VARCHAR), 1, event_id FROM {inputs})
, h AS (SELECT *, last(Rank IGNORE NULLS) OVER {prior} AS PrevRank,
               last(CASE WHEN Rank IS NOT NULL THEN UpdateDT END IGNORE NULLS) OVER {prior} AS PrevT,
               avg(Rank) OVER {prior} AS apr FROM u WHERE SubjectID IS NOT NULL)
, h2 AS (SELECT *, Rank - PrevRank AS RankChange FROM h)
, h3 AS (SELECT *, avg(RankChange) OVER {prior} AS aprc FROM h2)
, h4 AS (SELECT * FROM h3 WHERE side = 1
         UNION ALL BY NAME SELECT * FROM u WHERE SubjectID IS NULL AND side = 1)
, t0 AS (SELECT min(UpdateDT) AS t_first FROM hist)
, served AS (
SELECT event_id, SubjectID, UpdateDT, {keep}
       CAST(coalesce(datesub('day', t_first, UpdateDT), 0) AS BIGINT) AS DaysSinceFirst,
       CAST(coalesce(datesub('day', PrevT, UpdateDT), 0) AS BIGINT) AS DaysSincePrev,
       CAST(coalesce(PrevRank, 0) AS INTEGER) AS PrevRank,
       coalesce(apr, 0) AS AvgPreviousRanks, coalesce(aprc, 0) AS AvgPreviousRankChanges,
       {positions_sql(FIXTURE_VOCAB)}
FROM h4 CROSS JOIN t0)"""


_SERVED = """
SELECT * REPLACE (round(AvgPreviousRanks, 6) AS AvgPreviousRanks,
                  round(AvgPreviousRankChanges, 6) AS AvgPreviousRankChanges) FROM served"""


def input_rows(spark, sf):
    return view(spark, sf, "inputs").withColumn("SubjectID", F.expr("try_cast(SubjectID AS BIGINT)"))


@register("serving_features", with_views("rankings", "inputs") + serve_sql() + _SERVED)
def serving_features(spark, sf):
    """Observed rows are the only history."""
    return rounded(FE.serving_features(rankings(spark, sf), input_rows(spark, sf), FIXTURE_VOCAB))


@register("serving_features_for_model", with_views("rankings", "inputs")
          + serve_sql("Model IS NULL OR Model = 'Random Forest'") + _SERVED)
def serving_features_for_model(spark, sf):
    """Observed rows and one model's stored predictions are the history."""
    return rounded(FE.serving_features(rankings(spark, sf), input_rows(spark, sf), FIXTURE_VOCAB,
                                       history_model="Random Forest"))


@register("training_rows", _features_sql("apr").replace("FROM events)", "FROM events WHERE event_type NOT IN ('purchase', 'error'))", 1))
def training_rows(spark, sf):
    """Features and labels that learners get: observed rows, with observed rows as their history."""
    return rounded(FE.rank_features(FE.training_rows(rankings(spark, sf)), FIXTURE_VOCAB))


BUCKETS = 8


def bucketed_rankings(spark, sf):
    """The rankings stored as a table bucketed by subject."""
    name = f"rankline_bucketed_{uuid.uuid4().hex}"
    save_bucketed(rankings(spark, sf), name, BUCKETS)
    return spark.table(name)


_ASOF_SQL = with_views("rankings", "inputs") + """
, n AS (SELECT event_id, TRY_CAST(nullif(SubjectID, '') AS BIGINT) AS SubjectID, UpdateDT FROM inputs)
SELECT n.event_id, n.SubjectID, n.UpdateDT, r.Rank AS prev_rank, r.UpdateDT AS prev_update
FROM n ASOF LEFT JOIN rankings r ON n.SubjectID = r.SubjectID AND n.UpdateDT >= r.UpdateDT"""


@register("asof_prev_rank_bucketed", _ASOF_SQL)
def asof_prev_rank_bucketed(spark, sf):
    """asof_prev_rank against a table bucketed by subject, whose rows are not shuffled."""
    return H.asof_prev_rank(bucketed_rankings(spark, sf), input_rows(spark, sf), buckets=BUCKETS)


@register("serving_features_bucketed", with_views("rankings", "inputs") + serve_sql() + _SERVED)
def serving_features_bucketed(spark, sf):
    """serving_features against a table bucketed by subject."""
    return rounded(FE.serving_features(bucketed_rankings(spark, sf), input_rows(spark, sf), FIXTURE_VOCAB, buckets=BUCKETS))
