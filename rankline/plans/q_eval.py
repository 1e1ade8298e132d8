"""Registered queries: time split, metrics, rank correlations, leaderboard, expected error."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from rankline.functions import columns as C
from rankline.operators import history as H
from rankline.operators import metrics as M
from rankline.operators import reports as R
from rankline.plans.catalog import ORACLE, register, rounded
from rankline.plans.q_history import WORD, rankings
from rankline.plans.sql_twins import with_views
from rankline.schema import LEADERBOARD
from rankline.session import cut_lineage, ensure_checkpoint_dir
from rankline.sources.fixtures import view
from rankline.sources.ingest import read_leaderboard

# Fallback prediction for a subject's first row in the metric fixture.
FIRST_ROW_GUESS = 133
MODELS = ["Random Forest", "XGBoost"]


def lag_pairs(spark, sf):
    """y = Rank, p = previous rank of the subject (else a constant)."""
    h = H.history_columns(rankings(spark, sf).select("SubjectID", "UpdateDT", "Model", "Rank"))
    return h.select("SubjectID", "UpdateDT", F.col("Rank").alias("y"),
                    F.coalesce(F.col("PrevRank"), F.lit(FIRST_ROW_GUESS)).alias("p"))


PAIRS_SQL = with_views("rankings") + f""", pairs AS (
  SELECT SubjectID, UpdateDT, Rank AS y, coalesce(lag(Rank) OVER ({WORD}), {FIRST_ROW_GUESS}) AS p FROM rankings)
"""

ERR_SQL = """count(*) FILTER (y IS NOT NULL AND p IS NOT NULL) AS n, count(*) FILTER (y IS NULL OR p IS NULL) AS n_incomplete, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse,
       round(1 - sum((p - y) * (p - y)) / (var_pop(CASE WHEN p IS NOT NULL THEN y END) * count(p - y)), 6) AS r2,
       round(avg(CASE WHEN abs(round_even(p, 0) - y) <= 5 THEN 1.0 WHEN p - y IS NOT NULL THEN 0.0 END), 6) AS accuracy_5,
       round(avg(CASE WHEN abs(round_even(p, 0) - y) <= 10 THEN 1.0 WHEN p - y IS NOT NULL THEN 0.0 END), 6) AS accuracy_10,
       round(avg(CASE WHEN abs(round_even(p, 0) - y) <= 20 THEN 1.0 WHEN p - y IS NOT NULL THEN 0.0 END), 6) AS accuracy_20"""


def _spearman_sql(src: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    pby = f"PARTITION BY {by}, " if by else "PARTITION BY "
    sel = f"{by}, " if by else ""
    return f"""(SELECT {sel}corr(ry, rp) AS spearman FROM (
  SELECT *, rank() OVER ({part} ORDER BY y) + (count(*) OVER ({pby}y) - 1) / 2.0 AS ry,
            rank() OVER ({part} ORDER BY p) + (count(*) OVER ({pby}p) - 1) / 2.0 AS rp FROM {src}) r
  {'GROUP BY ' + by if by else ''})"""


def _kendall_sql(src: str, by: str = "") -> str:
    sel = f"{by}, " if by else ""
    on = f"a.{by} = b.{by} AND " if by else ""
    g = f"GROUP BY {by}" if by else ""
    return f"""(SELECT {sel.replace(by, 'c.' + by) if by else ''}(nc - nd) / sqrt((n0 - n1) * (n0 - n2)) AS kendall FROM
  (SELECT {'a.' + by + ', ' if by else ''}sum(CASE WHEN a.p < b.p THEN a.n * b.n ELSE 0 END) AS nc,
          sum(CASE WHEN a.p > b.p THEN a.n * b.n ELSE 0 END) AS nd
   FROM (SELECT {sel}y, p, CAST(count(*) AS DOUBLE) AS n FROM {src} GROUP BY ALL) a
   JOIN (SELECT {sel}y, p, CAST(count(*) AS DOUBLE) AS n FROM {src} GROUP BY ALL) b ON {on}a.y < b.y
   {'GROUP BY a.' + by if by else ''}) c
  {'JOIN' if by else 'CROSS JOIN'} (SELECT {sel}sum(m * (m - 1) / 2) AS n1, sum(m) * (sum(m) - 1) / 2 AS n0
   FROM (SELECT {sel}y, CAST(count(*) AS DOUBLE) AS m FROM {src} GROUP BY ALL) GROUP BY ALL) t1 {'USING (' + by + ')' if by else ''}
  {'JOIN' if by else 'CROSS JOIN'} (SELECT {sel}sum(m * (m - 1) / 2) AS n2
   FROM (SELECT {sel}p, CAST(count(*) AS DOUBLE) AS m FROM {src} GROUP BY ALL) GROUP BY ALL) t2 {'USING (' + by + ')' if by else ''})"""


@register("eval_metrics", PAIRS_SQL + f"SELECT {ERR_SQL} FROM pairs")
def eval_metrics(spark, sf):
    return rounded(M.error_metrics(lag_pairs(spark, sf), []))


@register("spearman", PAIRS_SQL + f"SELECT round(spearman, 6) AS spearman FROM {_spearman_sql('pairs')}")
def spearman(spark, sf):
    return rounded(M.spearman(lag_pairs(spark, sf), []))


# Every 7th label and every 11th prediction missing; predictions spread to near-continuous doubles.
HOLES_SQL = """, holes AS (SELECT CASE WHEN (epoch_us(UpdateDT) // 1000000) % 7 <> 0 THEN y END AS y,
                  CASE WHEN (epoch_us(UpdateDT) // 1000000) % 11 <> 0 THEN p + (epoch_us(UpdateDT) // 1000000 % 1000) / 1000.0::DOUBLE END AS p
                  FROM pairs)
"""


def hole_pairs(spark, sf):
    s = F.unix_seconds(F.col("UpdateDT").cast("timestamp"))
    return lag_pairs(spark, sf).select(F.when(s % 7 != 0, F.col("y")).alias("y"),
                                       F.when(s % 11 != 0, F.col("p") + (s % 1000) / F.lit(1000.0)).alias("p"))


@register("eval_metrics_with_nulls", PAIRS_SQL + HOLES_SQL + f"SELECT {ERR_SQL} FROM holes")
def eval_metrics_with_nulls(spark, sf):
    return rounded(M.error_metrics(hole_pairs(spark, sf), []))


@register("spearman_continuous", PAIRS_SQL + HOLES_SQL + f"""
, whole AS (SELECT * FROM holes WHERE y IS NOT NULL AND p IS NOT NULL)
SELECT round(spearman, 6) AS spearman FROM {_spearman_sql('whole')}""")
def spearman_continuous(spark, sf):
    return rounded(M.spearman(hole_pairs(spark, sf), []))


@register("kendall", PAIRS_SQL + f"SELECT round(kendall, 6) AS kendall FROM {_kendall_sql('pairs')}")
def kendall(spark, sf):
    return rounded(M.kendall_tau_b(lag_pairs(spark, sf), []))


@register("kendall_continuous", PAIRS_SQL + HOLES_SQL + f"""
, whole AS (SELECT * FROM holes WHERE y IS NOT NULL AND p IS NOT NULL)
SELECT round(kendall, 6) AS kendall FROM {_kendall_sql('whole')}""")
def kendall_continuous(spark, sf):
    """Kendall on unrounded predictions, incomplete pairs left out."""
    return rounded(M.kendall_tau_b(hole_pairs(spark, sf), [], rounded=False))


CUT_SQL = """, tx AS (SELECT epoch_us(UpdateDT) AS t FROM {src} WHERE UpdateDT IS NOT NULL)
, cut AS (SELECT t AS cut_us FROM (SELECT t, row_number() OVER (ORDER BY t) AS rn, count(*) OVER () AS n FROM tx)
          WHERE rn = (4 * n + 4) // 5)
"""


@register("time_split", with_views("rankings") + CUT_SQL.format(src="rankings") + """
SELECT SubjectID, UpdateDT, Model, CASE WHEN epoch_us(UpdateDT) <= cut_us THEN 'train' ELSE 'test' END AS split,
       make_timestamp(cut_us) AS cutoff FROM rankings CROSS JOIN cut""")
def time_split(spark, sf):
    return M.time_split(rankings(spark, sf)).select("SubjectID", "UpdateDT", "Model", "split", "cutoff")


@register("median_baseline", with_views("rankings") + CUT_SQL.format(src="rankings") + f"""
, lab AS (SELECT Rank AS y, epoch_us(UpdateDT) <= cut_us AS is_train FROM rankings CROSS JOIN cut)
, med AS (SELECT median(y) AS p FROM lab WHERE is_train)
, pairs AS (SELECT y, p FROM lab CROSS JOIN med WHERE NOT is_train)
SELECT round(max(p), 6) AS median_rank, {ERR_SQL} FROM pairs""")
def median_baseline(spark, sf):
    s = M.time_split(rankings(spark, sf))
    train = s.where(F.col("split") == "train").agg(F.median("Rank").alias("p"))
    test = s.where(F.col("split") == "test").select(F.col("Rank").alias("y"))
    pairs = test.crossJoin(F.broadcast(train))  # one-row scalar
    m = M.error_metrics(pairs, [])
    return rounded(m.crossJoin(F.broadcast(train.select(F.col("p").alias("median_rank")))))


def compared(multi):
    """Narrow (subject, time, y, one column per model) table, written once to the shared folder."""
    return cut_lineage(multi.groupBy("SubjectID", "UpdateDT").agg(
        F.max(F.when(F.col("Model").isNull(), F.col("Rank"))).alias("y"),
        *[F.max(F.when(F.col("Model") == m, F.col("Rank"))).alias(m) for m in MODELS]))


def model_pairs(spark, sf):
    """Per model: observed rank vs that model's rank at the same (subject, time), newest 20% only."""
    return melted(M.time_split(compared(view(spark, sf, "rankings_multi"))).where(F.col("split") == "test"))


def melted(cmp):
    cols = [f"`{m}`" for m in MODELS]
    pairs = cmp.select("SubjectID", "UpdateDT", "y", F.expr(
        f"stack({len(MODELS)}, {', '.join(f'{chr(39)}{m}{chr(39)}, {c}' for m, c in zip(MODELS, cols))}) AS (model_name, p)"))
    return pairs.withColumn("eval_set", F.lit("newest_20pct"))


MODEL_PAIRS_SQL = with_views("rankings_multi") + """
, cmp AS (SELECT SubjectID, UpdateDT, max(CASE WHEN Model IS NULL THEN Rank END) AS y,
                 max(CASE WHEN Model = 'Random Forest' THEN Rank END) AS rf,
                 max(CASE WHEN Model = 'XGBoost' THEN Rank END) AS xgb
          FROM rankings_multi GROUP BY SubjectID, UpdateDT)
""" + CUT_SQL.format(src="cmp") + """
, test AS (SELECT * FROM cmp CROSS JOIN cut WHERE epoch_us(UpdateDT) > cut_us)
, mp AS (SELECT 'newest_20pct' AS eval_set, 'Random Forest' AS model_name, y, rf AS p FROM test
         UNION ALL SELECT 'newest_20pct', 'XGBoost', y, xgb FROM test)
"""


@register("leaderboard", MODEL_PAIRS_SQL + f"""
, e AS (SELECT eval_set, model_name, {ERR_SQL} FROM mp GROUP BY eval_set, model_name)
, s AS {_spearman_sql('mp', 'model_name')}
, k AS {_kendall_sql('mp', 'model_name')}
SELECT e.*, round(s.spearman, 6) AS spearman, round(k.kendall, 6) AS kendall,
       e.mae = min(e.mae) OVER (PARTITION BY e.eval_set) AS is_best_model
FROM e JOIN s USING (model_name) JOIN k USING (model_name)""")
def leaderboard(spark, sf):
    board = M.all_metrics(model_pairs(spark, sf), ["eval_set", "model_name"])
    return rounded(M.flag_best(board))


@register("predictions_with_error", MODEL_PAIRS_SQL + f"""
, e AS (SELECT model_name, avg(abs(p - y)) AS mae,
               avg(CASE WHEN abs(round_even(p, 0) - y) <= 10 THEN 1.0 ELSE 0.0 END) AS accuracy_10
        FROM mp GROUP BY model_name)
SELECT r.SubjectID, r.UpdateDT, r.Model, r.Rank AS predicted_rank,
       round(e.mae, 1) AS expected_error, round(e.accuracy_10 * 100, 1) AS within_10_pct,
       CAST(len(list_filter([{", ".join(f"r.Driver{i}" for i in range(1, 18))}], lambda x: x IS NOT NULL AND x <> ''))
            AS INTEGER) AS factors_used
FROM rankings_multi r LEFT JOIN e ON r.Model = e.model_name WHERE r.Model IS NOT NULL""")
def predictions_with_error(spark, sf):
    board = M.error_metrics(model_pairs(spark, sf), ["model_name"])
    info = board.select("model_name", F.round("mae", 1).alias("expected_error"),
                        F.round(F.col("accuracy_10") * 100, 1).alias("within_10_pct"))
    preds = view(spark, sf, "rankings_multi").where(F.col("Model").isNotNull())
    # the leaderboard has one row per model: a bounded broadcast
    x = preds.join(F.broadcast(info), preds["Model"] == info["model_name"], "left")
    return x.select("SubjectID", "UpdateDT", "Model", F.col("Rank").alias("predicted_rank"), "expected_error",
                    "within_10_pct", C.count_chosen(C.driver_array()).alias("factors_used"))


@register("leaderboard_merge", MODEL_PAIRS_SQL + f"""
, whole AS (SELECT 'newest_20pct' AS eval_set, 'Random Forest' AS model_name, y, rf AS p FROM cmp
            UNION ALL SELECT 'newest_20pct', 'XGBoost', y, xgb FROM cmp)
, base AS (SELECT eval_set, model_name, {ERR_SQL} FROM whole GROUP BY eval_set, model_name)
, fresh AS (SELECT eval_set, model_name, {ERR_SQL} FROM mp WHERE model_name = 'Random Forest' GROUP BY eval_set, model_name)
, med AS (SELECT median(y) AS p FROM cmp CROSS JOIN cut WHERE epoch_us(UpdateDT) <= cut_us)
, mid AS (SELECT eval_set, 'Median' AS model_name, y, med.p FROM mp CROSS JOIN med WHERE model_name = 'Random Forest')
SELECT * FROM base WHERE model_name <> 'Random Forest'
UNION ALL BY NAME SELECT * FROM fresh
UNION ALL BY NAME SELECT eval_set, model_name, {ERR_SQL} FROM mid GROUP BY eval_set, model_name""")
def leaderboard_merge(spark, sf):
    """A retrained model's row, under its long name, takes the place of the older one; a baseline is appended."""
    by = ["eval_set", "model_name"]
    multi = view(spark, sf, "rankings_multi")
    every = compared(multi)
    test = model_pairs(spark, sf)
    base = M.error_metrics(melted(every), by)
    fresh = (test.where(F.col("model_name") == "Random Forest")
             .withColumn("model_name", F.lit("Random Forest (retrained)")))
    cut = M.time_cutoff(every)
    older = F.unix_micros(F.col("UpdateDT").cast("timestamp")) <= F.lit(cut)
    med = every.where(older).agg(F.median("y").alias("p"))
    mid = (test.where(F.col("model_name") == "Random Forest").select("eval_set", "y").crossJoin(F.broadcast(med))
           .withColumn("model_name", F.lit("Median")))
    board = M.merge_leaderboards(base, M.error_metrics(fresh, by), M.error_metrics(mid, by),
                                 rename={"Random Forest (retrained)": "Random Forest"})
    return rounded(board)


@register("model_card", MODEL_PAIRS_SQL + f"""
, e AS (SELECT model_name, {ERR_SQL} FROM mp GROUP BY model_name)
, n AS (SELECT unnest(['XGBoost', 'No such model']) AS model_name)
SELECT model_name, mae, rmse, r2, round(accuracy_5 * 100, 1) AS within_5_pct, round(accuracy_10 * 100, 1) AS within_10_pct,
       round(accuracy_20 * 100, 1) AS within_20_pct
FROM n LEFT JOIN e USING (model_name)""")
def model_card(spark, sf):
    """Cards of a model of the leaderboard and of one that is not on it (NULLs)."""
    board = M.all_metrics(model_pairs(spark, sf), ["model_name"])
    cards = R.model_card(board, "XGBoost").unionByName(R.model_card(board, "No such model"))
    return rounded(cards.drop("spearman", "kendall", "expected_accuracy"))


@register("leaderboard_csv", "SELECT model_name, model_name || '.bin' AS filename, mae, rmse, r2, spearman, kendall, accuracy_5, accuracy_10, "
          "accuracy_20, is_best_model FROM (" + ORACLE["leaderboard"] + ")")
def leaderboard_csv(spark, sf):
    """The leaderboard written as a CSV with blanks behind the commas, and read by its fixed schema."""
    board = leaderboard(spark, sf).withColumn("filename", F.concat("model_name", F.lit(".bin")))
    names = LEADERBOARD.fieldNames()
    path = os.path.join(ensure_checkpoint_dir(spark), f"rankline-leaderboard-{uuid.uuid4().hex}")
    line = F.concat_ws(", ", *[F.col(c).cast("string") for c in names])
    # one row per model
    text = board.agg(F.concat_ws("\n", F.lit(",".join(names)), F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("value"))
    text.write.text(path)
    return read_leaderboard(spark, path)
