"""Registered queries: model training, evaluation, scoring, importances, tuning.

What a learner fits is checked by rows only (no SQL twin).  Scoring, ordinal prediction and
importances are also registered with given weights, which SQL can repeat exactly.
"""

from __future__ import annotations

import os
import uuid
from functools import partial, reduce
from itertools import product

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankline.operators import features as FE
from rankline.operators import history as H
from rankline.operators import metrics as M
from rankline.operators.factors import position_columns, resolve_vocabulary
from rankline.plans import boosting as B
from rankline.plans import models as ML
from rankline.plans.catalog import register, rounded
from rankline.plans.q_history import FIXTURE_VOCAB, WORD, _features_sql, input_rows, positions_sql, rankings, serve_sql
from rankline.plans.sql_twins import with_views
from rankline.schema import DRIVERS, RANK_MAX
from rankline.session import cut_lineage, ensure_checkpoint_dir
from rankline.sources.fixtures import dealt_view, view
from rankline.streaming.jobs import score_rows

PCA_K = 10
# A given linear model and given ordinal weights (binary fractions, so sums are exact).
LINEAR = {"PrevRank": 0.5, "AvgPreviousRanks": 0.25, "DaysSincePrev": -0.125, "Factor1": 1.5, "Factor2": -0.75}
INTERCEPT = 20.0
LINEAR_SQL = " + ".join([f"{INTERCEPT}::DOUBLE", *(f'"{c}" * ({w}::DOUBLE)' for c, w in LINEAR.items())])
THETA = [80.0 - 0.5 * k for k in range(RANK_MAX - 1)]
KEEP_SQL = ", ".join(DRIVERS) + ","
CHOSEN_SQL = "len(list_filter([" + ", ".join(DRIVERS) + "], lambda x: x IS NOT NULL AND x <> ''))"
TUNE_GRID = [{"maxDepth": 3, "maxIter": 10}, {"maxDepth": 5, "maxIter": 10},
             {"maxDepth": 3, "maxIter": 20}, {"maxDepth": 5, "maxIter": 20}]

BOOST_GRID = [{"rate": 0.1, "leaves": 8}, {"rate": 0.1, "leaves": 24}, {"rate": 0.3, "leaves": 8}, {"rate": 0.3, "leaves": 24}]


def split_features(spark, sf):
    """(train, test, vocabulary): enhanced features of the observed rows, split by time (newest 20 % = test); the
    vocabulary is that of the training rows."""
    r = M.time_split(FE.training_rows(rankings(spark, sf)))
    vocab = resolve_vocabulary(r.where(F.col("split") == "train"))
    # reused by every learner and the evaluation: written once as a table in the shared checkpoint folder (no
    # cache held, no recompute), dealt out so that every pass over it uses all cores
    feats = FE.rank_features(r, vocab, keep=["SubjectID", "UpdateDT", "Model", "Rank", "split", "cutoff"])
    s = cut_lineage(feats.repartition(max(2, spark.sparkContext.defaultParallelism)))
    return s.where(F.col("split") == "train"), s.where(F.col("split") == "test"), vocab


def _train_eval(spark, sf, name):
    train, test, vocab = split_features(spark, sf)
    cols = ML.feature_columns(vocab)
    model = ML.fit(train, cols, name)
    pred = model.transform(test)
    return rounded(M.flag_best(ML.evaluate(pred, name, "newest_20pct")))


@register("train_rf")
def train_rf(spark, sf):
    return _train_eval(spark, sf, "Random Forest")


@register("train_gbt")
def train_gbt(spark, sf):
    return _train_eval(spark, sf, "Gradient Boosting")


@register("train_hist_boost")
def train_hist_boost(spark, sf):
    """Second-order histogram boosting, judged as the other learners are."""
    train, test, vocab = split_features(spark, sf)
    pred = B.fit(train, ML.feature_columns(vocab)).transform(test)
    return rounded(M.flag_best(ML.evaluate(pred, "Histogram boosting", "newest_20pct")))


@register("training_fit", with_views("rankings") + """
, o AS (SELECT * FROM rankings WHERE Model IS NULL)
, tx AS (SELECT epoch_us(UpdateDT) AS t FROM o WHERE UpdateDT IS NOT NULL)
, cut AS (SELECT t AS cut_us FROM (SELECT t, row_number() OVER (ORDER BY t) AS rn, count(*) OVER () AS n FROM tx) WHERE rn = (4 * n + 4) // 5)
SELECT unnest(['Random Forest', 'Gradient Boosting', 'Histogram boosting']) AS model_name,
       (SELECT count(*) FROM o CROSS JOIN cut WHERE epoch_us(UpdateDT) <= cut_us) AS n, true AS below_variance, 1.0::DOUBLE AS importance_sum""")
def training_fit(spark, sf):
    """What must hold of learners on their own training rows: a mean squared error below the variance of the labels,
    importances that add up to 1."""
    train, _, vocab = split_features(spark, sf)
    cols, parts = ML.feature_columns(vocab), []
    for name in ("Random Forest", "Gradient Boosting", "Histogram boosting"):
        if name == "Histogram boosting":
            model = B.fit(train, cols, rounds=6, loss="squared")
            total = sum(model.importances().values())
        else:
            model = ML.fit(train, cols, name)
            total = float(sum(model.stages[-1].featureImportances.toArray()))
        err = F.col("prediction") - F.col("Rank")
        parts.append(model.transform(train).agg(F.lit(name).alias("model_name"), F.count(F.lit(1)).alias("n"),
                                                (F.avg(err * err) < F.var_pop("Rank")).alias("below_variance"),
                                                F.lit(total).alias("importance_sum")))
    return rounded(reduce(DataFrame.unionByName, parts))


def _gain_sql(f: str) -> str:
    return f"""
SELECT '{f}' AS Feature, max(GL * GL / (HL + 1) + (G - GL) * (G - GL) / (H - HL + 1) - G * G / (H + 1)) / 2 AS gain FROM (
  SELECT sum(g) OVER (ORDER BY v) AS GL, sum(n) OVER (ORDER BY v) AS HL, sum(g) OVER () AS G, sum(n) OVER () AS H
  FROM (SELECT "{f}" AS v, sum(g) AS g, CAST(count(*) AS DOUBLE) AS n FROM d GROUP BY 1)) WHERE HL < H"""


@register("boosting_root_gains", with_views("rankings") + f"""
, pos AS (SELECT Rank, {positions_sql(FIXTURE_VOCAB)} FROM rankings WHERE Model IS NULL)
, d AS (SELECT pos.*, (SELECT median(Rank) FROM pos) - Rank AS g FROM pos)
, r AS ({" UNION ALL ".join(map(_gain_sql, FIXTURE_VOCAB))})
SELECT Feature, round(gain, 4) AS gain FROM r WHERE gain > 0.000000001""")
def boosting_root_gains(spark, sf):
    """Gain of the best first split of every factor's position (squared loss, from the median rank)."""
    pos = FE.training_rows(rankings(spark, sf)).select("Rank", *position_columns(FIXTURE_VOCAB))
    return rounded(spark.createDataFrame(B.root_gains(pos, FIXTURE_VOCAB), "Feature string, gain double"), 4)


@register("tune_boosting")
def tune_boosting(spark, sf):
    """Histogram boosting tuned by successive halving over one binned table."""
    train, _, vocab = split_features(spark, sf)
    return rounded(B.tune(train.drop("split", "cutoff"), ML.feature_columns(vocab), BOOST_GRID))


@register("train_ordinal")
def train_ordinal(spark, sf):
    train, test, vocab = split_features(spark, sf)
    cols = ML.feature_columns(vocab)
    fitted = ML.ordinal_fit(train, cols, RANK_MAX)
    pred = ML.ordinal_predict(fitted, test)
    return rounded(ML.evaluate(pred, "Ordinal LogisticIT", "newest_20pct"))


@register("pca_features")
def pca_features(spark, sf):
    train, test, vocab = split_features(spark, sf)
    cols = ML.feature_columns(vocab)
    model = ML.pipeline(cols, None, pca_k=PCA_K).fit(train)
    out = model.transform(train.unionByName(test))
    arr = vector_to_array("features")
    return rounded(out.select("SubjectID", "UpdateDT", "Model", "Rank", "split",
                              *[arr[i].alias(f"pc{i + 1}") for i in range(PCA_K)]))


def _first_time(spark, meta):
    return spark.range(1).select(F.lit(meta["first_time"]).cast("timestamp_ntz").alias("_t_first"))


def _model_folder(spark):
    return os.path.join(ensure_checkpoint_dir(spark), f"rankline-models-{uuid.uuid4().hex}")


_TRAIN_SQL = _features_sql("apr").replace("FROM events)", "FROM events WHERE event_type NOT IN ('purchase', 'error'))", 1)


def _pca_sql() -> str:
    cols = ML.feature_columns(FIXTURE_VOCAB)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    corr = lambda a, b: f"coalesce(CASE WHEN stddev_samp(\"{a}\") > 0 AND stddev_samp(\"{b}\") > 0 THEN corr(\"{a}\", \"{b}\") END, 0)"
    one = " + ".join(f"CASE WHEN stddev_samp(\"{c}\") > 0 THEN 1.0 ELSE 0.0 END" for c in cols)
    two = " + ".join(f"pow({corr(a, b)}, 2)" for a, b in pairs)
    return f"""WITH f AS ({_TRAIN_SQL})
, tx AS (SELECT epoch_us(UpdateDT) AS t FROM f WHERE UpdateDT IS NOT NULL)
, cut AS (SELECT t AS cut_us FROM (SELECT t, row_number() OVER (ORDER BY t) AS rn, count(*) OVER () AS n FROM tx) WHERE rn = (4 * n + 4) // 5)
, older AS (SELECT f.* FROM f CROSS JOIN cut WHERE epoch_us(UpdateDT) <= cut_us)
SELECT {len(cols)} AS n_components, round(CAST({one} AS DOUBLE), 3) AS total_variance, round(CAST({one} AS DOUBLE) + 2 * ({two}), 3) AS sum_of_squares,
       0.0::DOUBLE AS largest_covariance FROM older"""


@register("pca_variance", _pca_sql())
def pca_variance(spark, sf):
    """All components of the training rows: their variances add up as the scaled features' do, their squares as the
    squared correlations do, and no two of them vary together."""
    train, _, vocab = split_features(spark, sf)
    cols = ML.feature_columns(vocab)
    arr = vector_to_array("features")
    pcs = ML.pipeline(cols, None, pca_k=len(cols)).fit(train).transform(train).select(*[arr[i].alias(f"p{i}") for i in range(len(cols))])
    names = pcs.columns
    var = [F.var_samp(c) for c in names]
    cov = [F.abs(F.covar_samp(a, b)) for i, a in enumerate(names) for b in names[i + 1:]]
    out = pcs.agg(F.lit(len(cols)).alias("n_components"), sum(var[1:], var[0]).alias("total_variance"),
                  sum((v * v for v in var[1:]), var[0] * var[0]).alias("sum_of_squares"), F.greatest(*cov).alias("largest_covariance"))
    return rounded(out, 3)


@register("score_batch")
def score_batch(spark, sf):
    """Fit on the observed rows, save the model under its name, load it and score the new rows by its saved columns."""
    hist = rankings(spark, sf)
    train = FE.training_rows(hist)
    name, vocab = "Gradient Boosting", resolve_vocabulary(train)
    _, first = H.profile(train)
    cols, folder = ML.feature_columns(vocab), _model_folder(spark)
    ML.save_model(ML.fit(FE.rank_features(train, vocab), cols, name), ML.model_path(folder, name), vocab, cols, first)
    model, meta = ML.load_model(spark, ML.model_path(folder, name))
    out = score_rows(hist, view(spark, sf, "inputs"), model, meta["vocabulary"], name, first_time=_first_time(spark, meta),
                     columns=meta["feature_columns"])
    return out.select("event_id", "SubjectID", "UpdateDT", "prediction", F.col("Rank").alias("predicted_rank"))


@register("score_saved_model", with_views("rankings", "inputs") + serve_sql(keep=KEEP_SQL) + f"""
, tr AS (SELECT CAST(Rank AS DOUBLE) AS y, CAST(coalesce(lag(Rank) OVER ({WORD}), 0) AS DOUBLE) AS x FROM rankings WHERE Model IS NULL)
, m AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS base FROM tr)
, l AS (SELECT served.*, base + slope * PrevRank AS prediction FROM served CROSS JOIN m)
SELECT event_id, SubjectID, UpdateDT, round(prediction, 4) AS prediction FROM l WHERE {CHOSEN_SQL} > 0""")
def score_saved_model(spark, sf):
    """A linear regression on the previous rank, saved beside another model, loaded by its name and scored."""
    hist = rankings(spark, sf)
    train = FE.training_rows(hist)
    feats = cut_lineage(FE.rank_features(train, FIXTURE_VOCAB))
    _, first = H.profile(train)
    folder = _model_folder(spark)
    for name, cols in (("Linear previous rank", ["PrevRank"]), ("Linear mean rank", ["AvgPreviousRanks"])):
        est = LinearRegression(featuresCol="features", labelCol=ML.LABEL, solver="normal")
        ML.save_model(ML.pipeline(cols, est).fit(feats), ML.model_path(folder, name), FIXTURE_VOCAB, cols, first)
    model, meta = ML.load_model(spark, ML.model_path(folder, "Linear previous rank"))
    out = score_rows(hist, view(spark, sf, "inputs"), model, meta["vocabulary"], "Linear", first_time=_first_time(spark, meta),
                     columns=meta["feature_columns"])
    return rounded(out.select("event_id", "SubjectID", "UpdateDT", "prediction"), 4)


@register("score_linear", with_views("rankings", "inputs") + serve_sql(keep=KEEP_SQL) + f"""
, l AS (SELECT *, {LINEAR_SQL} AS prediction FROM served)
SELECT event_id, SubjectID, UpdateDT, round(prediction, 6) AS prediction,
       CAST(round_even(prediction, 0) AS INTEGER) AS predicted_rank FROM l WHERE {CHOSEN_SQL} > 0""")
def score_linear(spark, sf):
    out = score_rows(rankings(spark, sf), view(spark, sf, "inputs"), ML.LinearScorer(LINEAR, INTERCEPT), FIXTURE_VOCAB, "Linear")
    return rounded(out.select("event_id", "SubjectID", "UpdateDT", "prediction", F.col("Rank").alias("predicted_rank")))


@register("ordinal_predict_fixed", with_views("rankings", "inputs") + serve_sql() + f"""
, l AS (SELECT event_id, {" + ".join(f'"{c}" * ({w}::DOUBLE)' for c, w in LINEAR.items())} AS margin FROM served)
SELECT event_id, CAST(1 + len(list_filter([{", ".join(map(str, THETA))}]::DOUBLE[], lambda t: t - margin < 0)) AS DOUBLE) AS prediction
FROM l""")
def ordinal_predict_fixed(spark, sf):
    """Ordinal prediction with given weights: one class more per threshold that the margin passes."""
    fitted = {"prep": None, "cols": list(LINEAR), "w": list(LINEAR.values()), "theta": [-t for t in THETA], "n_ranks": RANK_MAX}
    feats = FE.serving_features(rankings(spark, sf), input_rows(spark, sf), FIXTURE_VOCAB)
    return ML.ordinal_predict(fitted, feats).select("event_id", "prediction")


_SLOPES_SQL = " UNION ALL ".join(f"SELECT '{f}' AS Feature, abs(regr_slope(Rank, \"{f}\")) AS Importance FROM pos" for f in FIXTURE_VOCAB)


@register("importance_coefficients", with_views("rankings") + f"""
, pos AS (SELECT Rank, {positions_sql(FIXTURE_VOCAB)} FROM rankings WHERE Model IS NULL)
, imp AS ({_SLOPES_SQL})
SELECT Feature, round(Importance, 6) AS Importance FROM imp ORDER BY Importance DESC, Feature LIMIT 10""")
def importance_coefficients(spark, sf):
    """Top-10 absolute coefficients of a linear model: the slope of the rank over each factor's position."""
    obs = FE.training_rows(rankings(spark, sf))
    pos = obs.select("Rank", *position_columns(FIXTURE_VOCAB))
    slopes = pos.agg(*[F.regr_slope(F.col("Rank").cast("double"), F.col(f).cast("double")).alias(f) for f in FIXTURE_VOCAB]).first()
    model = ML.LinearScorer({f: slopes[f] or 0.0 for f in FIXTURE_VOCAB})
    return rounded(ML.feature_importance(model, top_n=10, factors_only=True))


# Ranks up to these are the first classes; the rest is the last.
CLASS_ENDS = (20, 60)
_CLASS_SQL = "CASE " + " ".join(f"WHEN Rank <= {e} THEN {i}" for i, e in enumerate(CLASS_ENDS)) + f" ELSE {len(CLASS_ENDS)} END"


@register("importance_matrix", with_views("rankings") + f"""
, d AS (SELECT Driver1 AS f, {_CLASS_SQL} AS c, CAST(count(*) AS DOUBLE) AS n FROM rankings WHERE Model IS NULL GROUP BY ALL)
, l AS (SELECT d.f, d.c, ln(d.n) - ln(r.n) AS b FROM d JOIN d r ON d.c = r.c AND r.f = '{FIXTURE_VOCAB[-1]}' WHERE d.f <> '{FIXTURE_VOCAB[-1]}')
, m AS (SELECT f, abs(b - avg(b) OVER (PARTITION BY f)) AS b FROM l)
SELECT 'Driver1_' || f AS Feature, round(avg(b), 4) AS Importance FROM m GROUP BY f""")
def importance_matrix(spark, sf):
    """Mean absolute coefficients over the classes of a fitted multinomial model: rank classes by first factor.

    One indicator for each factor but the last leaves the model free to meet all class shares, so its
    coefficients are the centred logarithms of their ratios."""
    obs = FE.training_rows(rankings(spark, sf))
    cls = F.lit(len(CLASS_ENDS))
    for i, e in reversed(list(enumerate(CLASS_ENDS))):
        cls = F.when(F.col("Rank") <= e, i).otherwise(cls)
    x = cut_lineage(obs.select(cls.cast("double").alias("label"), *[(F.col("Driver1") == f).cast("double").alias(f"Driver1_{f}")
                                                                    for f in FIXTURE_VOCAB[:-1]]))
    est = LogisticRegression(featuresCol="features", labelCol="label", family="multinomial", maxIter=500, tol=1e-13, standardization=False)
    model = ML.pipeline(x.columns[1:], est).fit(x)
    return rounded(ML.feature_importance(model), 4)


@register("importance_fallback", with_views("rankings") + f"""
SELECT DISTINCT f AS Feature, CAST(1 AS DOUBLE) AS Importance
FROM (SELECT unnest([{", ".join(DRIVERS)}]) AS f FROM rankings) WHERE f IS NOT NULL AND f <> ''""")
def importance_fallback(spark, sf):
    """A model without importances: every chosen factor counts 1."""
    chosen = resolve_vocabulary(rankings(spark, sf))
    bare = PipelineModel([VectorAssembler(inputCols=["PrevRank"], outputCol="features")])
    return ML.feature_importance(bare, chosen=chosen)


@register("feature_importance")
def feature_importance(spark, sf):
    """Top-10 factor features of a random forest by importance (the report's view)."""
    train, _, vocab = split_features(spark, sf)
    model = ML.fit(train, ML.feature_columns(vocab), "Random Forest")
    return ML.feature_importance(model, top_n=10, factors_only=True)


@register("tune_gbt")
def tune_gbt(spark, sf):
    train, _, vocab = split_features(spark, sf)
    return rounded(ML.tune(train.drop("split", "cutoff"), ML.feature_columns(vocab), "Gradient Boosting", TUNE_GRID))


@register("model_leaderboard")
def model_leaderboard(spark, sf):
    """RF, GBT, ordinal (fitted at the same time) and two baselines on one test set; best = lowest MAE."""
    from multiprocessing.pool import ThreadPool
    train, test, vocab = split_features(spark, sf)
    cols = ML.feature_columns(vocab)

    def one(name):
        if name == "Ordinal LogisticIT":
            pred = ML.ordinal_predict(ML.ordinal_fit(train, cols, RANK_MAX), test)
        else:
            pred = ML.fit(train, cols, name).transform(test)
        return pred.select(F.col("Rank").alias("y"), F.col("prediction").alias("p"), F.lit(name).alias("model_name"))

    # a fit's small stages and its steps on the driver leave cores free, which the others use
    names = ("Random Forest", "Gradient Boosting", "Ordinal LogisticIT")
    with ThreadPool(len(names)) as pool:
        parts = pool.map(one, names, 1)
    med = train.agg(F.median("Rank").alias("p"))
    parts.append(test.select(F.col("Rank").alias("y")).crossJoin(F.broadcast(med))
                 .withColumn("model_name", F.lit("Median")))
    parts.append(test.select(F.col("Rank").alias("y"), F.col("PrevRank").cast("double").alias("p"),
                             F.lit("Previous rank").alias("model_name")))
    pairs = parts[0]
    for p in parts[1:]:
        pairs = pairs.unionByName(p)
    pairs = pairs.withColumn("eval_set", F.lit("newest_20pct"))
    return rounded(M.flag_best(M.all_metrics(pairs, ["eval_set", "model_name"])))


FEATURE_SETS = ("base positional", "base one-hot", "base PCA", "enhanced positional")


SET_LABELS = ["SubjectID", "UpdateDT", "Model", "Rank"]


def _set_plans(obs):
    """(base positional, base one-hot, enhanced positional) features of the observed rows, and whether a row is older than the split."""
    older = F.unix_micros(F.col("UpdateDT").cast("timestamp")) <= F.lit(M.time_cutoff(obs))
    return (*FE.base_features(obs, obs.where(older), FIXTURE_VOCAB), FE.rank_features(obs, FIXTURE_VOCAB)), older


def feature_set_frames(spark, sf):
    """name -> (train, test, feature columns, number of principal components or None), one time split."""
    plans, older = _set_plans(FE.training_rows(rankings(spark, sf)))
    out = {}
    # written once each and dealt out, so that every pass of every learner uses all cores
    positional, onehot, enhanced = [cut_lineage(df.repartition(max(2, spark.sparkContext.defaultParallelism))) for df in plans]
    for name, df, k in zip(FEATURE_SETS, (positional, onehot, onehot, enhanced), (None, None, PCA_K, None)):
        out[name] = (df.where(older), df.where(~older), [c for c in df.columns if c not in SET_LABELS], k)
    return out


def _as_vectors(df, older, cols):
    """(Rank, older, x): the features as one vector per row, the shorter of its sparse and dense forms; dealt out and written once."""
    whole = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in cols]
    x = df.where(older.isNotNull()).select("Rank", older.alias("older"), array_to_vector(F.array(*whole)).alias("_dense"))
    size = VectorSizeHint(inputCol="_dense", size=len(cols), handleInvalid="optimistic")
    x = VectorAssembler(inputCols=["_dense"], outputCol="x", handleInvalid="keep").transform(size.transform(x)).drop("_dense")
    return cut_lineage(x.repartition(max(2, df.sparkSession.sparkContext.defaultParallelism)))


def feature_set_vectors(spark, sf, pool):
    """name -> a call that waits for (train, test, feature names) of a feature set, made by the threads of ``pool``.

    The sets are tables (Rank, older, x) with the features in one vector: hundreds of columns would be read and assembled
    one by one in every pass of every learner.  The components are fitted once, on the older rows, and written as well."""
    plans, older = _set_plans(FE.training_rows(dealt_view(spark, sf, "rankings")))

    def whole(df):
        cols = [c for c in df.columns if c not in SET_LABELS]
        return _as_vectors(df, older, cols), cols

    def components(onehot):
        table, _ = onehot.get()
        pca = ML.pipeline(["x"], None, pca_k=PCA_K).fit(table.where("older"))
        parts = pca.transform(table).select("Rank", "older", F.col("features").alias("x"))
        return cut_lineage(parts), [f"pc{i + 1}" for i in range(PCA_K)]

    made = {name: pool.apply_async(whole, (df,)) for name, df in zip(("base positional", "base one-hot", "enhanced positional"), plans)}
    made["base PCA"] = pool.apply_async(components, (made["base one-hot"],))

    def ready(name):
        table, cols = made[name].get()
        return table.where("older AND Rank IS NOT NULL"), table.where("NOT older"), cols

    return {name: partial(ready, name) for name in FEATURE_SETS}


# Learners of the grid, each of its full size and on every set; those of many small passes first, so that the others fill the cores.
GRID_LEARNERS = ("Gradient Boosting", "Histogram boosting", "Ordinal LogisticIT", "Random Forest")
# Fits at a time.
GRID_FITS = 6


def _grid_predictions(name, train, test, cols):
    """The test rows with the predictions of one learner on one feature set."""
    if name in ("Random Forest", "Gradient Boosting"):
        return ML.pipeline(["x"], ML.regressor(name)).fit(train).transform(test)
    if name == "Histogram boosting":
        return B.fit(train, cols, vector="x").transform(test)
    return ML.ordinal_predict(ML.ordinal_fit(train, ["x"], RANK_MAX), test)


@register("feature_set_leaderboard")
def feature_set_leaderboard(spark, sf):
    """Every learner on every feature set (some fits at a time), judged on the same newest rows; median baseline appended."""
    from multiprocessing.pool import ThreadPool
    ensure_checkpoint_dir(spark)
    with ThreadPool(GRID_FITS) as pool:
        sets = feature_set_vectors(spark, sf, pool)

        def one(job):
            feature_set, name = job
            pred = _grid_predictions(name, *sets[feature_set]())
            return cut_lineage(pred.select(F.col("Rank").alias("y"), F.col("prediction").alias("p"), F.lit(name).alias("model_name"),
                                           F.lit(feature_set).alias("feature_set")))

        # the sets that are ready first are taken first, the components last
        parts = pool.map(one, product(("enhanced positional", "base positional", "base one-hot", "base PCA"), GRID_LEARNERS), 1)
    train, test, _ = sets["enhanced positional"]()
    med = train.agg(F.median("Rank").alias("p"))
    parts.append(test.select(F.col("Rank").alias("y")).crossJoin(F.broadcast(med))
                 .withColumns({"model_name": F.lit("Median"), "feature_set": F.lit("none")}))
    pairs = reduce(DataFrame.unionByName, parts).withColumn("eval_set", F.lit("newest_20pct"))
    return rounded(M.flag_best(M.all_metrics(pairs, ["eval_set", "feature_set", "model_name"])))


@register("feature_sets_written", with_views("rankings") + """
, o AS (SELECT * FROM rankings WHERE Model IS NULL)
, tx AS (SELECT epoch_us(UpdateDT) AS t FROM o WHERE UpdateDT IS NOT NULL)
, cut AS (SELECT t AS cut_us FROM (SELECT t, row_number() OVER (ORDER BY t) AS rn, count(*) OVER () AS n FROM tx) WHERE rn = (4 * n + 4) // 5)
, s AS (SELECT CASE WHEN epoch_us(UpdateDT) <= cut_us THEN 'train' ELSE 'test' END AS split, Rank FROM o CROSS JOIN cut)
, n AS (SELECT unnest(['base positional', 'base one-hot', 'enhanced positional']) AS feature_set, unnest([25, 297, 22]) AS n_features)
SELECT feature_set, split, n_features, count(*) AS n_rows, CAST(sum(Rank) AS BIGINT) AS label_sum FROM s CROSS JOIN n GROUP BY ALL""")
def feature_sets_written(spark, sf):
    """The feature sets written by name and split, and read back: columns, rows and label sums."""
    base = os.path.join(ensure_checkpoint_dir(spark), f"rankline-sets-{uuid.uuid4().hex}")
    frames = {k: v for k, v in feature_set_frames(spark, sf).items() if v[3] is None}
    both = {k: tr.withColumn("split", F.lit("train")).unionByName(te.withColumn("split", F.lit("test")))
            for k, (tr, te, _, _) in frames.items()}
    ML.write_feature_sets(both, base)
    parts = [spark.read.parquet(os.path.join(base, f"feature_set={k}")).groupBy("split").agg(
        F.lit(k).alias("feature_set"), F.lit(len(frames[k][2])).alias("n_features"), F.count(F.lit(1)).alias("n_rows"),
        F.sum("Rank").alias("label_sum")) for k in both]
    return reduce(DataFrame.unionByName, parts)
