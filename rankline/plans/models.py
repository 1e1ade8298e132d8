"""Rank models on Spark ML: pipelines, training, scoring, importances, tuning.

Features come from ``operators.features``; train-time constants (factor
vocabulary, feature order, global first time) are stored next to the fitted
``PipelineModel`` so serving rebuilds exactly the same columns.
"""

from __future__ import annotations

import json
import os
import re

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankline.functions.columns import half_even_int
from rankline.operators import metrics as M
from rankline.operators.features import HISTORY_FEATURES
from rankline.plans.ordinal import ordinal_fit, ordinal_loss, ordinal_predict  # noqa: F401
from rankline.schema import MODEL_NAMES
from rankline.session import ensure_checkpoint_dir

SEED = 42
LABEL = "Rank"


def feature_columns(vocab: list[str]) -> list[str]:
    return [*HISTORY_FEATURES, *vocab]


def regressor(name: str, **params):
    """Named presets of Spark ML.  The other names of ``MODEL_NAMES`` are models of external
    libraries: asking for one is an error, not another model under its name."""
    common = dict(featuresCol="features", labelCol=LABEL, seed=SEED)
    if name == "Random Forest":
        est = RandomForestRegressor(numTrees=40, maxDepth=8, subsamplingRate=1.0, **common)
    elif name == "Gradient Boosting":
        est = GBTRegressor(maxIter=20, maxDepth=5, stepSize=0.1, checkpointInterval=10, **common)
    elif name in MODEL_NAMES:
        raise ValueError(f"{name} needs its own Spark library, which is not installed")
    else:
        raise ValueError(f"unknown model {name}")
    return est.setParams(**params) if params else est


def pipeline(cols: list[str], est, scale: bool = False, pca_k: int | None = None) -> Pipeline:
    stages = [VectorAssembler(inputCols=cols, outputCol="raw" if (scale or pca_k) else "features",
                              handleInvalid="keep")]
    src = "raw"
    if scale or pca_k:
        stages.append(StandardScaler(inputCol="raw", outputCol="scaled" if pca_k else "features",
                                     withMean=True, withStd=True))
        src = "scaled" if pca_k else "features"
    if pca_k:
        stages.append(PCA(k=pca_k, inputCol=src, outputCol="features"))
    if est is not None:
        stages.append(est)
    return Pipeline(stages=stages)


def fit(train: DataFrame, cols: list[str], name: str, **kw) -> PipelineModel:
    ensure_checkpoint_dir(train.sparkSession)
    return pipeline(cols, regressor(name), **kw).fit(train.where(F.col(LABEL).isNotNull()))


def score(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """Prediction plus the half-even rounded rank."""
    out = model.transform(df)
    return out.select(*keep, F.col("prediction"), half_even_int("prediction").alias("predicted_rank"))


class LinearScorer:
    """A linear model with given coefficients, scored as a column expression (no learner)."""

    def __init__(self, coefficients: dict[str, float], intercept: float = 0.0):
        self.coefficients, self.intercept = coefficients, intercept

    def transform(self, df: DataFrame) -> DataFrame:
        terms = [F.col(c).cast("double") * F.lit(float(w)) for c, w in self.coefficients.items()]
        return df.withColumn("prediction", sum(terms, F.lit(float(self.intercept))))


def evaluate(pred: DataFrame, model_name: str, eval_set: str) -> DataFrame:
    pairs = pred.select(F.col(LABEL).alias("y"), F.col("prediction").alias("p")) \
                .withColumns({"model_name": F.lit(model_name), "eval_set": F.lit(eval_set)})
    return M.all_metrics(pairs, ["eval_set", "model_name"])


def model_path(folder: str, name: str) -> str:
    """Where a folder of models keeps the one of this name."""
    return os.path.join(folder, re.sub(r"[^A-Za-z0-9]+", "_", name))


def save_model(model: PipelineModel, path: str, vocab: list[str], cols: list[str], first_time) -> None:
    model.write().overwrite().save(path)
    meta = {"vocabulary": vocab, "feature_columns": cols,
            "first_time": None if first_time is None else str(first_time)}
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
         .write.mode("overwrite").text(os.path.join(path, "rankline_meta"))


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    meta = json.loads(spark.read.text(os.path.join(path, "rankline_meta")).first()[0])
    return PipelineModel.load(path), meta


def write_feature_sets(sets: dict[str, DataFrame], base_dir: str, split_col: str = "split") -> None:
    """Write each feature set under base_dir/feature_set=<name>/, partitioned by split."""
    for name, df in sets.items():
        w = df.write.mode("overwrite")
        if split_col in df.columns:
            w = w.partitionBy(split_col)
        w.parquet(os.path.join(base_dir, f"feature_set={name}"))


def feature_importance(model, top_n: int | None = None, factors_only: bool = False,
                       chosen: list[str] | None = None) -> DataFrame:
    """(Feature, Importance) sorted descending; names from the assembler, so lengths agree.

    Tree models give ``featureImportances``; linear models the absolute
    coefficients (mean over classes for a matrix).  A model that exposes neither gives
    importance 1 to each factor of ``chosen`` (the factors of the row being explained).
    """
    spark = SparkSession.getActiveSession()
    if isinstance(model, LinearScorer):
        names, last = list(model.coefficients), None
    else:
        names, last = model.stages[0].getInputCols(), model.stages[-1]
    if last is None:
        imp = [abs(v) for v in model.coefficients.values()]
    elif hasattr(last, "featureImportances"):
        imp = last.featureImportances.toArray().tolist()
    elif hasattr(last, "coefficientMatrix"):
        import numpy as np
        imp = np.abs(last.coefficientMatrix.toArray()).mean(axis=0).tolist()
    elif hasattr(last, "coefficients"):
        imp = [abs(v) for v in last.coefficients.toArray().tolist()]
    elif chosen is not None:
        names, imp = list(chosen), [1.0] * len(chosen)
    else:
        raise ValueError("model exposes no importances and no chosen factors are given")
    n = min(len(names), len(imp))
    df = spark.createDataFrame(list(zip(names[:n], [float(v) for v in imp[:n]])), "Feature string, Importance double")
    if factors_only:
        df = df.where(F.col("Feature").contains("Factor"))
    df = df.orderBy(F.col("Importance").desc(), F.col("Feature"))
    return df.limit(top_n) if top_n else df


# ---- hyper-parameter search with a time-ordered validation fold ---------------------------

def tune(train: DataFrame, cols: list[str], name: str, grid: list[dict], num: int = 4, den: int = 5,
         parallelism: int = 4) -> DataFrame:
    """Fit every grid point on the older part of ``train``, ``parallelism`` of them at a time, score the newer part (MAE).

    Returns one row per grid point with the validation MAE and ``chosen``.
    Random splits would leak future rows into training, hence the time cut.
    """
    from multiprocessing.pool import ThreadPool

    from pyspark.ml.evaluation import RegressionEvaluator

    s = M.time_split(train, num=num, den=den)
    fit_part = s.where(F.col("split") == "train").drop("split", "cutoff")
    val_part = s.where(F.col("split") == "test").drop("split", "cutoff")
    est = regressor(name)
    pipe = pipeline(cols, est)
    maps = [{getattr(est, k): v for k, v in g.items()} for g in grid]
    ev = RegressionEvaluator(labelCol=LABEL, predictionCol="prediction", metricName="mae")
    ensure_checkpoint_dir(train.sparkSession)
    fit_part = fit_part.where(F.col(LABEL).isNotNull()).persist()
    fits = pipe.fitMultiple(fit_part, maps)

    def one(_):
        i, model = next(fits)
        return i, json.dumps(grid[i], sort_keys=True), float(ev.evaluate(model.transform(val_part)))

    with ThreadPool(max(1, min(parallelism, len(grid)))) as pool:
        rows = pool.map(one, grid, 1)
    fit_part.unpersist()
    best = min(rows, key=lambda r: (r[2], r[0]))[0]
    spark = train.sparkSession
    return spark.createDataFrame([(r[0], r[1], r[2], r[0] == best) for r in sorted(rows)],
                                 "grid_index int, params string, validation_mae double, chosen boolean")
