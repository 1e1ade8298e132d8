"""Table contracts.

The ``rankings`` table is one wide observation per (subject, time[, model]):
Rank 1 is the highest risk; Driver1 is the strongest factor, Driver17 the
weakest, so a row is an ordering of factors.
"""

from __future__ import annotations

from pyspark.sql import types as T

N_DRIVERS = 17
DRIVERS = [f"Driver{i}" for i in range(1, N_DRIVERS + 1)]
KEY = ["SubjectID", "UpdateDT", "Model"]
REQUIRED = ["SubjectID", "Rank", "UpdateDT"]

# Fixed values that must equal the reference for equal results.
# Rank scale: 1 (highest risk) to 265.
RANK_MIN, RANK_MAX = 1, 265
# Default factor names used when the table is empty.
DEFAULT_FACTORS = ["Factor1", "Factor2", "Factor3", "Factor4", "Factor5"]
# Subject id given to input rows without one.
NEW_SUBJECT = "new_input"
# Raw timestamp text of the source CSV and the stored text form.
RAW_TS_FORMAT = "M/d/yyyy H:mm"
STORED_TS_FORMAT = "yyyy-MM-dd HH:mm:ss"
# PrevRank used when no reference ranks exist.
DEFAULT_PREV_RANK = 50.0
# Accuracy is reported as the share of predictions within these many ranks.
ACCURACY_KS = (5, 10, 20)
# Model names offered for scoring.
MODEL_NAMES = ["XGBoost", "Random Forest", "LightGBM", "Gradient Boosting"]
# Text a pandas CSV reader turns into missing values (default na_values).
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
               "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
               "n/a", "nan", "null"]
# Column types of the stored table as the schema contract names them.
CONTRACT_TYPES = {"SubjectID": "INTEGER", "Rank": "INTEGER",
                  **{d: "TEXT" for d in DRIVERS},
                  "UpdateDT": "TEXT", "OriginalDataFlag": "BOOLEAN", "Model": "TEXT"}

RANKINGS = T.StructType(
    [T.StructField("SubjectID", T.LongType()), T.StructField("Rank", T.IntegerType())]
    + [T.StructField(d, T.StringType()) for d in DRIVERS]
    + [T.StructField("UpdateDT", T.TimestampNTZType()),
       T.StructField("OriginalDataFlag", T.BooleanType()),
       T.StructField("Model", T.StringType())]
)

RAW_CSV = T.StructType(
    [T.StructField(c, T.StringType()) for c in ["SubjectID", "Rank", *DRIVERS, "UpdateDT"]]
)

LEADERBOARD = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("mae", T.DoubleType()),
    T.StructField("rmse", T.DoubleType()),
    T.StructField("r2", T.DoubleType()),
    T.StructField("spearman", T.DoubleType()),
    T.StructField("kendall", T.DoubleType()),
    T.StructField("accuracy_5", T.DoubleType()),
    T.StructField("accuracy_10", T.DoubleType()),
    T.StructField("accuracy_20", T.DoubleType()),
    T.StructField("is_best_model", T.BooleanType()),
])

# Spark type -> contract type prefix (used by the schema check).
SPARK_TO_CONTRACT = {
    "bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER",
    "string": "TEXT", "timestamp_ntz": "TEXT", "timestamp": "TEXT", "boolean": "BOOLEAN",
}
