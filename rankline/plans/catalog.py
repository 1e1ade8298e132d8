"""Query catalogue: every registered key -> (Spark builder, DuckDB twin).

Each builder takes (spark, sf_dir) and returns a lazy DataFrame over the whole
input tables.  Double outputs are rounded to 6 decimals here (only here) so the
two engines agree despite different summation orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (comparison-friendly output)."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


def load_all() -> None:
    # importing the modules registers their queries
    from rankline.plans import q_history, q_factors, q_quality, q_ingest, q_eval, q_models, q_store, q_stream  # noqa: F401
