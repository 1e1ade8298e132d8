"""Spark session helpers.

The library never hard-codes cluster settings; it only fills in defaults that
matter for correctness (UTC session time zone) and for local tests.  The
checkpoint directory is read from ``spark.checkpoint.dir``; a private scratch
folder is created only when the setting is missing and the master is local
(``local[n]``: one machine); on a cluster a missing setting is an error.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "rankline", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a scratch one only if unset."""
    path = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="rankline-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df):
    """Materialise ``df`` as a parquet table in the shared checkpoint folder and read it back.

    One job computes and writes the rows (a reliable RDD checkpoint of an
    unpersisted plan would compute it twice); the returned frame has no
    upstream lineage, so a lost executor re-reads files instead of recomputing.
    """
    import os
    import uuid
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), f"rankline-table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def summed(parts, key: str, *sums: str):
    """Sums per key of rows that the tasks have summed up already, a row per task and key.

    They are dealt out over as many tasks as there are cores: a pass that takes a second would spend most of it on
    the files and buffers of ``spark.sql.shuffle.partitions``."""
    from pyspark.sql import functions as F
    few = parts.repartition(max(1, parts.sparkSession.sparkContext.defaultParallelism), key)
    return few.groupBy(key).agg(*[F.sum(c).alias(c) for c in sums])
