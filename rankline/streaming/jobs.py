"""Structured Streaming jobs: idempotent insert and micro-batch scoring.

Both use ``foreachBatch`` with a checkpoint location and a table with a commit log
(``sources.store``).  A batch is committed under the query's id and the batch's
number, so a batch that is replayed after a failure appends nothing twice, and
the insert reads only the files that the batch's keys can be in.  Late or
out-of-order rows need no state store: features come from the stored table
(summaries per subject and slice, ``operators.summaries``), never from stream state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from rankline.functions.columns import count_chosen, driver_array, half_even_int
from rankline.operators import summaries
from rankline.operators.features import align_features, serving_features
from rankline.schema import DRIVERS, RANKINGS
from rankline.session import cut_lineage
from rankline.sources import store


def _start(stream: DataFrame, fn, checkpoint: str, available_now: bool) -> StreamingQuery:
    w = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def batch_name(spark: SparkSession, epoch_id: int) -> str:
    """Name of a micro-batch: the query's id is kept in its checkpoint, so a replay has the same name."""
    query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not query:
        raise RuntimeError("a micro-batch without a query id cannot be told from others")
    return f"{query}/{epoch_id}"


def stream_insert(spark: SparkSession, source_dir: str, table_path: str, checkpoint: str,
                  files_per_batch: int | None = None, available_now: bool = True,
                  null_safe: bool = True, dedup_delay: str | None = None) -> StreamingQuery:
    """Parquet files of table rows arriving in ``source_dir`` -> insert-if-absent into ``table_path``.

    ``dedup_delay`` (e.g. "1 hour") also drops repeated keys inside the stream
    with ``dropDuplicatesWithinWatermark``: repeats arriving within the delay
    never reach the table anti-join.  Zone-less times are cast to timestamps
    for the watermark (which rejects timestamp_ntz).  Correctness does not
    depend on it: the anti-join against the table still catches late repeats.
    """
    store.create_if_absent(spark, table_path)
    reader = spark.readStream.schema(RANKINGS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(source_dir)
    if dedup_delay:
        stream = (stream.withColumn("_event_time", F.col("UpdateDT").cast("timestamp"))
                        .withWatermark("_event_time", dedup_delay)
                        .dropDuplicatesWithinWatermark(["SubjectID", "UpdateDT", "Model"]))

    def batch(df: DataFrame, epoch_id: int) -> None:
        # a batch of files can be read twice; one with state is written before
        store.insert(df.sparkSession, table_path, df.drop("_event_time"), null_safe=null_safe,
                     batch_id=batch_name(df.sparkSession, epoch_id), settled=not dedup_delay)

    return _start(stream, batch, checkpoint, available_now)


def scorable(new: DataFrame, settled: bool = False) -> DataFrame:
    """Rows with a chosen factor, their subject id as a number; written once, as they are read several times.

    ``settled``: ``new`` gives the same rows cheaply whenever it is read (files), so it is read again instead.
    """
    chosen = count_chosen(driver_array())
    rows = new.where(chosen > 0).withColumn("SubjectID", F.expr("try_cast(nullif(SubjectID, '') AS BIGINT)"))
    return rows if settled else cut_lineage(rows)


def predictions(feats: DataFrame, model, model_name: str, id_col: str = "event_id", columns: list[str] | None = None) -> DataFrame:
    """id, table columns and prediction; with ``columns``, the model is given just these features, missing ones as 0."""
    if columns is not None:
        feats = align_features(feats, [id_col, "SubjectID", *DRIVERS, "UpdateDT", *columns])
    return model.transform(feats).select(
        id_col, "SubjectID", half_even_int("prediction").alias("Rank"), *DRIVERS, "UpdateDT",
        F.lit(False).alias("OriginalDataFlag"), F.lit(model_name).alias("Model"), "prediction")


def score_rows(history: DataFrame, new: DataFrame, model, vocab: list[str], model_name: str,
               id_col: str = "event_id", first_time: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """Score new rows against the observed rows of ``history``: id, table columns and prediction.

    Rows without any chosen factor are not scored.  Rows without a subject id are scored as new
    subjects; their SubjectID is NULL, so they cannot be stored.
    ``first_time`` and ``columns``: the first time and the feature columns that the model was saved with.
    """
    feats = serving_features(history, scorable(new), vocab, id_col=id_col, first_time=first_time, keep=DRIVERS)
    return predictions(feats, model, model_name, id_col, columns)


def score_against_table(spark: SparkSession, table_path: str, new: DataFrame, model, vocab: list[str], model_name: str,
                        id_col: str = "event_id", first_time: DataFrame | None = None, settled: bool = False) -> DataFrame:
    """``score_rows`` with the stored table's observed rows as history, read through its summaries."""
    feats = summaries.serving_features(spark, table_path, scorable(new, settled), vocab, id_col=id_col, first=first_time, keep=DRIVERS)
    return predictions(feats, model, model_name, id_col)


def stream_score(spark: SparkSession, source_dir: str, input_schema, table_path: str, checkpoint: str,
                 model, vocab: list[str], model_name: str, unkeyed_path: str,
                 files_per_batch: int | None = None, available_now: bool = True,
                 first_time: DataFrame | None = None) -> StreamingQuery:
    """New input rows arriving as files -> features vs observed history -> model -> insert-if-absent.

    History is the observed rows of the table, so predictions that earlier batches stored change
    nothing and the order of the files does not matter.  Predictions for rows without a subject id
    have no key to be stored under: they go, with their input's id, to ``unkeyed_path`` (one folder per
    batch, rewritten if the batch is replayed; ``unkeyed_predictions`` reads them).
    """
    store.create_if_absent(spark, table_path)
    reader = spark.readStream.schema(input_schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(source_dir)

    def batch(df: DataFrame, epoch_id: int) -> None:
        s = df.sparkSession
        # a batch of files is read again, not written before it is scored
        rows = cut_lineage(score_against_table(s, table_path, df, model, vocab, model_name, first_time=first_time, settled=True))
        rows.where(F.col("SubjectID").isNull()).write.mode("overwrite").parquet(f"{unkeyed_path}/batch={epoch_id}")
        store.insert(s, table_path, rows.where(F.col("SubjectID").isNotNull()).select(*RANKINGS.fieldNames()),
                     batch_id=batch_name(s, epoch_id), settled=True)

    return _start(stream, batch, checkpoint, available_now)


def unkeyed_predictions(spark: SparkSession, unkeyed_path: str) -> DataFrame:
    """The predictions that a scoring stream could not store for want of a subject id."""
    full = T.StructType([T.StructField("event_id", T.LongType()), *RANKINGS.fields, T.StructField("prediction", T.DoubleType())])
    return spark.read.schema(full).parquet(unkeyed_path)
