"""Raw CSV ingest, table creation and idempotent insert-if-absent.

The raw source is text: every column a string, dates as 'M/D/YYYY H:MM'.
Ingest parses and types it, drops whole-row duplicates, marks the rows as
observed (OriginalDataFlag True, Model NULL) and sends unparsable rows to a
reject output instead of failing the whole load.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankline.functions.columns import parse_raw_ts, pad_to
from rankline.schema import DRIVERS, KEY, LEADERBOARD, NULL_TOKENS, RANKINGS
from rankline.session import cut_lineage

RAW_COLUMNS = ["SubjectID", "Rank", *DRIVERS, "UpdateDT"]
# New batches up to this many keys are matched against the table by
# broadcasting the batch keys (the table is streamed, never shuffled).
BROADCAST_KEYS = 2_000_000


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV read as text; columns the file lacks become NULL.  Malformed lines are left out
    (``read_csv_lines`` has them)."""
    return read_csv_lines(spark, path)[0]


def read_csv_lines(spark: SparkSession, path: str, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with RAW_COLUMNS, malformed lines as raw text with a reason) of CSV files.

    Every line with a character is one record, so files are split among tasks.  A line with too few or too
    many fields, or with a quote that it does not close, is malformed: nothing of it is taken, its text is kept.  A
    quoted field that goes over several lines is therefore malformed lines, the first and the last with an open
    quote (``read_multiline_csv`` reads such files, one task a file).  Header lines, the first or any other, are
    left out; ``columns`` names the fields, by default the header does.
    """
    columns = columns or spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    lines = spark.read.text(path).where(F.trim("value") != "")
    return _checked(lines, columns, F.col("value"))


_CORRUPT = "_corrupt_line"


def _checked(lines: DataFrame, columns: list[str], text: Column) -> tuple[DataFrame, DataFrame]:
    ddl = ", ".join(f"`{c}` string" for c in [*columns, _CORRUPT])
    parsed = lines.select(text.alias("raw"), F.from_csv(text, ddl, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}).alias("f"))
    header = F.lit(True)
    for c in columns:
        header = header & F.col(f"f.`{c}`").eqNullSafe(F.lit(c))
    # the parser closes a quote at the end of the line by itself
    quotes = F.length(F.regexp_replace("raw", r'\\.|[^"]', ""))
    reason = (F.when(quotes % 2 == 1, "open quote").when(F.col(f"f.{_CORRUPT}").isNotNull(), "number of fields"))
    parsed = parsed.where(~header).withColumn("reason", reason)
    rows = parsed.where(F.col("reason").isNull()).select(*[F.col(f"f.`{c}`").alias(c) for c in columns])
    return align_raw(rows), parsed.where(F.col("reason").isNotNull()).select("raw", "reason")


def read_multiline_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows with RAW_COLUMNS, malformed records as raw text with a reason) of header CSV files whose quoted
    fields may hold line ends.  A file cannot be split, so it is one task's work; a quote that is never closed makes
    the rest of its file one malformed record."""
    reader = spark.read.option("header", True).option("multiLine", True).option("columnPruning", False)
    columns = reader.csv(path).columns
    ddl = ", ".join(f"`{c}` string" for c in [*columns, _CORRUPT])
    parsed = cut_lineage(reader.schema(ddl).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT).csv(path))
    bad = parsed.where(F.col(_CORRUPT).isNotNull())
    return (align_raw(parsed.where(F.col(_CORRUPT).isNull()).drop(_CORRUPT)),
            bad.select(F.col(_CORRUPT).alias("raw"), F.lit("number of fields").alias("reason")))


def align_raw(raw: DataFrame) -> DataFrame:
    have = set(raw.columns)
    return raw.select(*[F.col(c).cast("string") if c in have else F.lit(None).cast("string").alias(c)
                        for c in RAW_COLUMNS])


def _null_tokens(c: str) -> Column:
    return F.when(F.col(c).isin(*NULL_TOKENS), F.lit(None)).otherwise(F.col(c))


def _text_to_int(name: str, typ: str) -> Column:
    # SQLite integer affinity: '12' and '12.0' are integers, 'x' is not
    whole = F.expr(f"try_cast(trim({name}) AS {typ})")
    dbl = F.expr(f"try_cast(trim({name}) AS DOUBLE)")
    # out of range is no integer either: the row goes to the rejects
    return F.coalesce(whole, F.when(dbl == F.floor(dbl), F.expr(f"try_cast(try_cast(trim({name}) AS DOUBLE) AS {typ})")))


def ingest(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Return (rows, rejects) from a text frame with RAW_COLUMNS."""
    x = raw.select(*[_null_tokens(c).alias(c) for c in RAW_COLUMNS])
    x = x.withColumn("_ts", parse_raw_ts("UpdateDT"))
    x = x.withColumns({"_sid": _text_to_int("SubjectID", "bigint"), "_rank": _text_to_int("Rank", "int")})
    reason = (F.when(F.col("_ts").isNull(), F.lit("bad UpdateDT"))
               .when(F.col("SubjectID").isNotNull() & F.col("_sid").isNull(), F.lit("bad SubjectID"))
               .when(F.col("Rank").isNotNull() & F.col("_rank").isNull(), F.lit("bad Rank")))
    x = x.withColumn("_reason", reason)
    rejects = x.where(F.col("_reason").isNotNull()).select(*RAW_COLUMNS, F.col("_reason").alias("reason"))
    good = x.where(F.col("_reason").isNull()).select(
        F.col("_sid").alias("SubjectID"), F.col("_rank").alias("Rank"), *DRIVERS, F.col("_ts").alias("UpdateDT"),
        F.lit(True).alias("OriginalDataFlag"), F.lit(None).cast("string").alias("Model"))
    # whole-row dedup: map-side partial aggregation collapses hot copies before the shuffle
    return good.dropDuplicates(), rejects


def save_bucketed(df: DataFrame, table: str, n_buckets: int) -> None:
    """Store rows bucketed and sorted by SubjectID, so per-subject windows and
    joins on SubjectID read co-located data without a shuffle."""
    (df.write.mode("overwrite").bucketBy(n_buckets, "SubjectID").sortBy("SubjectID", "UpdateDT")
       .format("parquet").saveAsTable(table))


def read_leaderboard(spark: SparkSession, path: str) -> DataFrame:
    """Model-summary CSV with a fixed schema; blanks after commas are tolerated."""
    return (spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True)
            .option("ignoreTrailingWhiteSpace", True).schema(LEADERBOARD).csv(path))


def read_table_or_none(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    """The table at ``path`` or None when it does not exist (existence check, no data read)."""
    return none_if_missing(lambda: spark.read.format(fmt).load(path))


def none_if_missing(read):
    """What ``read`` returns, or None if its path does not exist; any other error is raised."""
    from pyspark.errors import AnalysisException
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def create_if_absent(spark: SparkSession, path: str) -> None:
    """Create an empty table with the fixed schema unless one exists."""
    spark.createDataFrame([], RANKINGS).write.mode("ignore").parquet(path)


def rows_from_lists(spark: SparkSession, records: list[tuple]) -> DataFrame:
    """(SubjectID, Rank, drivers list, UpdateDT text, flag, model) -> table rows; drivers padded to 17."""
    schema = ("SubjectID bigint, Rank int, drivers array<string>, UpdateDT string, "
              "OriginalDataFlag boolean, Model string")
    df = spark.createDataFrame(records, schema)
    d = pad_to(F.col("drivers"))
    return df.select("SubjectID", "Rank", *[d[i].alias(f"Driver{i + 1}") for i in range(len(DRIVERS))],
                     F.to_timestamp_ntz("UpdateDT").alias("UpdateDT"), "OriginalDataFlag", "Model")


def _key_match(left: DataFrame, right: DataFrame, null_safe: bool) -> Column:
    eq = (lambda a, b: a.eqNullSafe(b)) if null_safe else (lambda a, b: a == b)
    cond = None
    for k in KEY:
        c = eq(left[k], right[k])
        cond = c if cond is None else cond & c
    return cond


def _one_per_key(rows: DataFrame, others: list[str]) -> DataFrame:
    """KEY and ``_v``, the smallest struct of ``others`` of every key.

    Rows are dealt out by key before they are sorted: the smallest struct is found in sorted rows, and tasks that
    read the source would sort (and spill) all they read.
    """
    return rows.repartition(*KEY).groupBy(*KEY).agg(F.min(F.struct(*others)).alias("_v"))


def _has_null() -> Column:
    return F.col("SubjectID").isNull() | F.col("UpdateDT").isNull() | F.col("Model").isNull()


def dedup_batch(new: DataFrame, null_safe: bool = True) -> DataFrame:
    """One row per key inside a batch (deterministic: smallest remaining values).

    With ``null_safe=False`` rows with a NULL key part never collide (SQLite
    primary-key behaviour), so they are all kept.
    """
    others = [c for c in new.columns if c not in KEY]
    keyed = new if null_safe else new.where(~_has_null())
    pick = _one_per_key(keyed, others).select(*KEY, "_v.*").select(*new.columns)
    return pick if null_safe else pick.unionByName(new.where(_has_null()))


def rows_to_insert(existing: DataFrame, new: DataFrame, null_safe: bool = True,
                   broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of ``new`` whose key is absent from ``existing`` (duplicates skipped, not errors).

    One pass by key: the keys that exist are grouped with the batch, where they come first, so a batch row is
    shuffled once for both questions.
    """
    new = new.select(*existing.columns)
    others = [c for c in new.columns if c not in KEY]
    types = dict(new.dtypes)
    keyed, keys = new, existing.select(*KEY)
    if not null_safe:
        keyed, keys = new.where(~_has_null()), keys.where(~_has_null())
    if broadcast_keys and new.count() <= broadcast_keys:
        # stream the table past the broadcast batch keys; only hits leave the scan
        bk = keyed.select(*KEY)
        keys = keys.join(F.broadcast(bk), _key_match(keys, bk, null_safe), "left_semi")
    keys = keys.select(*KEY, F.lit(0).alias("_new"), *[F.lit(None).cast(types[c]).alias(c) for c in others])
    every = keys.unionByName(keyed.withColumn("_new", F.lit(1)))
    pick = _one_per_key(every, ["_new", *others]).where(F.col("_v._new") == 1).select(*KEY, "_v.*").select(*new.columns)
    return pick if null_safe else pick.unionByName(new.where(_has_null()))


def absent_rows(existing: DataFrame, batch: DataFrame, null_safe: bool = True,
                broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of ``batch`` (one per key) whose key ``existing`` lacks."""
    ex_keys = existing.select(*KEY)
    n_batch = batch.count() if broadcast_keys else None
    if n_batch is not None and n_batch <= broadcast_keys:
        # stream the table past the broadcast batch keys; only hits leave the scan
        bk = batch.select(*KEY)
        hits = ex_keys.join(F.broadcast(bk), _key_match(ex_keys, bk, null_safe), "left_semi")
        return batch.join(hits, _key_match(batch, hits, null_safe), "left_anti")
    return batch.join(ex_keys, _key_match(batch, ex_keys, null_safe), "left_anti")


def insert_if_absent(spark: SparkSession, path: str, new: DataFrame, null_safe: bool = True) -> int:
    """Append absent rows to the parquet table at ``path``; returns rows appended.

    Idempotent: replaying the same batch appends nothing.  The rows to add are
    written to the checkpoint folder first so the append does not read the
    directory it writes to.
    """
    create_if_absent(spark, path)
    existing = spark.read.schema(RANKINGS).parquet(path)
    add = cut_lineage(rows_to_insert(existing, new, null_safe))
    n = add.count()
    if n:
        add.write.mode("append").parquet(path)
    return n
