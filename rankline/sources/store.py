"""A table of rank observations in time slices, with a commit log and insert-if-absent.

Layout under one folder that all executors share::

    data/<write id>/_slice=2024-01-05/_bucket=3/part-*.parquet    rows, sorted by key
    log/commit=000000000007/part-*.parquet                        files of one commit

A row's slice is the day (or month) of its time, its bucket a hash of its subject; both numbers are
fixed when the table is created and kept in commit 0.  The log is the table's only file list: it
has one row per file with slice, bucket, row counts and first time.  Hence

* **an insert reads what its batch can meet**: the files of the batch's own (slice, bucket) pairs, key
  columns only.  Other dates and other subjects' files are not opened, however large the table is;
* **a half-written append is no part of the table**: files are written first, under a new write id,
  and become visible when the commit's folder is renamed into the log, the last step;
* **two writers cannot double a key**: a commit's number is taken by renaming onto a name that must not
  exist yet.  The writer that comes second checks its rows against the files committed meanwhile
  (only those) and tries the next number;
* **a replayed batch is told by its name**: ``batch_id`` is stored with the commit, in a commit that
  also stands for batches that add nothing.  This holds for rows with NULL keys too, which the
  ``null_safe=False`` form can never find again by their key.

The renaming must fail if the target exists, as it does in HDFS and POSIX file systems (Spark's own
streaming log relies on the same).  Files of writes that never committed are in nobody's way; ``unlisted``
names them.  Nothing but the file names that a read needs reaches the driver, as in any Spark scan.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from rankline.schema import KEY, RANKINGS
from rankline.session import cut_lineage
from rankline.sources.ingest import BROADCAST_KEYS, _has_null, _key_match, absent_rows, none_if_missing

# Slice of rows without a time: sorts before all others.
NO_TIME = "0000-00-00"
PERIODS = {"day": "yyyy-MM-dd", "month": "yyyy-MM"}
# One row per file or marker of a commit; a kind uses only some of the columns.
ENTRY = ("kind string, slice string, bucket int, file string, rows bigint, observed bigint, first_time timestamp_ntz, "
         "upto bigint, batch_id string, period string, buckets int")
LOG = ENTRY + ", commit bigint"
COLUMNS = RANKINGS.fieldNames()
PLACE = ["_slice", "_bucket"]
# Rows of a batch in one (slice, bucket) that go to one task; a pair with more is dealt out by key.
PIECE_ROWS = 250_000


class Conflict(Exception):
    """Other writers kept taking the next commit number."""


def _rename_if_absent(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder to a name that must be free; False if it is taken."""
    from py4j.protocol import Py4JJavaError
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    to = jvm.org.apache.hadoop.fs.Path(target)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.rename(jvm.org.apache.hadoop.fs.Path(source), to, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() in ("FileAlreadyExistsException", "DirectoryNotEmptyException"):
            return False
        raise


def _make_parent(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)


def log(spark: SparkSession, path: str) -> DataFrame:
    """One row per file and marker of every commit (columns ``LOG``)."""
    return spark.read.schema(LOG).parquet(f"{path}/log")


def _entries(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = [x.split()[0] for x in ENTRY.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ENTRY)


def commit(spark: SparkSession, path: str, number: int, entries: DataFrame) -> bool:
    """Make ``entries`` (columns ``ENTRY``) commit ``number``; False if that number is taken."""
    staged = f"{path}/staged/{uuid.uuid4().hex}"
    entries.coalesce(1).write.parquet(staged)
    return _rename_if_absent(spark, staged, f"{path}/log/commit={number:012d}")


def exists(spark: SparkSession, path: str) -> bool:
    return none_if_missing(lambda: log(spark, path)) is not None


def create_if_absent(spark: SparkSession, path: str, period: str = "day", buckets: int = 16) -> None:
    """An empty table; one that is there already keeps its period and buckets."""
    if exists(spark, path):
        return
    if period not in PERIODS or buckets < 1:
        raise ValueError(f"period must be one of {sorted(PERIODS)}, buckets at least 1")
    _make_parent(spark, f"{path}/log")
    commit(spark, path, 0, _entries(spark, [{"kind": "layout", "period": period, "buckets": buckets}]))


def layout(spark: SparkSession, path: str) -> tuple[str, int]:
    r = log(spark, path).where((F.col("commit") == 0) & (F.col("kind") == "layout")).first()
    return r.period, r.buckets


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("SubjectID"), F.lit(buckets)).cast("int")


def slice_of(period: str) -> Column:
    return F.coalesce(F.date_format("UpdateDT", PERIODS[period]), F.lit(NO_TIME))


def placed(rows: DataFrame, where: tuple[str, int]) -> DataFrame:
    period, buckets = where
    return rows.withColumns({"_slice": slice_of(period), "_bucket": bucket_of(buckets)})


def read_files(spark: SparkSession, path: str, files: DataFrame, schema=RANKINGS) -> DataFrame:
    """The rows of the files that a frame of log rows names."""
    names = [f"{path}/{r.file}" for r in files.select("file").distinct().collect()]
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)


def slice_in_path(name: str | None = None) -> Column:
    """Slice of a row read from the table's files, or of a column of file names."""
    return F.regexp_extract(F.col(name) if name else F.input_file_name(), "/_slice=([^/]*)/", 1)


def data_commit() -> Column:
    """Commit that the rows of a file came with: compacted files name it, others came with their own."""
    return F.coalesce("upto", "commit")


def current(entries: DataFrame, kind: str = "rows") -> DataFrame:
    """Log rows of the files of one kind, without those that ``compact`` has replaced."""
    gone = entries.where(F.col("kind") == "gone").select("file")
    return entries.where(F.col("kind") == kind).join(gone, "file", "left_anti")


def files_of(spark: SparkSession, path: str, kind: str = "rows", version: int | None = None) -> DataFrame:
    """Log rows of the files of one kind, up to a commit."""
    entries = log(spark, path)
    return current(entries if version is None else entries.where(F.col("commit") <= version), kind)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table, or what it was after a commit."""
    return read_files(spark, path, files_of(spark, path, version=version))


def head(spark: SparkSession, path: str) -> int:
    return log(spark, path).agg(F.max("commit")).first()[0]


def meeting(files: DataFrame, batch: DataFrame) -> DataFrame:
    """Log rows of the files that can hold keys of a placed batch."""
    pairs = batch.select(F.col("_slice").alias("slice"), F.col("_bucket").alias("bucket")).distinct()
    return files.join(pairs, ["slice", "bucket"], "left_semi")


def write_files(spark: SparkSession, path: str, rows: DataFrame, dealt: bool = False, **summary: Column) -> DataFrame:
    """Write placed rows as files of one (slice, bucket) each; their log rows, with ``summary`` aggregates.

    ``dealt``: the rows come by slice and bucket and sorted, as from ``picked``.
    """
    target = f"data/{uuid.uuid4().hex}"
    if not dealt:
        order = [c for c in ("SubjectID", "UpdateDT", "Model") if c in rows.columns]
        # rebalanced by slice and bucket: small pairs share a task, AQE splits a pair that a hot subject swells
        rows = rows.hint("rebalance", *PLACE).sortWithinPartitions(*PLACE, *order)
    rows.write.partitionBy(*PLACE).parquet(f"{path}/{target}")
    back = spark.read.schema(rows.drop(*PLACE).schema).parquet(f"{path}/{target}")
    # the place is taken from a file's name once, not from that of every row
    found = (back.groupBy(F.input_file_name().alias("_name"))
             .agg(F.count(F.lit(1)).alias("rows"), *[v.alias(k) for k, v in summary.items()]))
    at = F.concat(F.lit(target), F.substring_index("_name", target, -1))
    bucket = F.regexp_extract("_name", "/_bucket=([^/]*)/", 1).cast("int")
    return found.select(slice_in_path("_name").alias("slice"), bucket.alias("bucket"), at.alias("file"), "rows", *summary)


def logged(found: DataFrame, kind: str, upto: int | None = None) -> DataFrame:
    """Entries of written files."""
    names = [x.split() for x in ENTRY.split(", ")]
    given = {"kind": F.lit(kind), "upto": F.lit(upto)}
    return found.select(*[(F.col(n) if n in found.columns else given.get(n, F.lit(None))).cast(t).alias(n) for n, t in names])


def _stage(spark: SparkSession, path: str, rows: DataFrame, dealt: bool = False) -> DataFrame:
    observed = F.col("Model").isNull()
    found = write_files(spark, path, rows.select(*COLUMNS, *PLACE), dealt, observed=F.count_if(observed),
                        first_time=F.min(F.when(observed, F.col("UpdateDT"))))
    return cut_lineage(logged(found, "rows"))


def picked(rows: DataFrame, pairs: DataFrame, old: DataFrame | None, null_safe: bool) -> DataFrame:
    """Placed rows of a batch to insert, one per key that the placed keys ``old`` lack, as ``ingest.rows_to_insert`` picks them.

    ``pairs`` counts the batch's rows by place (_n).  Rows are dealt out by place, as they are written, and in large
    places also by key, so one shuffle and one sort tell the rows to insert and put them in the order of the files.
    """
    others = [c for c in COLUMNS if c not in KEY]
    own, new = [], []
    if not null_safe:  # a key with a NULL part never collides: each such row is a key of its own
        own = ["_own"]
        rows = rows.withColumn("_own", F.when(_has_null(), F.monotonically_increasing_id()))
    if old is not None:
        new = ["_new"]
        keys = old if null_safe else old.where(~_has_null())
        if (pairs.agg(F.sum("_n")).first()[0] or 0) <= BROADCAST_KEYS:
            # stream the files past the broadcast batch keys; only hits leave the scan
            mine = (rows if null_safe else rows.where(~_has_null())).select(*KEY)
            keys = keys.join(F.broadcast(mine), _key_match(keys, mine, null_safe), "left_semi")
        types = dict(rows.dtypes)
        keys = keys.select(*PLACE, *KEY, F.lit(0).alias("_new"), *[F.lit(None).cast(types[c]).alias(c) for c in [*others, *own]])
        rows = keys.unionByName(rows.withColumn("_new", F.lit(1)))
    many = pairs.select(*PLACE, F.ceil(F.col("_n") / PIECE_ROWS).alias("_pieces")).where("_pieces > 1")
    piece = F.pmod(F.xxhash64(*KEY, *own), F.coalesce("_pieces", F.lit(1)))
    rows = rows.join(F.broadcast(many), PLACE, "left").withColumn("_piece", piece).drop("_pieces")
    # the window is cut at the first row of a key before it holds any, however often the key comes
    by_key = W.partitionBy(*PLACE, *KEY, *own, "_piece").orderBy(*new, *others)
    rows = rows.repartition(*PLACE, "_piece").withColumn("_nth", F.row_number().over(by_key)).where("_nth = 1")
    if new:
        rows = rows.where("_new = 1")
    return rows.sortWithinPartitions(*PLACE, *KEY).select(*COLUMNS, *PLACE)


def insert(spark: SparkSession, path: str, new: DataFrame, null_safe: bool = True, batch_id: str | None = None,
           attempts: int = 50, settled: bool = False) -> int:
    """Append the rows of ``new`` whose key is absent; returns how many.

    ``null_safe=False``: a key with a NULL part is never found (SQLite's rule).  A batch whose ``batch_id`` is in the
    log adds nothing.  ``settled``: ``new`` gives the same rows cheaply whenever it is read (files, or columns made
    row by row from them), so it is read twice instead of written first.
    """
    where = layout(spark, path)
    pairs, seen, staged = None, -1, None
    for _ in range(attempts):
        entries = log(spark, path)
        last, done = entries.agg(F.max("commit"), F.max(F.col("batch_id") == F.lit(batch_id))).first()
        if done:  # known before any row of the batch is read
            return 0
        if pairs is None:
            rows = placed(new.select(*COLUMNS), where)
            rows = rows if settled else cut_lineage(rows)
            pairs = cut_lineage(rows.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("_n")))
        # files committed since the last look; the first time, all that the batch can meet
        fresh = current(entries.where(F.col("commit") <= last)).where(F.col("commit") > seen)
        met = cut_lineage(meeting(fresh, pairs).select("file"))
        if staged is None:
            old = None if met.isEmpty() else placed(read_files(spark, path, met).select(*KEY), where)
            staged = _stage(spark, path, picked(rows, pairs, old, null_safe), True)
        elif not met.isEmpty():
            mine = placed(read_files(spark, path, staged), where)
            left = cut_lineage(absent_rows(read_files(spark, path, met), mine, null_safe))
            if left.count() < mine.count():
                staged = _stage(spark, path, left)
        n = staged.agg(F.sum("rows")).first()[0] or 0
        if not n and batch_id is None:
            return 0
        marker = _entries(spark, [{"kind": "batch", "rows": n, "batch_id": batch_id}])
        if commit(spark, path, last + 1, staged.unionByName(marker)):
            return n
        seen = last
    raise Conflict(f"no commit after {attempts} attempts")


def compact(spark: SparkSession, path: str, most_files: int = 8, attempts: int = 50) -> int:
    """Write the rows of every (slice, bucket) with more than ``most_files`` files as few files again; returns the
    number of these pairs.

    The new files and the names of those they replace are one commit, so a reader sees either.  The old files stay, so
    that the table can be read as it was.  Rows that others insert meanwhile are in files of their own and are not
    touched; if another compaction has replaced one of the files first, this one adds nothing.
    """
    last = head(spark, path)
    files = files_of(spark, path, version=last)
    newest = F.max(F.when(F.col("observed") > 0, data_commit()))
    pairs = files.groupBy("slice", "bucket").agg(F.count(F.lit(1)).alias("n"), F.coalesce(newest, F.lit(last)).alias("upto"))
    pairs = cut_lineage(pairs.where(F.col("n") > most_files))
    n = pairs.count()
    if not n:
        return 0
    old = cut_lineage(files.join(pairs.select("slice", "bucket"), ["slice", "bucket"], "left_semi"))
    found = _stage(spark, path, placed(read_files(spark, path, old), layout(spark, path)))
    # observed rows are no newer than the files they come from, so summaries stay up to date
    kept = logged(found.drop("upto").join(pairs.select("slice", "bucket", "upto"), ["slice", "bucket"]), "rows")
    entries = kept.unionByName(logged(old.select("file"), "gone"))
    for _ in range(attempts):
        now = log(spark, path)
        taken = now.where((F.col("kind") == "gone") & (F.col("commit") > last)).join(old, "file", "left_semi")
        if not taken.isEmpty():
            return 0
        if commit(spark, path, now.agg(F.max("commit")).first()[0] + 1, entries):
            return n
    raise Conflict(f"no commit after {attempts} attempts")


def unlisted(spark: SparkSession, path: str) -> DataFrame:
    """(file) of data files that no commit lists: left by writers that failed, or at work now."""
    every = none_if_missing(lambda: spark.read.format("binaryFile").option("recursiveFileLookup", True)
                            .option("pathGlobFilter", "*.parquet").load(f"{path}/data"))
    if every is None:
        return spark.createDataFrame([], "file string")
    file = F.concat(F.lit("data"), F.substring_index("path", f"{path.rstrip('/')}/data", -1))
    return every.select(file.alias("file")).join(log(spark, path).select("file"), "file", "left_anti")
