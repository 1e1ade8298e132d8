"""Data-quality checks on the rankings table; each check yields report rows.

The report reads each input once: the table is pre-aggregated to one row per key and the
source to its distinct rows, both written to the shared folder, and every check reads
these.  Examples are ordered top-5 (distributed TakeOrdered), never a collected group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankline.functions.columns import has_repeat, driver_array, parse_stored_ts
from rankline.schema import CONTRACT_TYPES, KEY, REQUIRED, SPARK_TO_CONTRACT
from rankline.session import cut_lineage

REPORT_SCHEMA = "check string, status string, passed boolean, count bigint, examples string"
N_EXAMPLES = 5


def schema_check(df: DataFrame) -> dict:
    """Contract check on metadata only: missing (error), extra (warning), type prefix, key columns."""
    actual = {f.name: SPARK_TO_CONTRACT.get(f.dataType.simpleString(), f.dataType.simpleString().upper())
              for f in df.schema.fields}
    missing = sorted(set(CONTRACT_TYPES) - set(actual))
    extra = sorted(set(actual) - set(CONTRACT_TYPES))
    mismatch = sorted(c for c, t in CONTRACT_TYPES.items() if c in actual and not actual[c].startswith(t))
    key_ok = all(k in actual for k in KEY)
    passed = not missing and not extra and not mismatch and key_ok
    detail = ";".join([*(f"missing:{c}" for c in missing), *(f"extra:{c}" for c in extra),
                       *(f"type:{c}" for c in mismatch)] + ([] if key_ok else ["key"]))
    return dict(check="schema", status="PASSED" if passed else "FAILED", passed=passed,
                count=len(missing) + len(extra) + len(mismatch), examples=detail)


def _bad_ts(c: str, df: DataFrame) -> Column:
    if dict(df.dtypes)[c] != "string":
        return F.lit(False)
    return F.col(c).isNotNull() & parse_stored_ts(c).isNull()


def row_checks(df: DataFrame) -> DataFrame:
    """One pass: null counts of required fields, bad timestamps, flag/model profiles."""
    flag, model = F.col("OriginalDataFlag"), F.col("Model")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in REQUIRED],
        F.count_if(_bad_ts("UpdateDT", df)).alias("bad_timestamps"),
        F.coalesce(F.bool_and(F.coalesce(flag, F.lit(False))), F.lit(True)).alias("flags_all_true"),
        F.coalesce(F.bool_and(model.isNull()), F.lit(True)).alias("models_all_null"),
        F.coalesce(F.bool_and(F.coalesce(flag, F.lit(False)) == model.isNull()), F.lit(True)).alias("live_consistent"),
    )


def duplicate_keys(df: DataFrame) -> DataFrame:
    """Rows minus distinct keys (NULLs compare equal; first occurrence is free)."""
    total = df.agg(F.count(F.lit(1)).alias("n_rows"))
    distinct = df.select(*KEY).distinct().agg(F.count(F.lit(1)).alias("n_keys"))
    return total.crossJoin(distinct).withColumn("duplicates", F.col("n_rows") - F.col("n_keys"))


def examples(values: DataFrame, c: str, n: int = N_EXAMPLES) -> DataFrame:
    """First n distinct values in order, joined with ','; one row."""
    top = values.select(F.col(c).cast("string").alias(c)).distinct().orderBy(c).limit(n)
    return top.agg(F.coalesce(F.array_join(F.array_sort(F.collect_list(c)), ","), F.lit("")).alias("examples"))


def bad_timestamps(df: DataFrame) -> DataFrame:
    bad = df.where(_bad_ts("UpdateDT", df))
    return bad.agg(F.count(F.lit(1)).alias("bad_timestamps")).crossJoin(examples(bad, "UpdateDT"))


def missing_subjects(source: DataFrame, table: DataFrame) -> DataFrame:
    """Source subject ids (as text) absent from the table: count and first examples."""
    s = source.select(F.col("SubjectID").cast("string").alias("SubjectID")).distinct()
    t = table.select(F.col("SubjectID").cast("string").alias("SubjectID")).distinct()
    miss = s.join(t, s["SubjectID"].eqNullSafe(t["SubjectID"]), "left_anti")
    cnt = s.agg(F.count(F.lit(1)).alias("n_source_subjects")).crossJoin(
        miss.agg(F.count(F.lit(1)).alias("n_missing")))
    return cnt.crossJoin(examples(miss, "SubjectID"))


def reconcile(source_raw: DataFrame, table: DataFrame) -> DataFrame:
    """Unique source rows vs table rows: fewer = error, more = warning, equal = ok."""
    su = source_raw.distinct().agg(F.count(F.lit(1)).alias("source_unique"))
    tr = table.agg(F.count(F.lit(1)).alias("table_rows"))
    x = su.crossJoin(tr)
    status = (F.when(F.col("table_rows") < F.col("source_unique"), F.lit("error"))
               .when(F.col("table_rows") > F.col("source_unique"), F.lit("warning")).otherwise(F.lit("ok")))
    return x.withColumn("status", status)


# Buckets of the checksums that two tables are compared by.
DIGEST_BUCKETS = 4096


def _row_hashes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b): two 64-bit hashes of every row, NULLs and column borders told apart."""
    # one text per row keeps the expression small wherever the optimiser repeats it
    text = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]), {"ignoreNullFields": "false"})
    return df.select(text.alias("_text")).select(F.xxhash64("_text").alias("a"), F.xxhash64(F.lit(1), "_text").alias("b"))


def checksums(hashes: DataFrame, buckets: int = DIGEST_BUCKETS) -> DataFrame:
    """(bucket, n, s1 .. s4): rows of every bucket of hashes and the sums of their halves, whatever the order of rows."""
    low, high = (lambda c: F.sum(F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)))), (lambda c: F.sum(F.shiftrightunsigned(c, 32)))
    return (hashes.groupBy(F.pmod("a", F.lit(buckets)).cast("int").alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n"), low("a").alias("s1"), high("a").alias("s2"), low("b").alias("s3"), high("b").alias("s4")))


def table_differences(left: DataFrame, right: DataFrame, columns: list[str] | None = None,
                      buckets: int = DIGEST_BUCKETS) -> DataFrame:
    """(a, b, n_left, n_right) of rows that two tables do not hold equally often, by their hashes.

    Both tables are reduced to one checksum per bucket of row hashes, map-side, so equal tables shuffle nothing but
    checksums; only the hashes of rows in buckets that differ are grouped and compared.
    """
    columns = columns or left.columns
    hashes = [_row_hashes(df, columns) for df in (left, right)]
    sums = ["n", "s1", "s2", "s3", "s4"]
    l, r = (checksums(h, buckets) for h in hashes)
    r = r.select("bucket", *[F.col(c).alias(f"_{c}") for c in sums])
    equal = F.lit(True)
    for c in sums:
        equal = equal & F.col(c).eqNullSafe(F.col(f"_{c}"))
    # at most one row per bucket
    unequal = [x.bucket for x in l.join(r, "bucket", "full").where(~equal).select("bucket").collect()]
    if not unequal:
        return hashes[0].limit(0).select("a", "b", F.lit(0).cast("bigint").alias("n_left"), F.lit(0).cast("bigint").alias("n_right"))
    spark = left.sparkSession
    some = F.broadcast(spark.createDataFrame([(b,) for b in unequal], "bucket int"))
    sides = []
    for k, h in enumerate(hashes):
        rows = h.withColumn("bucket", F.pmod("a", F.lit(buckets)).cast("int")).join(some, "bucket", "left_semi")
        sides.append(rows.select("a", "b", F.lit(1 - k).cast("bigint").alias("n_left"), F.lit(k).cast("bigint").alias("n_right")))
    return (sides[0].unionByName(sides[1]).groupBy("a", "b").agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"))
            .where(F.col("n_left") != F.col("n_right")))


def reconcile_digest(left: DataFrame, right: DataFrame, columns: list[str] | None = None,
                     buckets: int = DIGEST_BUCKETS) -> DataFrame:
    """One row: rows of both tables, rows that are missing on the right and that are too many there, counted with
    their copies, and the status (ok, error: rows are missing, warning: only too many)."""
    diff = table_differences(left, right, columns, buckets)
    less = F.greatest(F.col("n_left") - F.col("n_right"), F.lit(0))
    more = F.greatest(F.col("n_right") - F.col("n_left"), F.lit(0))
    x = diff.agg(F.coalesce(F.sum(less), F.lit(0)).alias("missing"), F.coalesce(F.sum(more), F.lit(0)).alias("extra"))
    x = x.crossJoin(left.agg(F.count(F.lit(1)).alias("left_rows"))).crossJoin(right.agg(F.count(F.lit(1)).alias("right_rows")))
    status = F.when(F.col("missing") > 0, "error").when(F.col("extra") > 0, "warning").otherwise("ok")
    return x.withColumn("status", status)


def unique_factors(df: DataFrame) -> Column:
    """True when no factor repeats in a row (blank / NULL ignored)."""
    return ~has_repeat(driver_array())


def key_profile(table: DataFrame) -> DataFrame:
    """One row per key with the counts that every check needs (the table's only scan)."""
    flag, model = F.coalesce(F.col("OriginalDataFlag"), F.lit(False)), F.col("Model")
    return cut_lineage(table.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("Rank").isNull()).alias("rank_nulls"),
        F.count_if(~unique_factors(table)).alias("repeats"),
        F.bool_and(flag).alias("flags"),
        F.bool_and(flag == model.isNull()).alias("live"),
    ))


def report(spark: SparkSession, table: DataFrame | None, source: DataFrame | None = None) -> DataFrame:
    """All checks as rows (check, status, passed, count, examples) plus 'overall'."""
    if table is None:  # missing table: one failed row, nothing else can run
        return spark.createDataFrame([("table_exists", "FAILED", False, 0, "")], REPORT_SCHEMA)
    sc = schema_check(table)
    parts = [spark.createDataFrame([(sc["check"], sc["status"], sc["passed"], sc["count"], sc["examples"])],
                                   REPORT_SCHEMA)]
    keys = key_profile(table)
    bad = _bad_ts("UpdateDT", keys)

    def total(of: Column) -> Column:
        return F.coalesce(F.sum(of), F.lit(0))

    counts = keys.agg(
        total(F.col("n")).alias("n_rows"), total(F.col("n") - 1).alias("duplicates"),
        total(F.when(F.col("SubjectID").isNull(), F.col("n")).otherwise(0)).alias("SubjectID_nulls"),
        total(F.col("rank_nulls")).alias("Rank_nulls"),
        total(F.when(F.col("UpdateDT").isNull(), F.col("n")).otherwise(0)).alias("UpdateDT_nulls"),
        total(F.when(bad, F.col("n")).otherwise(0)).alias("bad_timestamps"), total(F.col("repeats")).alias("repeats"),
        F.coalesce(F.bool_and("flags"), F.lit(True)).alias("flags_all_true"),
        F.coalesce(F.bool_and(F.col("Model").isNull()), F.lit(True)).alias("models_all_null"),
        F.coalesce(F.bool_and("live"), F.lit(True)).alias("live_consistent"),
    )
    rc = counts.crossJoin(examples(keys.where(bad), "UpdateDT"))  # one row each

    def row(check: str, ok: Column, count: Column, ex: Column = F.lit(""), warn: Column | None = None):
        status = F.when(~ok, F.lit("FAILED"))
        if warn is not None:
            status = status.when(warn, F.lit("WARNING"))
        return F.struct(F.lit(check).alias("check"), status.otherwise(F.lit("PASSED")).alias("status"),
                        ok.alias("passed"), count.cast("bigint").alias("count"), ex.alias("examples"))

    nulls = sum((F.col(f"{c}_nulls") for c in REQUIRED), F.lit(0))
    null_ex = F.concat_ws(",", *[F.concat(F.lit(f"{c}="), F.col(f"{c}_nulls").cast("string")) for c in REQUIRED])
    checks = [
        row("required_not_null", nulls == 0, nulls, null_ex),
        row("unique_keys", F.col("duplicates") == 0, F.col("duplicates")),
        row("timestamp_format", F.col("bad_timestamps") == 0, F.col("bad_timestamps"), F.col("examples")),
        row("seed_flags_true", F.col("flags_all_true"), F.col("n_rows")),
        row("seed_models_null", F.col("models_all_null"), F.col("n_rows")),
        row("live_flag_matches_model", F.col("live_consistent"), F.col("n_rows")),
        row("unique_factors", F.col("repeats") == 0, F.col("repeats")),
    ]
    if source is not None:
        rows = cut_lineage(source.groupBy(*source.columns).agg(F.count(F.lit(1)).alias("n")))
        ms = missing_subjects(rows, keys)
        rc = rc.crossJoin(rows.agg(F.count(F.lit(1)).alias("source_unique"))).crossJoin(
            ms.select("n_missing", F.col("examples").alias("missing_examples")))
        less, more = F.col("n_rows") < F.col("source_unique"), F.col("n_rows") > F.col("source_unique")
        checks += [row("source_reconcile", ~less, F.col("n_rows") - F.col("source_unique"), warn=more),
                   row("source_subjects", F.col("n_missing") == 0, F.col("n_missing"), F.col("missing_examples"))]
    parts.append(rc.select(F.explode(F.array(*checks)).alias("r")).select("r.*"))
    return with_overall(reduce(DataFrame.unionByName, parts))


def with_overall(rows: DataFrame) -> DataFrame:
    """The report rows and a row that sums them up (one row per check: a window over a dozen rows)."""
    rows = cut_lineage(rows)
    ok = F.bool_and("passed")
    overall = rows.agg(F.lit("overall").alias("check"), F.when(ok, "PASSED").otherwise("FAILED").alias("status"),
                       ok.alias("passed"), F.count_if(~F.col("passed")).alias("count"), F.lit("").alias("examples"))
    return rows.unionByName(overall)


def validate(spark: SparkSession, table_path: str, csv_path: str | None = None) -> DataFrame:
    """Validation report for a stored table and, optionally, its source CSV.

    A missing table is one failed row, beside the number of source rows if there is a source.
    A named CSV that does not exist adds a passing WARNING row ("source_exists") and skips the
    source checks.
    """
    from rankline.sources.ingest import none_if_missing, read_raw_csv, read_table_or_none
    table = read_table_or_none(spark, table_path)
    source = none_if_missing(lambda: read_raw_csv(spark, csv_path)) if csv_path is not None else None
    rep = report(spark, table, source)
    if csv_path is not None and source is None:
        rep = spark.createDataFrame([("source_exists", "WARNING", True, 0, csv_path)], REPORT_SCHEMA).unionByName(rep)
    elif table is None and source is not None:  # what waits to be loaded
        waits = source.agg(F.lit("source_exists").alias("check"), F.lit("PASSED").alias("status"), F.lit(True).alias("passed"),
                           F.count(F.lit(1)).alias("count"), F.lit("").alias("examples"))
        rep = waits.unionByName(rep)
    return rep
