from rankline.operators import quality as Q
from rankline.sources.fixtures import view
from testdata import SF_SMALL


def test_report_on_dirty_table(spark):
    rep = {r.check: r for r in Q.report(spark, view(spark, SF_SMALL, "rankings_dirty"),
                                        view(spark, SF_SMALL, "rankings_raw")).collect()}
    assert rep["schema"].passed
    assert not rep["required_not_null"].passed
    assert not rep["timestamp_format"].passed and "n/a" in rep["timestamp_format"].examples
    assert rep["live_flag_matches_model"].passed and not rep["seed_flags_true"].passed
    assert rep["source_reconcile"].status == "WARNING"
    assert rep["overall"].status == "FAILED"


def test_report_missing_table(spark):
    r = Q.report(spark, None).collect()
    assert len(r) == 1 and r[0].status == "FAILED"


def test_schema_contract_flags_extra_and_missing(spark):
    df = spark.createDataFrame([(1,)], "OtherCol int")
    sc = Q.schema_check(df)
    assert not sc["passed"] and "missing:SubjectID" in sc["examples"] and "extra:OtherCol" in sc["examples"]


def test_null_equal_duplicate_count(spark):
    df = spark.createDataFrame([(1, None, None), (1, None, None), (2, None, "m")],
                               "SubjectID long, UpdateDT timestamp_ntz, Model string")
    assert Q.duplicate_keys(df).first().duplicates == 1


def test_model_card_found_and_missing(spark):
    from rankline.operators.reports import model_card
    board = spark.createDataFrame([("RF", 17.45, 25.0, 0.8, 0.89, 0.74, 0.226, 0.428, 0.694)],
                                  "model_name string, mae double, rmse double, r2 double, spearman double, "
                                  "kendall double, accuracy_5 double, accuracy_10 double, accuracy_20 double")
    r = model_card(board, "RF").first()
    assert r.within_10_pct == 42.8 and r.expected_accuracy == "±17.5 ranks"
    m = model_card(board, "nope").collect()
    assert len(m) == 1 and m[0].mae is None


def test_validate_paths(spark):
    import os
    import tempfile
    from rankline.sources.ingest import create_if_absent, rows_from_lists, insert_if_absent
    base = tempfile.mkdtemp()
    assert [r.status for r in Q.validate(spark, os.path.join(base, "none")).collect()] == ["FAILED"]
    path = os.path.join(base, "t")
    create_if_absent(spark, path)
    insert_if_absent(spark, path, rows_from_lists(spark, [(1, 10, ["A"], "2025-03-08 14:30:00", True, None)]))
    csv = os.path.join(base, "rank.csv")
    with open(csv, "w") as f:
        f.write("SubjectID,Rank,Driver1,UpdateDT\n1,10,A,3/8/2025 14:30\n")
    rep = {r.check: r for r in Q.validate(spark, path, csv).collect()}
    assert rep["overall"].passed and rep["source_reconcile"].status == "PASSED"
    rep2 = {r.check: r for r in Q.validate(spark, path, os.path.join(base, "missing.csv")).collect()}
    assert rep2["source_exists"].status == "WARNING" and rep2["overall"].passed


def test_digests_find_what_differs_and_shuffle_only_checksums(spark):
    from pyspark.sql import functions as F
    t = view(spark, SF_SMALL, "rankings").select("SubjectID", "Rank", "Model", "UpdateDT").withColumn("i", F.monotonically_increasing_id())
    same = Q.reconcile_digest(t, t.repartition(5)).first()
    assert (same.missing, same.extra, same.status) == (0, 0, "ok") and same.left_rows == t.count()
    changed = t.where("i <> 3").withColumn("Rank", F.when(F.col("i") == 5, 999).otherwise(F.col("Rank")))
    changed = changed.withColumn("Model", F.when(F.col("i") == 7, F.lit("")).otherwise(F.col("Model")))  # '' is not NULL
    r = Q.reconcile_digest(t, changed.unionByName(changed.where("i = 9"))).first()
    nulls = t.where("i = 7 AND Model IS NULL").count()
    assert (r.missing, r.extra, r.status) == (2 + nulls, 2 + nulls, "error")
    assert Q.reconcile_digest(t, t.unionByName(t.where("i = 9"))).first().status == "warning"
    assert Q.reconcile_digest(t.limit(0), t.limit(0)).first().status == "ok"
    assert Q.reconcile_digest(t, t.limit(0)).first().missing == t.count()
    # what is shuffled has a bucket and sums, no column of the table
    plan = Q.checksums(Q._row_hashes(t, ["SubjectID", "Model"]))._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and plan.count("Exchange") == 1
    # few buckets find the same
    assert Q.reconcile_digest(t, changed, buckets=3).first().missing == 2 + nulls


def test_digests_tell_column_borders_apart(spark):
    a = spark.createDataFrame([("ab", "c"), (None, "")], "x string, y string")
    b = spark.createDataFrame([("a", "bc"), ("", None)], "x string, y string")
    assert Q.reconcile_digest(a, b).first().missing == 2
