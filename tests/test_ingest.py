import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from rankline.schema import RANKINGS
from rankline.sources import ingest as I


def test_raw_date_format(spark):
    raw = spark.createDataFrame([("41", "207", "Noise", "11/2/2021 9:05")], "SubjectID string, Rank string, "
                                "Driver1 string, UpdateDT string")
    rows, rejects = I.ingest(I.align_raw(raw))
    r = rows.first()
    assert r.UpdateDT == dt.datetime(2021, 11, 2, 9, 5) and r.SubjectID == 41 and r.Rank == 207
    assert r.Driver2 is None and r.OriginalDataFlag is True and r.Model is None
    assert rejects.count() == 0


def test_rejects_and_null_tokens(spark):
    raw = spark.createDataFrame([("x", "88", "NA", "7/30/2022 6:00"), ("12", "88", "Heat", "31/7/2022 6:00"),
                                 ("13", "3000000000", "Heat", "7/30/2022 6:00"), ("13", "2.5", "Heat", "7/30/2022 6:00"),
                                 ("14", "NULL", "Heat", "7/30/2022 6:00"), ("14", "NULL", "Heat", "7/30/2022 6:00")],
                                "SubjectID string, Rank string, Driver1 string, UpdateDT string")
    rows, rejects = I.ingest(I.align_raw(raw))
    assert sorted(r.reason for r in rejects.collect()) == ["bad Rank", "bad Rank", "bad SubjectID", "bad UpdateDT"]
    got = rows.collect()
    assert len(got) == 1 and got[0].Rank is None  # 'NULL' is missing, exact duplicate dropped


def test_narrow_csv(spark):
    d = tempfile.mkdtemp()
    p = os.path.join(d, "rank.csv")
    with open(p, "w") as f:
        f.write("SubjectID,Rank,Driver1,UpdateDT\n77,131,Dust,12/24/2021 23:59\n")
    rows, _ = I.ingest(I.read_raw_csv(spark, p))
    r = rows.collect()
    assert len(r) == 1 and r[0].Driver1 == "Dust" and r[0].Driver17 is None


def test_single_insert_padded_and_idempotent(spark):
    path = os.path.join(tempfile.mkdtemp(), "table")
    new = I.rows_from_lists(spark, [(77, 131, ["Dust", "Glare"], "2021-12-24 23:59:00", True, None)])
    assert I.insert_if_absent(spark, path, new) == 1
    assert I.insert_if_absent(spark, path, new) == 0          # replay: nothing appended
    t = spark.read.schema(RANKINGS).parquet(path).collect()
    assert len(t) == 1 and t[0].Driver2 == "Glare" and t[0].Driver3 is None


def test_sqlite_key_semantics(spark):
    existing = I.rows_from_lists(spark, [(1, 10, ["A"], "2022-02-17 05:45:00", True, None)])
    new = I.rows_from_lists(spark, [(1, 11, ["B"], "2022-02-17 05:45:00", True, None)])
    assert I.rows_to_insert(existing, new, null_safe=True).count() == 0
    assert I.rows_to_insert(existing, new, null_safe=False).count() == 1
    # large-batch path (no broadcast) agrees
    assert I.rows_to_insert(existing, new, null_safe=True, broadcast_keys=0).count() == 0


def test_batch_dedup_deterministic(spark):
    new = I.rows_from_lists(spark, [(1, 12, ["B"], "2022-02-17 05:45:00", True, "m"),
                                    (1, 11, ["C"], "2022-02-17 05:45:00", True, "m")])
    existing = spark.createDataFrame([], RANKINGS)
    got = I.rows_to_insert(existing, new).collect()
    assert len(got) == 1 and got[0].Rank == 11


def test_leaderboard_csv_with_blanks(spark):
    d = tempfile.mkdtemp()
    p = os.path.join(d, "summary.csv")
    with open(p, "w") as f:
        f.write("model_name,filename,mae,rmse,r2,spearman,kendall,accuracy_5,accuracy_10,accuracy_20,is_best_model\n")
        f.write("Model A,a.bin,10.5,12.0,0.5,0.6,0.4,0.2,0.3,0.5,True\n")
        f.write("Baseline, b, 20.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, False\n")
    rows = {r.model_name: r for r in I.read_leaderboard(spark, p).collect()}
    assert rows["Baseline"].mae == 20.0 and rows["Baseline"].filename == "b" and rows["Baseline"].is_best_model is False
    assert rows["Model A"].is_best_model is True


def test_table_existence(spark):
    assert I.read_table_or_none(spark, os.path.join(tempfile.mkdtemp(), "nope")) is None
    path = os.path.join(tempfile.mkdtemp(), "t")
    I.create_if_absent(spark, path)
    t = I.read_table_or_none(spark, path)
    assert t is not None and t.count() == 0 and t.columns == RANKINGS.fieldNames()


def test_malformed_lines_are_kept_and_counted(spark):
    d = tempfile.mkdtemp()
    lines = ["SubjectID,Rank,Driver1,UpdateDT", "1,5,A,1/2/2022 3:04", "2,6,B", "3,7,C,1/2/2022 3:04,more", "",
             '4,8,"D,1/2/2022 3:04', '5,9,E,"1/2/2022 3:04', '6,1,"F, G",1/2/2022 3:04', '7,2,"say \\"H\\"",1/2/2022 3:04',
             '8,3,"over', 'two lines",1/2/2022 3:04', "SubjectID,Rank,Driver1,UpdateDT", "9,4,,1/2/2022 3:04", "   "]
    with open(os.path.join(d, "rank.csv"), "w") as f:
        f.write("\r\n".join(lines))
    rows, bad = I.read_csv_lines(spark, d)
    assert {(r.SubjectID, r.Driver1, r.UpdateDT, r.Driver2) for r in rows.collect()} == {
        ("1", "A", "1/2/2022 3:04", None), ("6", "F, G", "1/2/2022 3:04", None), ("7", 'say "H"', "1/2/2022 3:04", None),
        ("9", None, "1/2/2022 3:04", None)}
    got = {r.raw: r.reason for r in bad.collect()}
    assert got == {lines[2]: "number of fields", lines[3]: "number of fields", lines[5]: "open quote", lines[6]: "open quote",
                   lines[9]: "open quote", lines[10]: "open quote"}
    assert rows.count() + bad.count() == 10  # lines with a character that are no header
    assert I.read_raw_csv(spark, d).count() == 4


def test_quoted_line_ends(spark):
    d = tempfile.mkdtemp()
    with open(os.path.join(d, "rank.csv"), "w") as f:
        f.write('SubjectID,Rank,Driver1,UpdateDT\n1,5,"over\ntwo lines",1/2/2022 3:04\n2,6,B\n3,7,C,1/2/2022 3:04\n')
    rows, bad = I.read_multiline_csv(spark, d)
    assert {(r.SubjectID, r.Driver1) for r in rows.collect()} == {("1", "over\ntwo lines"), ("3", "C")}
    assert [(r.raw.strip(), r.reason) for r in bad.collect()] == [("2,6,B", "number of fields")]
