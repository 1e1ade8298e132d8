import datetime as dt

from pyspark.sql import functions as F

from rankline.functions import columns as C
from rankline.operators import factors as FA
from rankline.operators import features as FE
from rankline.schema import DRIVERS, RANKINGS
from rankline.sources.fixtures import view
from testdata import SF_SMALL


def _input(spark, sid="test1"):
    d = ["factor1", "factor2", None] + [None] * 14
    return spark.createDataFrame([(sid, *d, 25, dt.datetime(2023, 2, 1, 9, 30))],
                                 ", ".join(["SubjectID string", *[f"{x} string" for x in DRIVERS],
                                            "PrevRank int", "UpdateDT timestamp_ntz"]))


def _reference(spark):
    rows = [("ref1", 10, dt.datetime(2023, 1, 1), "factor1", "factor2", "factor5"),
            ("ref2", 20, dt.datetime(2023, 1, 15), "factor3", "factor4", "factor6")]
    df = spark.createDataFrame(rows, "SubjectID string, Rank int, UpdateDT timestamp_ntz, "
                                     "Driver1 string, Driver2 string, Driver3 string")
    return df.select("*", *[F.lit(None).cast("string").alias(d) for d in DRIVERS[3:]])


def test_vocabulary_union(spark):
    assert FA.resolve_vocabulary(_reference(spark), _input(spark)) == [f"factor{i}" for i in range(1, 7)]


def test_base_positions_onehot_calendar(spark):
    vocab = FA.resolve_vocabulary(_reference(spark), _input(spark))
    inp = _input(spark).withColumn("Rank", F.lit(None).cast("int"))
    pos, onehot = FE.base_features(inp, _reference(spark), vocab)
    p = pos.first()
    assert p.factor1_Position == 1 and p.factor2_Position == 2 and p.factor3_Position == 0
    assert p.PrevRank == 25.0 and p.RankChange == 0 and p.DaysSincePrev == 0
    assert (p.Year, p.Month, p.DayOfMonth, p.DayOfWeek) == (2023, 2, 1, 2)  # Wednesday, Monday = 0
    assert p.DaysSinceFirst == 31
    o = onehot.first()
    assert o.Driver1_factor1 == 1 and o.Driver2_factor2 == 1 and o.Driver1_factor2 == 0


def test_prev_rank_falls_back_to_reference_mean(spark):
    inp = _input(spark).drop("PrevRank").withColumn("Rank", F.lit(None).cast("int"))
    pos, _ = FE.base_features(inp, _reference(spark), ["factor1"])
    assert pos.first().PrevRank == 15.0


def test_align_missing_saved_column_is_zero(spark):
    _, onehot = FE.base_features(_input(spark).withColumn("Rank", F.lit(None).cast("int")), _reference(spark),
                                 ["factor1", "factor2"])
    saved = ["Driver1_factor1", "Driver1_factor3", "Driver2_factor2", "Custom_Feature"]
    r = FE.align_features(onehot, saved).first()
    assert list(r) == [1, 0, 1, 0]


def test_blank_id_becomes_new_input(spark):
    r = FE.input_defaults(_input(spark, sid="")).first()
    assert r.SubjectID == "new_input" and r.Driver3 is None


def test_positions_equal_melt_pivot(spark):
    r = view(spark, SF_SMALL, "rankings")
    vocab = FA.resolve_vocabulary(r)
    fast = FA.with_positions(r.select("SubjectID", "UpdateDT", *DRIVERS), vocab).drop(*DRIVERS)
    long = FA.driver_long(r, ["SubjectID", "UpdateDT"])
    slow = long.groupBy("SubjectID", "UpdateDT").pivot("Factor", vocab).agg(F.first("DriverNumber")).na.fill(0)
    slow = slow.select("SubjectID", "UpdateDT", *[F.col(f).cast("int").alias(f) for f in vocab])
    assert fast.exceptAll(slow).count() == 0 and slow.exceptAll(fast).count() == 0


def test_last_position_wins_on_repeat(spark):
    df = spark.createDataFrame([("A", "B", "A")], "Driver1 string, Driver2 string, Driver3 string")
    r = df.select(C.position_first(C.driver_array(["Driver1", "Driver2", "Driver3"]), "A").alias("f"),
                  C.position_last(C.driver_array(["Driver1", "Driver2", "Driver3"]), "A").alias("l")).first()
    assert (r.f, r.l) == (1, 3)


def test_half_even_and_weekday(spark):
    r = spark.range(1).select(C.half_even_int(F.lit(2.5)).alias("a"), C.half_even_int(F.lit(3.5)).alias("b"),
                              C.weekday_mon0(F.lit(dt.datetime(2024, 1, 1))).alias("w")).first()
    assert (r.a, r.b, r.w) == (2, 4, 0)


def test_whole_days_floor(spark):
    r = spark.range(1).select(C.whole_days(F.lit(dt.datetime(2024, 1, 1, 23)).cast("timestamp_ntz"),
                                           F.lit(dt.datetime(2024, 1, 2, 1)).cast("timestamp_ntz")).alias("d")).first()
    assert r.d == 0


def test_scenarios_are_permutations_and_seeded(spark):
    subj = spark.createDataFrame([(1,), (2,)], "SubjectID long")
    vocab = [f"Factor{i}" for i in range(1, 18)]
    a = FA.factor_scenarios(subj, vocab, 3, "s1").orderBy("SubjectID", "Scenario").collect()
    b = FA.factor_scenarios(subj, vocab, 3, "s1").orderBy("SubjectID", "Scenario").collect()
    assert a == b and len(a) == 6
    assert all(sorted(list(r)[2:]) == sorted(vocab) for r in a)


def test_driver_column_discovery(spark):
    df = spark.createDataFrame([(1, 2, "a", "b")], "SubjectID long, Rank int, Driver1 string, Driver2 string")
    assert FA.driver_columns(df) == ["Driver1", "Driver2"]
    odd = spark.createDataFrame([(1, 2, "a", "b")], "id long, r int, x string, y string")
    assert FA.driver_columns(odd) == ["x", "y"]


def test_serving_without_history_gives_zero_history_features(spark):
    from rankline.plans.q_history import FIXTURE_VOCAB
    new = view(spark, SF_SMALL, "inputs")
    with_h = FE.serving_features(view(spark, SF_SMALL, "rankings"), new.withColumn(
        "SubjectID", F.expr("try_cast(SubjectID AS BIGINT)")), FIXTURE_VOCAB)
    alone = FE.serving_features(None, new, FIXTURE_VOCAB)
    assert alone.columns == with_h.columns
    r = alone.agg(F.max("PrevRank"), F.max("AvgPreviousRanks"), F.max("DaysSinceFirst")).first()
    assert tuple(r) == (0, 0.0, 0)
    assert alone.count() == new.count()


def test_driver_factor_counts_hold_a_bounded_number_of_rows_a_task(spark, monkeypatch):
    from rankline.operators import factors as FA
    from rankline.schema import DRIVERS
    new = [(i % 7 if i % 5 else None, *[f"F{(i + j) % 3}" if (i + j) % 4 else None for j in range(17)]) for i in range(300)]
    df = spark.createDataFrame(new, "SubjectID bigint, " + ", ".join(f"{d} string" for d in DRIVERS))
    want = {}
    for r in new:
        for d, f in zip(DRIVERS, r[1:]):
            if f is not None:
                want[r[0], d, f] = want.get((r[0], d, f), 0) + 1
    monkeypatch.setattr(FA, "COUNT_ROWS", 25, raising=False)
    got = FA.driver_factor_counts(df, ["SubjectID"])
    assert {(r.SubjectID, r.Driver, r.Factor): r.Count for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    # rows are dealt out, 25 a task, below the partial counts
    below = plan[plan.rindex("partial_count"):]
    assert "Exchange hashpartitioning(SubjectID" in below and ", 12)" in below.replace(", REPARTITION", ") REPARTITION")


def test_drivers_travel_as_one_array(spark):
    row = dict({d: None for d in DRIVERS}, SubjectID=1, Rank=5, UpdateDT=dt.datetime(2024, 1, 1), Model=None, OriginalDataFlag=True)
    rows = [dict(row, Driver1="A", Driver2="B"), dict(row, Driver1="A", Driver2="B"), dict(row, Driver1="A"),
            dict(row, Driver1="A", Driver2=""), dict(row, Driver2="B", Driver17="A", UpdateDT=dt.datetime(2024, 1, 3))]
    df = spark.createDataFrame(rows, RANKINGS)
    out = FE.rank_features(df, ["A", "B"], keep=["UpdateDT", "Driver2", "Driver17"])
    got = sorted((r.UpdateDT.day, r.Driver2 or str(r.Driver2), r.Driver17, r.A, r.B) for r in out.collect())
    # whole-row duplicates only: a missing driver is another row than a blank one
    assert got == [(1, "", None, 1, 0), (1, "B", None, 1, 2), (1, "None", None, 1, 0), (3, "B", "A", 17, 2)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    keys = [line for line in plan.split("\n") if "Aggregate [" in line]
    assert keys and not any("Driver2#" in line for line in keys)
